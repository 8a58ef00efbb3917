"""Toxicity: a bidirectional gated recurrent network with attention pooling.

A text is cut into words (long ones into pieces of ``PIECE`` characters), words
into overlapping windows that cover the whole text. A word enters as how much
more often it stands in toxic documents than chance would have it (a z-score by
hashed word), as the largest such score of its character 5-grams, as a learned
vector of its hash, and as the mean of learned vectors of its trigrams. The
network reads a window in both directions, weights its states by attention and
gives a logit. A document's score is a logistic function of its largest logits,
their mean and the number of windows.

Word statistics are counted in Spark over all labelled rows outside the held-out
fifth. The network is fitted by numpy on the driver on windows of at most
``SAMPLE`` labelled documents, the final step on at most ``SAMPLE`` others; of
both, a document's own counts are left out of its scores. Labels, language,
source and id are no inputs.

Defined cases: texts without words, null among them, get the share of label 1;
so does every text if there are no labels of both kinds; rows with null ids are
scored and count as held out; repeated rows get equal scores; a very long text is
scored by all its windows; documents that tie for the sample are taken by id; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import crc_bucket, few_rows

#: Bound on the labelled documents that the network is fitted on.
SAMPLE = 3000
#: Windows of so many words start at every STRIDE words.
WINDOW, STRIDE = 128, 96
PIECE = 64
SCORE_BITS, WORD_BITS, CHAR_BITS = 20, 14, 12
GRAM = 5
LEARNED, HIDDEN = 4, 8
INPUTS = 2 + 2 * LEARNED
#: Word statistics count from so many documents and this z-score on.
LEAST_SEEN, LEAST_Z = 5, 3.0
#: Windows that run through the network at once; words that a task remembers.
BATCH, REMEMBERED = 2048, 200_000
#: Windows of each sampled document: the most suspicious ones and a few others.
SUSPECT, OTHER = 2, 1

_WORD = re.compile(rf"\w{{1,{PIECE}}}")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace")) >> (64 - SCORE_BITS)


def grams(found: list[str], n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all words, flat, and where each word's begin.

    A word counts with its edges; one that is too short is a gram itself.
    """
    raw = [f"<{w}>".ljust(n, "_") for w in found]
    chars = np.frombuffer("".join(raw).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    mixed = np.zeros(max(0, len(chars) - n + 1), np.uint64)
    for i in range(n):
        mixed = (mixed ^ chars[i : len(mixed) + i]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
    counts = lengths - n + 1
    ends = lengths.cumsum()
    inside = np.repeat(ends - lengths - (counts.cumsum() - counts), counts) + np.arange(counts.sum())
    return ((mixed[inside] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - bits)).astype(np.int64), counts.cumsum() - counts


def trigrams(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return grams(found, 3, CHAR_BITS)


def score_keys(found: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in the table of scores: of each word, of its 5-grams, flat."""
    flat, starts = grams(found, GRAM, SCORE_BITS)
    return np.fromiter(map(word_hash, found), np.int64, len(found)), flat + (1 << SCORE_BITS), starts


def window_starts(n: int) -> np.ndarray:
    """First words of the windows of n words; the last one ends with the text."""
    if n <= WINDOW:
        return np.zeros(min(1, n), np.int64)
    starts = np.arange(0, n - WINDOW + STRIDE, STRIDE)
    starts[-1] = n - WINDOW
    return starts


def suspicion(toxic: np.ndarray, seen: np.ndarray, share: float) -> np.ndarray:
    """How far the toxic documents with a word exceed what chance would give."""
    z = (toxic - seen * share) / np.sqrt(np.maximum(seen * share * (1 - share), 0) + 1)
    return np.where((seen >= LEAST_SEEN) & (np.abs(z) >= LEAST_Z), np.clip(z / 8, -1, 4), 0).astype(np.float32)


def without_own(toxic: np.ndarray, seen: np.ndarray, y: int, share: float) -> Callable[[np.ndarray], np.ndarray]:
    """Scores of keys as if one counted document of label y had not been."""
    return lambda k: suspicion(np.maximum(toxic[k] - y, 0), np.maximum(seen[k] - 1, 0), share)


class Sparse:
    """A table by key that workers are sent without its zeros, which most keys have.

    Spark lays what it sends to Python down as a file for the driver and for each executor.
    """

    def __init__(self, values: np.ndarray):
        self.values = values

    def __getstate__(self) -> tuple[np.ndarray, np.ndarray, int]:
        some = self.values != 0
        return np.packbits(some), self.values[some], len(some)

    def __setstate__(self, state: tuple[np.ndarray, np.ndarray, int]) -> None:
        bits, held, size = state
        self.values = np.zeros(size, held.dtype)
        self.values[np.unpackbits(bits, count=size).astype(bool)] = held


def paired(word: np.ndarray, gram: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The two scores of each word: its own and the largest of its 5-grams."""
    return np.stack([word, np.maximum.reduceat(gram, starts)], axis=1)


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def _gru(gates: np.ndarray, recur: np.ndarray, live: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (time, batch, HIDDEN) from input gates (time, batch, 3 * HIDDEN)."""
    h = np.zeros((gates.shape[1], HIDDEN), np.float32)
    out = np.empty((*gates.shape[:2], HIDDEN), np.float32)
    for t in range(len(gates)):
        g, hu = gates[t], h @ recur
        zr = _sigmoid(g[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN] * live[t], zr[:, HIDDEN:]
        n = np.tanh(g[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
        if keep is not None:
            keep.append((h, zr[:, :HIDDEN], r, n, hu[:, 2 * HIDDEN :]))
        h = h + z * (n - h)
        out[t] = h
    return out


def _gru_back(d_out: np.ndarray, recur: np.ndarray, live: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the input gates and of the recurrent weights."""
    d_gates = np.empty((*d_out.shape[:2], 3 * HIDDEN), np.float32)
    d_recur, dh = np.zeros_like(recur), np.zeros_like(d_out[0])
    for t in range(len(d_out) - 1, -1, -1):
        h, z, r, n, hn = kept[t]
        dh = dh + d_out[t]
        dz = dh * (n - h) * live[t] * z * (1 - z)
        dn = dh * z * live[t] * (1 - n * n)
        dr = dn * hn * r * (1 - r)
        d_gates[t] = np.concatenate([dz, dr, dn], axis=1)
        d_hu = np.concatenate([dz, dr, dn * r], axis=1)
        d_recur += h.T @ d_hu
        dh = dh * (1 - z * live[t]) + d_hu @ recur.T
    return d_gates, d_recur


@dataclass
class Network:
    """All weights; ``final`` turns a document's summary into a logit."""

    weights: dict[str, np.ndarray]
    z: np.ndarray
    share: float
    final: np.ndarray | None = None
    fitted: bool = True

    def __getstate__(self) -> dict:
        return self.__dict__ | {"z": Sparse(self.z)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state | {"z": state["z"].values})

    def inputs(self, found: list[str], scores: Callable[[np.ndarray], np.ndarray] | None = None) -> np.ndarray:
        """Input vectors of distinct words; ``scores`` of keys may stand for ``z``."""
        hashes, flat, starts = score_keys(found)
        scores = scores or self.z.__getitem__
        z = paired(scores(hashes), scores(flat), starts)
        return self._joined(z, hashes >> (SCORE_BITS - WORD_BITS), *trigrams(found))

    def _joined(self, z, hashes, flat, starts) -> np.ndarray:
        ends = np.append(starts[1:], len(flat))
        sums = np.concatenate([np.zeros((1, LEARNED)), self.weights["chars"][flat].cumsum(axis=0, dtype=np.float64)])
        mean = (sums[ends] - sums[starts]) / np.maximum(ends - starts, 1)[:, None]
        return np.concatenate([z, self.weights["words"][hashes], mean], axis=1).astype(np.float32)

    def gates(self, x: np.ndarray) -> list[np.ndarray]:
        return [x @ self.weights[f"in_{d}"] + self.weights[f"bias_{d}"] for d in "fb"]

    def logits(self, forward: np.ndarray, backward: np.ndarray, live: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logit of each window from its input gates (time, batch, gates)."""
        w = self.weights
        kept = ([], []) if keep is not None else (None, None)
        hf = _gru(forward, w["recur_f"], live, kept[0])
        hb = _gru(backward[::-1], w["recur_b"], live[::-1], kept[1])[::-1]
        states = np.concatenate([hf, hb], axis=2)
        seen = np.tanh(states @ w["attend"])
        e = np.where(live[:, :, 0] > 0, seen @ w["query"], -1e9)
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        pooled = (states * a[:, :, None]).sum(axis=0)
        if keep is not None:
            keep |= {"kept": kept, "states": states, "seen": seen, "a": a, "pooled": pooled}
        return pooled @ w["out"] + w["out_bias"][0]


def _start(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    normal = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
    w = {"words": np.zeros((1 << WORD_BITS, LEARNED), np.float32), "chars": np.zeros((1 << CHAR_BITS, LEARNED), np.float32)}
    for d in "fb":
        w |= {f"in_{d}": normal(INPUTS, 3 * HIDDEN), f"recur_{d}": normal(HIDDEN, 3 * HIDDEN), f"bias_{d}": np.zeros(3 * HIDDEN, np.float32)}
    return w | {"attend": normal(2 * HIDDEN, HIDDEN), "query": normal(HIDDEN), "out": normal(2 * HIDDEN), "out_bias": np.zeros(1, np.float32)}


@dataclass
class Windows:
    """Training windows: words by window, padded; trigrams flat by word."""

    doc: np.ndarray
    y: np.ndarray
    z: np.ndarray  # windows x WINDOW x 2
    hashes: np.ndarray
    live: np.ndarray
    flat: np.ndarray
    starts: np.ndarray  # by word of a window, in order

    def take(self, net: Network, rows: np.ndarray):
        at = (rows[:, None] * WINDOW + np.arange(WINDOW)).ravel()
        begin, end = self.starts[at], np.append(self.starts[1:], len(self.flat))[at]
        n = end - begin
        flat = self.flat[np.repeat(begin - np.append(0, n.cumsum()[:-1]), n) + np.arange(n.sum())]
        x = net._joined(self.z[rows].reshape(-1, 2), self.hashes[rows].ravel(), flat, np.append(0, n.cumsum()[:-1]))
        return x, flat, n, self.live[rows].T[:, :, None].astype(np.float32)

    def forward(self, net: Network, rows: np.ndarray, keep: dict | None = None, drop: np.random.Generator | None = None):
        x, flat, n, live = self.take(net, rows)
        if drop is not None:  # whole windows go without their learned vectors
            x[:, 2:] *= np.repeat(drop.random(len(rows)) < 0.5, WINDOW)[:, None]
        gates = [g.reshape(len(rows), WINDOW, -1).transpose(1, 0, 2) for g in net.gates(x)]
        return net.logits(*gates, live, keep), x, flat, n, live


def _gradients(net: Network, data: Windows, rows: np.ndarray, y: np.ndarray, drop: np.random.Generator) -> dict[str, np.ndarray]:
    w, keep = net.weights, {}
    logit, x, flat, n, live = data.forward(net, rows, keep, drop)
    d = ((_sigmoid(logit) - y) / len(rows)).astype(np.float32)
    states, seen, a, pooled = (keep[k] for k in ("states", "seen", "a", "pooled"))
    g = {"out": pooled.T @ d, "out_bias": d.sum(keepdims=True)}
    d_pooled = d[:, None] * w["out"]
    d_states = a[:, :, None] * d_pooled
    d_a = (states * d_pooled).sum(axis=2)
    d_e = a * (d_a - (a * d_a).sum(axis=0))
    d_seen = d_e[:, :, None] * w["query"] * (1 - seen * seen)
    g["query"] = (seen * d_e[:, :, None]).sum(axis=(0, 1))
    g["attend"] = states.reshape(-1, 2 * HIDDEN).T @ d_seen.reshape(-1, HIDDEN)
    d_states = (d_states + d_seen @ w["attend"].T).astype(np.float32)
    d_x = np.zeros_like(x)
    for k, name in enumerate("fb"):
        part = d_states[:, :, k * HIDDEN : (k + 1) * HIDDEN]
        d_gates, g[f"recur_{name}"] = _gru_back(part[::-1] if k else part, w[f"recur_{name}"], live[::-1] if k else live, keep["kept"][k])
        flat_gates = (d_gates[::-1] if k else d_gates).transpose(1, 0, 2).reshape(len(x), -1)
        g[f"in_{name}"], g[f"bias_{name}"] = x.T @ flat_gates, flat_gates.sum(axis=0)
        d_x += flat_gates @ w[f"in_{name}"].T
    g["words"], g["chars"] = np.zeros_like(w["words"]), np.zeros_like(w["chars"])
    np.add.at(g["words"], data.hashes[rows].ravel(), d_x[:, 2 : 2 + LEARNED])
    np.add.at(g["chars"], flat, np.repeat(d_x[:, 2 + LEARNED :] / np.maximum(n, 1)[:, None], n, axis=0))
    return g


def fit(data: Windows, z: np.ndarray, share: float, steps: int = 320, batch: int = 60, rate: float = 0.01) -> Network:
    """Adam on windows; a toxic document is stood for by its best window so far."""
    net = Network(_start(), z, share)
    docs, first = np.unique(data.doc, return_index=True)
    label = data.y[first]
    if not len(docs) or label.min() == label.max():
        net.fitted = False
        return net
    rng = np.random.default_rng(11)
    place = np.searchsorted(docs, data.doc)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.weights.items()}
    best = data.z.sum(axis=(1, 2)).astype(float)
    negative, positive = np.flatnonzero(data.y == 0), np.flatnonzero(label == 1)
    for step in range(1, steps + 1):
        if step % 50 == 0:
            best = _all_logits(net, data)
        if step % 50 in (0, 1):
            order = np.lexsort((-best, place))
            top = order[np.r_[True, place[order][1:] != place[order][:-1]]]
            hard = negative[np.argsort(-best[negative], kind="stable")][: max(batch, len(negative) // 4)]
        third = batch // 3
        rows = np.concatenate([top[rng.choice(positive, third)], rng.choice(negative, third), rng.choice(hard, third)])
        y = np.r_[np.ones(third), np.zeros(2 * third)].astype(np.float32)
        slow = rate * min(1, 2 * (1 - step / (steps + 1)))
        for k, g in _gradients(net, data, rows, y, rng).items():
            m, v = moments[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            net.weights[k] -= (slow * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
            if k in ("words", "chars"):
                net.weights[k] *= 0.99
    return net


def _all_logits(net: Network, data: Windows) -> np.ndarray:
    rows = np.arange(len(data.y))
    return np.concatenate([data.forward(net, rows[i : i + 1024])[0] for i in range(0, len(rows), 1024)])


def summary(logits: np.ndarray) -> np.ndarray:
    """What the final step knows of a document: from the logits of its windows."""
    top = np.sort(np.clip(logits, -12, 12))[::-1]
    return np.array([1.0, top[0], top[min(1, len(top) - 1)], top.mean(), np.log1p((top > 0).sum()), np.log(len(top))])


def _calibrated(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression of the label on summaries, with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = _sigmoid(x @ w)
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-3, *[0.3] * (x.shape[1] - 1)])
        w += np.clip(np.linalg.solve(hess, x.T @ (y - p) - np.r_[1e-3, [0.3] * (x.shape[1] - 1)] * w), -2, 2)
    return w


def _labelled(labels: DataFrame, target: str) -> DataFrame:
    known = labels.where((crc_bucket() != 0) & F.col("doc_id").isNotNull() & F.col(target).isNotNull())
    return known.groupBy("doc_id").agg(F.max(target).cast("int").alias("y"))


def statistics(docs: DataFrame, known: DataFrame, share: float) -> tuple[np.ndarray, np.ndarray]:
    """By score key: toxic documents and documents with it, over all of ``known``.

    Keys below the least number or z-score are left out, as they score zero.
    """
    size = 2 << SCORE_BITS

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, size), np.int32)
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if found := list(set(words(text))):
                    hashes, flat, _ = score_keys(found)
                    distinct = np.unique(np.r_[hashes, flat])
                    held[1, distinct] += 1
                    held[0, distinct] += y
        some = np.flatnonzero(held[1])
        for i in range(0, len(some), 100_000):
            part = some[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *(pa.array(held[k, part]) for k in (0, 1))], ["key", "toxic", "seen"])

    # labels grow with the documents: joined by shuffle at every size
    counted = docs.select("doc_id", "text").join(known.hint("merge"), "doc_id").select("y", "text").mapInArrow(work, "key int, toxic int, seen int")
    summed = counted.groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("seen").alias("seen"))
    z = (F.col("toxic") - F.col("seen") * share) / F.sqrt(F.col("seen") * share * (1 - share) + 1)
    rows = summed.where((F.col("seen") >= LEAST_SEEN) & (F.abs(z) >= LEAST_Z)).toArrow()  # at most 2 << SCORE_BITS rows
    out = np.zeros((2, size), np.int64)
    out[:, rows["key"].to_numpy()] = rows["toxic"].to_numpy(), rows["seen"].to_numpy()
    return out[0], out[1]


def sampled_windows(docs: DataFrame, chosen: DataFrame, toxic: np.ndarray, seen: np.ndarray, share: float, sample: int = SAMPLE) -> Windows:
    """A few windows of each sampled document, as many as ``sample`` rows have, its own label left out of z."""
    sent = docs.sparkSession.sparkContext.broadcast((Sparse(toxic), Sparse(seen)))
    schema = "doc long, y int, at int, z array<float>, hashes array<int>, flat array<int>, starts array<int>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, seen = (t.values for t in sent.value)
        for batch in batches:
            out = []
            for doc_id, y, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                found = words(text)
                if not found:
                    continue
                number: dict[str, int] = {}
                place = np.fromiter((number.setdefault(w, len(number)) for w in found), np.int64, len(found))
                hashes, flat, begin = score_keys(list(number))
                own = without_own(toxic, seen, y, share)
                z, hashes = paired(own(hashes), own(flat), begin)[place], (hashes >> (SCORE_BITS - WORD_BITS))[place]
                starts = window_starts(len(found))
                peak = np.array([z[s : s + WINDOW].sum() for s in starts])
                order = np.argsort(-peak, kind="stable")
                rest = order[SUSPECT:]
                others = rest[np.random.default_rng(doc_id & 0xFFFF).permutation(len(rest))[:OTHER]]
                for at, s in enumerate(starts[np.r_[order[:SUSPECT], others].astype(int)]):
                    flat, begin = trigrams(found[s : s + WINDOW])
                    out.append((doc_id, y, at, z[s : s + WINDOW].ravel(), hashes[s : s + WINDOW].astype(np.int32), flat.astype(np.int32), begin.astype(np.int32)))
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.float32()), *[pa.list_(pa.int32())] * 3]
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["doc", "y", "at", "z", "hashes", "flat", "starts"])

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text").mapInArrow(work, schema).distinct()
    # an id may name many rows: the bound is one of windows
    got = rows.orderBy(F.xxhash64("doc", "hashes", "at"), "doc", "at", "hashes", "z").limit(sample * (SUSPECT + OTHER)).toArrow().sort_by([("doc", "ascending"), ("at", "ascending")])
    n = len(got)
    z, hashes, live = np.zeros((n, WINDOW, 2), np.float32), np.zeros((n, WINDOW), np.int64), np.zeros((n, WINDOW), bool)
    parts = {c: got[c].combine_chunks() for c in ("z", "hashes", "flat", "starts")}
    length = {c: np.asarray(x.value_lengths()) if n else np.zeros(0, np.int64) for c, x in parts.items()}
    value = {c: x.flatten().to_numpy() for c, x in parts.items()}
    live[:] = np.arange(WINDOW) < length["hashes"][:, None]
    z[live], hashes[live] = value["z"].reshape(-1, 2), value["hashes"]
    flat, ends = value["flat"].astype(np.int64), length["flat"].cumsum()
    starts = np.repeat(ends[:, None], WINDOW, axis=1).astype(np.int64)
    starts[live] = value["starts"] + np.repeat(ends - length["flat"], length["hashes"])
    return Windows(got["doc"].to_numpy(), got["y"].to_numpy(), z, hashes, live, flat, starts.ravel())


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic", sample: int = SAMPLE) -> Network:
    """Word statistics over all labelled rows; the network on at most ``sample``.

    Toxic documents take up to half of the sample of windows. The final step is
    fitted on at most ``sample`` rows that the network has not seen, of those
    whose hash has remainder 1; all other rows are open to the network.
    """
    known = _labelled(labels, target)
    total = known.agg(F.count("*").alias("n"), F.sum("y").alias("toxic")).first()
    share = total.toxic / total.n if total.n else 0.5
    if not total.n or not 0 < total.toxic < total.n:
        return Network({}, np.zeros(0), share, fitted=False)
    toxic, seen = statistics(docs, known, share)
    order = [F.xxhash64("doc_id"), "doc_id"]
    apart = known.where(crc_bucket() == 1).orderBy(*order).limit(sample)
    rest = known.join(F.broadcast(apart.select("doc_id")), "doc_id", "left_anti")
    chosen = rest.where("y = 1").orderBy(*order).limit(sample // 2).unionByName(rest.where("y = 0").orderBy(*order).limit(sample - sample // 2))
    net = fit(sampled_windows(docs, chosen, toxic, seen, share, sample), suspicion(toxic, seen, share), share)
    if net.fitted:
        got = own_summaries(docs, apart, net, toxic, seen).orderBy(F.xxhash64("doc_id", "summary"), "doc_id", "summary").limit(sample).toArrow()
        x = np.array(got["summary"].to_pylist(), float).reshape(-1, 6)
        net.final = _calibrated(x, got["y"].to_numpy().astype(float)) if len(x) else np.array([0.0, 0.5, 0, 0, 0, 0])
    return net


class _Seen(dict):
    """Numbers the distinct words of a task; 0 stands for padding."""

    def __missing__(self, word: str) -> int:
        self.fresh.append(word)
        self[word] = n = len(self) + 1
        return n


class _Reader:
    """Runs windows of many documents through the network in batches."""

    def __init__(self, net: Network):
        self.net = net
        self.reset()

    def reset(self) -> None:
        self.seen = _Seen()
        self.seen.fresh = []
        self.tables = [[np.zeros((1, 3 * HIDDEN), np.float32)] for _ in range(2)]

    def numbered(self, text: str | None) -> np.ndarray:
        found = words(text)
        return np.fromiter(map(self.seen.__getitem__, found), np.int32, len(found))

    def gate_tables(self) -> list[np.ndarray]:
        if self.seen.fresh:
            for table, new in zip(self.tables, self.net.gates(self.net.inputs(self.seen.fresh)), strict=True):
                table[:] = [np.concatenate([*table, new])]
            self.seen.fresh = []
        return [t[0] for t in self.tables]

    def summaries(self, texts: list[np.ndarray]) -> list[np.ndarray | None]:
        """The summary of each text's windows; None without words."""
        tables = self.gate_tables()
        blocks, counts = [], []
        for ids in texts:
            padded = np.concatenate([ids, np.zeros(max(0, WINDOW - len(ids)), np.int32)])
            starts = window_starts(len(ids))
            blocks.append(padded[starts[:, None] + np.arange(WINDOW)])
            counts.append(len(starts))
        ids, logits = np.concatenate(blocks), []
        for a in range(0, len(ids), BATCH):
            part = ids[a : a + BATCH].T
            logits.append(self.net.logits(tables[0][part], tables[1][part], (part > 0)[:, :, None].astype(np.float32)))
        if len(self.seen) > REMEMBERED:
            self.reset()
        ends = np.cumsum(counts)
        each = np.split(np.concatenate([*logits, np.zeros(0)]), ends[:-1])
        return [summary(x) if len(x) else None for x in each]


def summaries(docs: DataFrame, net: Network, key: str = "doc_id") -> DataFrame:
    """(key, summary) for every row of ``docs``; null without words."""
    sent = docs.sparkSession.sparkContext.broadcast(net)
    kind = docs.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(sent.value)
        for batch in batches:
            start, texts, held = 0, [], 0
            for i, text in enumerate(batch.column(1).to_pylist()):
                texts.append(reader.numbered(text))
                held += len(texts[-1])
                if held >= BATCH * STRIDE or i == batch.num_rows - 1:
                    found = pa.array([None if x is None else x.tolist() for x in reader.summaries(texts)], pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), found], [key, "summary"])
                    start, texts, held = i + 1, [], 0

    return docs.select(key, "text").mapInArrow(work, f"{key} {kind}, summary array<double>")


def own_summaries(docs: DataFrame, chosen: DataFrame, net: Network, toxic: np.ndarray, seen: np.ndarray) -> DataFrame:
    """(doc_id, y, summary) of the chosen documents with words, own counts left out."""
    sent = docs.sparkSession.sparkContext.broadcast((net, Sparse(toxic), Sparse(seen)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, toxic, seen = sent.value[0], *(t.values for t in sent.value[1:])
        reader = _Reader(net)
        for batch in few_rows(batches, 64):
            reader.reset()
            ids, tables, n = [], [[t[0]] for t in reader.tables], 1
            for y, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                number: dict[str, int] = {}  # each document's words have rows of their own
                ids.append(np.array([number.setdefault(w, n + len(number)) for w in words(text)], np.int32))
                if number:
                    for table, new in zip(tables, net.gates(net.inputs(list(number), without_own(toxic, seen, y, net.share))), strict=True):
                        table.append(new)
                    n += len(number)
            reader.tables = [[np.concatenate(t)] for t in tables]
            found = [None if x is None else x.tolist() for x in reader.summaries(ids)] if ids else []
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.float64()))], ["doc_id", "y", "summary"])

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")
    return rows.mapInArrow(work, "doc_id long, y int, summary array<double>").where("summary is not null")


def score(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, score) for every row of ``docs``."""
    if not net.fitted:
        return docs.select("doc_id", F.lit(float(net.share)).alias("score"))
    terms = [F.get("summary", F.lit(i)) * float(w) for i, w in enumerate(net.final)]
    return summaries(docs, net).select("doc_id", F.when(F.col("summary").isNull(), F.lit(float(net.share))).otherwise(1 / (1 + F.exp(-sum(terms[1:], terms[0])))).alias("score"))
