"""Interpolated modified Kneser-Ney bigram model, counted in Spark.

Tokens are words (runs of anything but ASCII white space, A-Z in lower case) and
one end for each text; the first token follows a start. Tasks count bigrams of
bounded runs of tokens and send them, packed, to buckets of hash ranges. The
number of buckets grows with the corpus, so a bucket does not grow past
``MOST_BYTES`` of text. A bucket's task writes its part of the model as sorted
hash arrays to the shared folder, under a name of its own and then renamed, so
that a repeated task does no harm. Workers map those files into memory and look
up whole batches of texts at once. The model knows which buckets were written; a
file that should be there and is not is an error, never a count of zero.

Bigrams go to the bucket of their context, so that what follows a context is
together. A context with as many tokens after it as ``LOADS`` buckets have on
average would make a bucket of its own far larger than others: such contexts, found
by a first count over all texts, go by the whole bigram, and what follows them is
summed in a second step.

Probability of w after u, with discounts D by count and c(u) bigrams from u::

    p(w|u) = max(c(uw) - D, 0) / c(u) + g(u) * p(w)
    p(w)   = max(k(w) - D', 0) / K + g' / (V + 1)

k(w) is the number of distinct tokens before w, K their sum, V the number of
distinct tokens; the weights g make both sum to one. After an unknown u the
probability is p(w).

Defined cases: null and empty texts have the end as their only token; without
training rows every token has probability 1; null and repeated ids are trained on
and scored like others; repeated rows count as often as they occur; a very long
text is counted and scored whole, in one piece; an empty table to score gives no
rows; other columns are ignored. The model folder must be a path that every
machine sees (``file:`` or a mounted store), anything else is an error; it stays,
since results are computed from it when they are asked for, and is the caller's
to remove.
"""

from __future__ import annotations

import functools
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import cut, shared_dir

END = np.uint64(xxhash.xxh3_64_intdigest(b" end"))
START = np.uint64(xxhash.xxh3_64_intdigest(b" start"))
#: Tokens that a task counts before it sends them on, and that one lookup takes.
RUN, LOOKUP = 2_000_000, 1_000_000
#: Bytes of text for each bucket of hash ranges, and the fewest buckets. From MANY
#: buckets on they grow to MOST_BYTES before there are more of them, as a lookup goes
#: to every bucket.
BUCKET_BYTES, FEWEST, MANY, MOST_BYTES = 2 << 20, 64, 1 << 10, 32 << 20
#: Files that a worker keeps mapped, under what systems allow: ten for each of 2048 buckets, and more.
MAPPED = 1 << 15
#: A context is heavy at so many buckets' loads, about.
LOADS = 8
_MIX = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the words of the whole text, then the end."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out[-1] = END
    return out


def bits_for(size: int) -> int:
    """Bits of a hash that tell the buckets of so many bytes of text apart."""
    return max(min(MANY, max(FEWEST, size // BUCKET_BYTES)).bit_length(), (size // MOST_BYTES).bit_length())


def _among(x: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which of ``x`` are in the sorted array ``held``."""
    if not len(held):
        return np.zeros(len(x), bool)
    return held[np.minimum(np.searchsorted(held, x), len(held) - 1)] == x


def pair_keys(u: np.ndarray, w: np.ndarray, bits: int, heavy: np.ndarray) -> np.ndarray:
    """Bigram keys: ``bits`` for the bucket, of the context or, if it is heavy, of both; the rest of both."""
    x = (u ^ (u >> np.uint64(31))) * _MIX + w
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    first = u if not len(heavy) else np.where(_among(u, heavy), x * _MIX, u)
    low = np.uint64((1 << (64 - bits)) - 1)
    return (first & ~low) | (x >> np.uint64(bits))


def _with_contexts(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    w = np.concatenate(texts)
    u = np.empty_like(w)
    u[1:] = w[:-1]
    u[np.cumsum([0, *map(len, texts[:-1])])] = START
    return u, w


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, first places and sums of counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], order[starts], np.add.reduceat(counts[order].astype(np.int64), starts) if len(keys) else np.zeros(0, np.int64)


_PACKED = "kind int, bucket int, a binary, b binary, c binary, d binary"
_UNI, _BI, _CONT, _STATS, _CTX, _HEAVY = 0, 1, 2, 3, 4, 5
#: The arrays of each kind.
_NAMES = {_UNI: "uni", _BI: "bi", _CONT: "cont", _CTX: "ctx", _HEAVY: "heavy"}


def _narrow(values: np.ndarray) -> np.ndarray:
    """The numbers as bytes, after one byte that says how wide each is."""
    small = values.astype(np.min_scalar_type(int(values.max(initial=0))))
    return np.concatenate([np.array([small.itemsize], np.uint8), small.view(np.uint8)])


def _wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"u{raw[0]}", offset=1)


def _pack(kind: int, bucket: int, *arrays: np.ndarray) -> tuple:
    return (kind, bucket, *(x.tobytes() for x in arrays), *[b""] * (4 - len(arrays)))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["kind", "bucket", "a", "b", "c", "d"])


def _by_bucket(keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """Slices of sorted keys by their first bits."""
    if not len(keys):
        return
    buckets = (keys >> np.uint64(64 - bits)).astype(np.int64)
    at = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]])
    for a, b in zip(at, [*at[1:], len(keys)], strict=True):
        yield int(buckets[a]), slice(int(a), int(b))


def _often(texts: list[np.ndarray], bits: int, loads: int) -> pa.RecordBatch:
    """(context, n, total): the contexts of over ``loads`` in 2**bits of these tokens."""
    u, _ = _with_contexts(texts)
    words, n = np.unique(u, return_counts=True)
    often = n << bits > loads * len(u)
    columns = [pa.array(words[often].view(np.int64)), pa.array(n[often].astype(np.int64)), pa.array(np.zeros(int(often.sum()), np.int64))]
    total = pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([0]), pa.array([len(u)])], ["context", "n", "total"])
    return pa.concat_batches([pa.RecordBatch.from_arrays(columns, ["context", "n", "total"]), total])


def _counted(texts: list[np.ndarray], bits: int, heavy: np.ndarray) -> list[tuple]:
    u, w = _with_contexts(texts)
    ones = np.ones(len(w), np.uint32)
    keys, first, n = _summed(pair_keys(u, w, bits, heavy), ones)
    u, v = u[first], w[first]
    out = []
    for bucket, s in _by_bucket(keys, bits):
        contexts, index = np.unique(u[s], return_inverse=True)
        out.append(_pack(_BI, bucket, contexts, _narrow(index), v[s], _narrow(n[s])))
    keys, _, n = _summed(w, ones)
    out += [_pack(_UNI, bucket, keys[s], _narrow(n[s])) for bucket, s in _by_bucket(keys, bits)]
    return out


def _save(folder: str, name: str, array: np.ndarray) -> None:
    """Write an array under its name; counts take the narrowest type they fit."""
    if array.dtype == np.int64:
        array = array.astype(np.min_scalar_type(int(array.max(initial=0))))
    part = f"{folder}/{name}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        np.save(f, array)
    os.replace(part, f"{folder}/{name}.npy")


def _of_counts(n: np.ndarray) -> np.ndarray:
    """How many counts are 1, 2, 3, 4, how many there are, and their sum."""
    return np.array([*((n == k).sum() for k in (1, 2, 3, 4)), len(n), n.sum()], np.int64)


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], list[tuple]]]:
    """The packed rows of each kind and bucket, from rows sorted by both."""
    held, parts = None, []
    for batch in batches:
        for kind, bucket, *data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held != (kind, bucket):
                if parts:
                    yield held, parts
                held, parts = (kind, bucket), []
            parts.append(data)
    if parts:
        yield held, parts


def _hashes(parts: list[tuple], place: int) -> np.ndarray:
    return np.concatenate([np.frombuffer(p[place], np.uint64) for p in parts])


def _counts(parts: list[tuple], place: int) -> np.ndarray:
    return np.concatenate([_wide(p[place]).astype(np.int64) for p in parts])


def _stats(kind: int, bucket: int, counts: np.ndarray) -> tuple:
    """What is left of a bucket's arrays: that they are there, and their counts of counts."""
    return _pack(_STATS, kind, np.array([bucket], np.int64), counts)


def _merge_bigrams(folder: str, bucket: int, parts: list[tuple], bits: int, heavy: np.ndarray) -> list[tuple]:
    u = np.concatenate([np.frombuffer(p[0], np.uint64)[_wide(p[1])] for p in parts])
    w = _hashes(parts, 2)
    keys, first, n = _summed(pair_keys(u, w, bits, heavy), _counts(parts, 3))
    _save(folder, f"bi_{bucket}", keys)
    _save(folder, f"bi_n_{bucket}", n)
    u, w = u[first], w[first]
    order = np.argsort(u, kind="stable")
    u, by = u[order], n[order]
    starts = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
    follow = np.stack([np.add.reduceat(x.astype(np.int64), starts) for x in (by == 1, by == 2, by > 2, by)], axis=1)
    contexts = u[starts]
    apart = _among(contexts, heavy)
    # the contexts of a bucket are its own, but for heavy ones that all buckets have a part of
    _save(folder, f"ctx_{bucket}", contexts[~apart])
    _save(folder, f"ctx_n_{bucket}", follow[~apart])
    out = [_stats(_BI, bucket, _of_counts(n)), _stats(_CTX, bucket, np.zeros(6, np.int64))]
    for b, s in _by_bucket(contexts[apart], bits):
        out.append(_pack(_HEAVY, b, contexts[apart][s], _narrow(follow[apart][s].ravel())))
    before, _, k = _summed(w, np.ones(len(w), np.uint32))
    return [*out, *(_pack(_CONT, b, before[s], _narrow(k[s])) for b, s in _by_bucket(before, bits))]


def _merge_contexts(folder: str, bucket: int, parts: list[tuple]) -> tuple:
    u = _hashes(parts, 0)
    n = np.concatenate([_wide(p[1]).astype(np.int64).reshape(-1, 4) for p in parts])
    order = np.argsort(u, kind="stable")
    u = u[order]
    starts = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
    _save(folder, f"heavy_{bucket}", u[starts])
    _save(folder, f"heavy_n_{bucket}", np.add.reduceat(n[order], starts, axis=0))
    return _stats(_HEAVY, bucket, np.zeros(6, np.int64))


def _merge_words(folder: str, bucket: int, parts: list[tuple], kind: int) -> tuple:
    words, _, n = _summed(_hashes(parts, 0), _counts(parts, 1))
    _save(folder, f"{_NAMES[kind]}_{bucket}", words)
    _save(folder, f"{_NAMES[kind]}_n_{bucket}", n)
    return _stats(kind, bucket, _of_counts(n))


def _gathered(stats: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By kind: the buckets that were written, and the sums of their counts.

    Each task sends one row for each kind, with eight bytes for each bucket.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for kind, a, b in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                held.setdefault(kind, []).append((np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)))
        yield _rows([_pack(_STATS, k, np.concatenate([x for x, _ in v]), np.sum([y for _, y in v], axis=0)) for k, v in held.items()])

    out = {k: (np.zeros(0, np.int64), np.zeros(6, np.int64)) for k in _NAMES}
    for r in stats.select("bucket", "a", "b").mapInArrow(work, _PACKED).collect():
        buckets, counts = out[r.bucket]
        out[r.bucket] = np.concatenate([buckets, np.frombuffer(r.a, np.int64)]), counts + np.frombuffer(r.b, np.int64)
    return out


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket")


def discounts(n: np.ndarray) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and more, from the counts of counts."""
    n1, n2, n3, n4 = (float(x) for x in n[:4])
    if not (n1 and n2):
        return np.array([0, 0.5, 0.75, 1.0])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0, *(min(max(x, 0.05), k) for k, x in zip((1, 2, 3), d, strict=True))])


@dataclass
class Model:
    """Where the arrays are, and the few numbers that hold for all of them."""

    folder: str
    bits: int
    heavy: np.ndarray
    bigrams: np.ndarray
    before: np.ndarray
    words: np.ndarray
    written: dict[str, np.ndarray]  # for each kind of array, a flag for each bucket

    def __post_init__(self):
        self.d2, self.d1 = discounts(self.bigrams), discounts(self.before)
        self.total, self.distinct = int(self.words[5]), int(self.words[4])
        n = self.before
        more = n[4] - n[0] - n[1]
        self.spare = float(self.d1[1:] @ [n[0], n[1], more]) / max(1, n[5])

    def _file(self, name: str) -> np.ndarray:
        return _mapped(f"{self.folder}/{name}.npy")

    def find(self, name: str, keys: np.ndarray) -> np.ndarray:
        """The numbers stored for sorted keys; zeros for those that are missing."""
        out = np.zeros((len(keys), 4) if name in ("ctx", "heavy") else len(keys), np.int64)
        for bucket, s in _by_bucket(keys, self.bits):
            if self.written[name][bucket]:
                held = self._file(f"{name}_{bucket}")
                if not len(held):
                    continue
                at = np.searchsorted(held, keys[s])
                at[at == len(held)] = 0
                hit = held[at] == keys[s]
                out[s][hit] = self._file(f"{name}_n_{bucket}")[at[hit]]
        return out

    def looked_up(self, name: str, keys: np.ndarray) -> np.ndarray:
        distinct, back = np.unique(keys, return_inverse=True)
        return self.find(name, distinct)[back]

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """For each text: tokens, known tokens, base score, model's score."""
        u, w = _with_contexts(texts)
        words, back = np.unique(w, return_inverse=True)
        c, k = self.find("uni", words), self.find("cont", words)
        base = np.log10((c + 0.5) / (self.total + 0.5 * (self.distinct + 1)))[back]
        low = ((k - self.d1[np.minimum(k, 3)]) / max(1, self.before[5]) + self.spare / (self.distinct + 1))[back] if self.total else np.ones(len(w))
        contexts = self.looked_up("ctx", u)
        split = _among(u, self.heavy)
        if split.any():
            contexts[split] = self.looked_up("heavy", u[split])
        n = self.looked_up("bi", pair_keys(u, w, self.bits, self.heavy))
        seen = np.maximum(contexts[:, 3], 1)
        weight = np.where(contexts[:, 3] > 0, contexts[:, :3] @ self.d2[1:] / seen, 1.0)
        high = (n - self.d2[np.minimum(n, 3)]) / seen
        starts = np.cumsum([0, *map(len, texts[:-1])])
        sums = [np.add.reduceat(x, starts) for x in ((c > 0)[back].astype(np.int64), base, np.log10(high + weight * low))]
        return np.stack([np.array(list(map(len, texts))), *sums], axis=1)


@functools.lru_cache(maxsize=MAPPED)
def _mapped(path: str) -> np.ndarray:
    return np.load(path, mmap_mode="r").view(np.ndarray)  # a plain array, as slices of the other kind are slow


def _local(folder: str) -> str:
    if "://" in folder or folder.startswith("file:"):
        scheme, _, rest = folder.partition(":")
        if scheme != "file":
            raise ValueError(f"workers map model files into memory and need a mounted folder, not {folder}")
        folder = "/" + rest.lstrip("/")
    return folder


def train(docs: DataFrame, folder: str | None = None) -> Model:
    """Count all rows of ``docs`` and write the model under ``folder``."""
    folder = f"{_local(folder or shared_dir(docs.sparkSession))}/lm-{uuid.uuid4().hex}"
    os.makedirs(folder)
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits = bits_for(size)

    def in_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        texts: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                texts.append(tokens(text))
                held += len(texts[-1])
                if held >= RUN:
                    yield texts
                    texts, held = [], 0
        if texts:
            yield texts

    # a context of twice that share has that share by the runs in which it is often
    loads = LOADS
    often = docs.select("text").mapInArrow(lambda batches: (_often(x, bits, loads) for x in in_runs(batches)), "context long, n long, total long")
    often = cut(often.groupBy("context").agg(F.sum("n").alias("n"), F.sum("total").alias("total")))
    total = often.agg(F.sum("total")).first()[0] or 0
    found = often.where(F.col("context").isNotNull() & (F.col("n") * 2**bits > loads * total)).select("context").collect()  # fewer than 2**bits
    heavy = np.sort(np.array([r.context for r in found], np.int64).view(np.uint64))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in in_runs(batches):
            yield _rows(_counted(texts, bits, heavy))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (kind, bucket), parts in _packs(batches):
            yield _rows(_merge_bigrams(folder, bucket, parts, bits, heavy) if kind == _BI else [_merge_words(folder, bucket, parts, _UNI)])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (kind, bucket), parts in _packs(batches):
            yield _rows([_merge_contexts(folder, bucket, parts) if kind == _HEAVY else _merge_words(folder, bucket, parts, _CONT)])

    merged = cut(_dealt(docs.select("text").mapInArrow(count, _PACKED)).mapInArrow(merge, _PACKED))
    rest = cut(_dealt(merged.where(F.col("kind").isin(_CONT, _HEAVY))).mapInArrow(follow, _PACKED))
    stats = _gathered(merged.where(f"kind = {_STATS}").unionByName(rest))
    written = {name: np.zeros(2**bits, bool) for name in _NAMES.values()}
    for kind, name in _NAMES.items():
        written[name][stats[kind][0]] = True
    return Model(folder, bits, heavy, stats[_BI][1], stats[_CONT][1], stats[_UNI][1], written)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) for every row of ``docs``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(ids: list, texts: list[np.ndarray]) -> pa.RecordBatch:
            x = model.score(texts)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(x[:, i].astype(np.int64)) for i in (0, 1)), *(pa.array(x[:, i]) for i in (2, 3))], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

        ids: list = []
        texts: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(doc_id)
                texts.append(tokens(text))
                held += len(texts[-1])
                if held >= LOOKUP:
                    yield out(ids, texts)
                    ids, texts, held = [], [], 0
        if ids:
            yield out(ids, texts)

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, n_tokens long, n_known long, base_score double, score double")
