"""Quality classifier: histogram gradient-boosted trees over text statistics.

The trees are grown by numpy on a bounded sample of labelled rows (at most
``SAMPLE`` of them, those with the smallest hash of their id) and flattened into
arrays; every document is then scored by vectorised traversal in its own task.
Labels, language, source and id are no inputs of a score.

Defined cases: null and empty texts get the score of all-zero statistics; rows
with null ids are scored and count as held out; repeated rows get equal scores;
without labels of both kinds the score is the share of label 1, or 0.5 without
any label; a very long text is read whole; splits that tie go to the first
statistic and the lowest cut; an empty table gives no rows; other columns are
ignored by :func:`score`, kept by :func:`keep_good`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import crc_bucket, few_rows

#: Bound on the labelled rows that the trees are fitted on.
SAMPLE = 20_000
#: A document counts as good from this score on.
THRESHOLD = 0.3

_MARKS = [ord(c) for c in "!\"#$%&'()*+,-./:;<=>?@[]_{|}~"]
FEATURES = ["log_bytes", "log_words", "word_length", "upper", "lower", "digit", "space", "newline", "wide", "entropy", "distinct_words", "distinct_lines", "longest_line", "mean_line", "top_word", "marks", *(f"mark_{c:02x}" for c in _MARKS)]


def statistics(text: str | None) -> np.ndarray:
    """The inputs of a score, all from the whole text."""
    out = np.zeros(len(FEATURES))
    if not text:
        return out
    raw = text.encode("utf-8", "replace")
    n = len(raw)
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words, lines = raw.split(), raw.split(b"\n")
    share = seen[seen > 0] / n
    out[0], out[1] = np.log1p(n), np.log1p(len(words))
    out[2] = (n - seen[9:14].sum() - seen[32]) / max(1, len(words))
    out[3], out[4], out[5] = seen[65:91].sum() / n, seen[97:123].sum() / n, seen[48:58].sum() / n
    out[6], out[7], out[8] = seen[32] / n, seen[10] / n, seen[128:].sum() / n
    out[9] = -(share * np.log(share)).sum()
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    out[10] = len(counts) / max(1, len(words))
    out[11] = len(set(lines)) / len(lines)
    out[12], out[13] = np.log1p(max(map(len, lines))), np.log1p(n / len(lines))
    out[14] = max(counts.values(), default=0) / max(1, len(words))
    out[16:] = seen[_MARKS] / n
    out[15] = out[16:].sum()
    return out


@dataclass
class Trees:
    """Complete binary trees in heap order, as arrays."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:  # all rows are on one level
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 2.0) -> Trees:
    """Boost trees on the logistic loss; splits are sought over histograms."""
    inner, leaves = 2**depth - 1, 2**depth
    if not len(y) or y.min() == y.max():
        share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        return Trees(float(np.log(share / (1 - share))), np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    n, k = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(k)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(k)], axis=1)
    at = binned + np.arange(k) * bins
    share = y.mean()
    base = float(np.log(share / (1 - share)))
    total, rows = np.full(n, base), np.arange(n)
    feature, cut, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            wide, first = 2**level, 2**level - 1
            where = (node[:, None] * (k * bins) + at).ravel()
            gs, hs = (np.bincount(where, np.repeat(v, k), wide * k * bins).reshape(wide, k, bins).cumsum(2) for v in (g, h))
            ga, ha = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + ridge) + (ga - gs) ** 2 / (ha - hs + ridge) - ga**2 / (ha + ridge)
            gain[(hs < 1) | (ha - hs < 1)] = 0
            best = gain.reshape(wide, -1).argmax(1)
            for w in range(wide):
                f, b = divmod(int(best[w]), bins)
                if gain[w, f, b] > 1e-6 and b < len(edges[f]):
                    feature[t, first + w], cut[t, first + w] = f, edges[f][b]
            f, c = feature[t, first + node], cut[t, first + node]
            node = 2 * node + (x[rows, f] > c)
        gl, hl = np.bincount(node, g, leaves), np.bincount(node, h, leaves)
        leaf[t] = rate * gl / (hl + ridge)
        total += leaf[t][node]
    return Trees(base, feature, cut, leaf)


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", sample: int = SAMPLE) -> Trees:
    """Fit on labelled rows outside the held-out fifth, at most ``sample``."""
    chosen = labels.where((crc_bucket() != 0) & F.col("doc_id").isNotNull() & F.col(target).isNotNull()).groupBy("doc_id").agg(F.max(target).alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            x = [statistics(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.float64()), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    # an id may name many rows: equal ones count once, and the bound is one of rows
    got = rows.mapInArrow(work, "doc_id long, y double, x array<double>").distinct().orderBy(F.xxhash64("doc_id", "x"), "doc_id", "x").limit(sample).toArrow()
    order = np.argsort(got["doc_id"].to_numpy(), kind="stable")
    x = np.array(got["x"].to_pylist(), float).reshape(-1, len(FEATURES))[order]
    return grow(x, got["y"].to_numpy()[order])


def score(docs: DataFrame, model: Trees) -> DataFrame:
    """(doc_id, score) for every row of ``docs``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            x = np.array([statistics(t) for t in batch.column(1).to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that reach the threshold, with all their columns."""
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            x = np.array([statistics(t) for t in batch.column(at).to_pylist()]).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(work, docs.schema)
