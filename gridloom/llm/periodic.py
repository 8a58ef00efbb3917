"""Runs: stretches of words that repeat with a period at least four times over.

The suffixes of a text are sorted by prefix doubling, and the tree of its LCP
intervals is walked bottom up; every node of the tree stands for words that occur at
all positions of its list. Two positions from different children go on differently
to the right, and if their left words differ too they are a maximal pair: from the
first position to the end of the second one's common part, words repeat at the
distance of the two, and no neighbour goes on so. So a maximal pair whose distance is
at most a third of the common length is a run as it stands, and nothing is extended.

Positions are kept sorted, each of the class of its left word, and the shorter list
goes into the longer. A position looks to its neighbours in the other list only:
occurrences within a third of their length are one chain of steps of the smallest
period, so two that have the smallest period as their distance have none between
them. Pairs whose distance is a multiple of the period name the same stretch, of
which the smallest distance stays.

Parts of the tree are left out if they can hold no run: prefixes of fewer than five
words, and nodes below such a prefix whose positions are nowhere closer than a third
of the longest common part there.

Texts are worked on one at a time, whole, in Arrow tasks; a text of n words needs
memory of n times the logarithm of its longest repeat. Defined results: a null or
empty text has no words and no runs; equal rows get equal rows; an empty table gives
no rows; columns other than the id and the text are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import few_rows

#: A run has at least so many words, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: The fewest words that two positions of a run can share: periods 1 and 2 need 5 and 6.
LEAST_COMMON = min(max(LEAST_WORDS - q, (LEAST_PERIODS - 1) * q) for q in (1, 2))
#: Fixed value: what parts words.
SPACE = r"[\x20\x09-\x0D]+"


def numbers(words: list[bytes]) -> np.ndarray:
    """Equal words as equal numbers from 0."""
    known = dict.fromkeys(words)
    for k, w in enumerate(known):
        known[w] = k
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def repeats(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, what each shares with the next), where that may be LEAST_COMMON words.

    Ranks of 1, 2, 4, ... words are made until all are different; a rank is the place
    of the first suffix that has it, and only suffixes that share one are sorted on.
    The common part of two suffixes is then added up from the longest ranks down.
    """
    n = len(ids)
    count = np.bincount(ids)
    rank = (np.cumsum(count) - count)[ids] + 1
    active = np.flatnonzero(count[ids] > 1)
    ranks, width = [rank], 1
    while len(active):
        after = active + width
        key = rank[active] * (n + 2) + np.where(after < n, rank[np.minimum(after, n - 1)], 0)
        order = np.argsort(key)
        key, active = key[order], active[order]
        place = np.arange(len(active))
        whole = rank[active]
        of_rank = np.maximum.accumulate(np.where(np.r_[True, whole[1:] != whole[:-1]], place, 0))
        fresh = np.r_[True, key[1:] != key[:-1]]
        of_key = np.maximum.accumulate(np.where(fresh, place, 0))
        rank = rank.copy()
        rank[active] = whole + of_key - of_rank
        single = fresh & np.r_[fresh[1:], True]
        active = active[~single]
        ranks.append(rank)
        width *= 2
    if len(ranks) <= 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    suffixes = np.empty(n, np.int64)
    suffixes[rank - 1] = np.arange(n)
    four = ranks[2][suffixes]
    at = np.flatnonzero(four[1:] == four[:-1])
    a, b = suffixes[at], suffixes[at + 1]
    shared = np.zeros(len(at), np.int64)
    for k in range(len(ranks) - 2, -1, -1):  # the last ranks are all different
        x, y = a + shared, b + shared
        inside = (x < n) & (y < n)
        same = inside & (ranks[k][np.minimum(x, n - 1)] == ranks[k][np.minimum(y, n - 1)])
        shared += np.where(same, 1 << k, 0)
    common = np.zeros(n, np.int64)
    common[at] = np.where(shared >= LEAST_COMMON, shared, 0)
    return suffixes, common


def parts(suffixes: np.ndarray, common: np.ndarray) -> Iterator[tuple[list[int], list[int]]]:
    """(positions, common lengths between them) of the subtrees that may hold a run."""
    joined = common > 0
    held = joined | np.r_[False, joined[:-1]]
    at = np.flatnonzero(held)
    if not len(at):
        return
    starts = np.flatnonzero(np.r_[True, ~joined[at][:-1]])
    number = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(at)]))
    position = suffixes[at]
    longest = np.maximum.reduceat(common[at], starts)
    order = np.lexsort((position, number))
    gap = np.diff(position[order], prepend=-1)
    gap[starts] = len(suffixes)  # to the part before
    closest = np.minimum.reduceat(gap, starts)
    for k in np.flatnonzero(closest * (LEAST_PERIODS - 1) <= longest):
        a, b = starts[k], starts[k + 1] if k + 1 < len(starts) else len(at)
        yield position[a:b].tolist(), common[at[a : b - 1]].tolist()


def runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    if len(ids) < LEAST_WORDS:
        return []
    left = [-1, *ids[:-1].tolist()]
    found: dict[tuple[int, int], int] = {}

    def join(a: list[int], b: list[int], shared: int) -> list[int]:
        """Two children of a node with ``shared`` words, as one; notes their runs."""
        few, many = (a, b) if len(a) < len(b) else (b, a)
        far = shared // (LEAST_PERIODS - 1)
        for p in few:
            k = bisect_left(many, p)
            for x in many[max(k - 1, 0) : k + 1]:
                q = abs(p - x)
                if q <= far and q + shared >= LEAST_WORDS and left[p] != left[x]:
                    spot = (min(p, x), q + shared)
                    found[spot] = min(q, found.get(spot, q))
        if len(few) * 16 < len(many):
            for p in few:
                insort(many, p)
            return many
        return sorted(many + few)

    for positions, common in parts(*repeats(ids)):
        open_nodes: list[tuple[int, list[int]]] = []
        child = [positions[0]]
        for p, shared in zip(positions[1:], common, strict=True):
            while open_nodes and open_nodes[-1][0] > shared:
                deeper, before = open_nodes.pop()
                child = join(before, child, deeper)
            if open_nodes and open_nodes[-1][0] == shared:
                child = join(open_nodes.pop()[1], child, shared)
            open_nodes.append((shared, child))
            child = [p]
        while open_nodes:
            deeper, before = open_nodes.pop()
            child = join(before, child, deeper)
    return sorted((start, length, period) for (start, length), period in found.items())


def collapsed(words: list[bytes], spans: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without what repeats the first period of a run."""
    if not spans:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in spans:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[k] for k in np.flatnonzero(change.cumsum()[:-1] == 0).tolist()]


def detect(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, runs, collapsed): every text's runs, and the text without their repeats."""
    shape = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches, 64):
            spans, kept = [], []
            for text in batch["_text"]:
                words = (text.as_py() or b"").split()  # bytes part at the six spaces of ASCII alone
                own = runs(numbers(words))
                spans.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in own])
                kept.append(b" ".join(collapsed(words, own)))
            yield pa.RecordBatch.from_arrays([batch[key], pa.array(spans, shape), pa.array(kept, pa.binary())], [key, "runs", "collapsed"])

    rows = docs.select(key, F.col("text").cast("binary").alias("_text"))
    found = rows.mapInArrow(work, f"{key} {docs.schema[key].dataType.simpleString()}, runs array<struct<start:long,length:long,period:long>>, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the texts, by their id, repeat some of their words up to their end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(F.col("_h") % 10 == 0, F.filter(F.split("text", SPACE), lambda w: w != ""))
    rows = docs.select("doc_id", "text", h.alias("_h")).withColumn("_w", words)
    n, g = F.size("_w"), F.floor(F.col("_h") / 10).cast("long")
    rows = rows.withColumn("_a", F.when(n > 0, (g % n).cast("int"))).withColumn("_p", (F.lit(1) + F.floor((n - F.col("_a")) / (F.lit(3) + g % 8))).cast("int"))
    at = lambda i: F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p"))
    again = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("_w", at(i))), " ")
    return rows.select("doc_id", F.when(n > 0, again).otherwise(F.col("text")).alias("text"))


def strongest(spans: str) -> Column:
    """The run with most repeats; of equals the first, null without runs."""
    better = lambda a, b: F.when(a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"]), b).otherwise(a)
    return F.aggregate(spans, F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), better)


def summarize(docs: DataFrame) -> DataFrame:
    """The runs of the planted texts, and digests of all runs and of what is kept."""
    found = detect(planted(docs)).withColumn("_best", strongest("runs"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    exponent = F.floor(F.lit(1000) * F.col("_best.length") / F.col("_best.period")).cast("long")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "_best.start", "_best.length", "_best.period", exponent.alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
