"""Benchmark decontamination by winnowing, in DataFrame operations only.

Texts become arrays of words, and each word is hashed once. The hash of ``GRAM``
consecutive words combines their hashes; of every ``WINDOW - GRAM + 1``
consecutive such hashes the smallest is kept. Any ``WINDOW`` words that a
document and an item share hold the same kept hash in both, so a join of the kept
hashes finds every shared window. Each hit is extended: the words around it are
compared with the item's words in all windows that hold the gram, so a hash
collision never counts.

A document's grams are looked up first and tested for being kept second, since
nearly all fall out at the lookup; the words around a gram are cut out only for
what is left, and no row but the text's own holds the text. Beyond ``BROADCAST_GRAMS`` distinct grams of the benchmark the test
comes first and what is kept is joined by shuffle, with ``SALT`` copies of each
benchmark gram so that a gram that very many documents hold is spread.

Items of fewer than ``WINDOW`` words are one window; they are found by the hash
of as many words, for each length that occurs, and compared word by word.

Defined cases: null and empty texts, of documents or items, have no words;
repeated items count by their distinct ids, null item ids are left out of the
list; each document row has its own result, null and repeated ids included; a
very long text is looked up word by word and never copied whole; of equal hashes
in a stretch the leftmost is kept; an empty table of documents gives no rows, an
empty benchmark no hits; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import cut

WINDOW, GRAM = 13, 8
REACH = WINDOW - GRAM  # words on either side of a gram that a window can hold
#: Distinct benchmark grams up to this many are broadcast (some 30 bytes each),
#: and full benchmark rows up to this many (about 1 KB each).
BROADCAST_GRAMS, BROADCAST_KEYS = 1_000_000, 50_000
#: Parts that each gram's rows are dealt to when the join is a shuffle.
SALT = 16
#: Rows of benchmark keys that one task takes, about.
KEYS = 20_000
#: Gram of a text's own row, which is no hash of words; one that met it would fail the comparison.
ITSELF = 0
#: Word characters are all but ASCII ones that are no letter or digit.
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str = "text") -> Column:
    """The words, A-Z in lower case; an empty array for null."""
    plain = F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(plain, _GAP), "")


def _hashed(rows: DataFrame) -> DataFrame:
    """``w`` with the hashes ``h`` of its words."""
    return rows.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))


def _gram(at: Column, n: int, long: bool) -> Column:
    """Hash of the n words from ``at`` on; null if they are not all there."""
    parts = [F.get("h", at + k) for k in range(n)]
    return F.when((at >= 0) & (at + n <= F.size("h")), F.xxhash64(F.lit(0 if long else n), *parts))


def _spots(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """A row for each place and kind of gram: ``at``, ``n`` (0: to be winnowed), ``gram``.

    Places start at -1 with the gram ``ITSELF``, which stands for the text as such.
    """
    places = rows.select("*", F.explode(F.sequence(F.lit(-1), F.size("h"))).alias("at"))
    long = F.when(F.col("at") < 0, ITSELF).otherwise(_gram(F.col("at"), GRAM, True))
    if not lengths:
        return places.select("*", F.lit(0).alias("n"), long.alias("gram"))
    kinds = [F.struct(F.lit(0).alias("n"), long.alias("gram"))]
    kinds += [F.struct(F.lit(n).alias("n"), _gram(F.col("at"), n, False).alias("gram")) for n in lengths]
    return places.select("*", F.explode(F.array(*kinds)).alias("k")).select("*", "k.n", "k.gram").drop("k")


def _around(spots: DataFrame) -> DataFrame:
    """The words and hashes of all windows that hold the gram, in place of the whole text's.

    ``salt`` is a number of the row; a projection with such a number stays below
    the filters that follow, so none of them sees (and copies) a whole text.
    """
    start = F.when(F.col("n") > 0, F.col("at")).otherwise(F.greatest(F.col("at") - REACH, F.lit(0)))
    length = F.when(F.col("at") < 0, 0).when(F.col("n") > 0, F.col("n")).otherwise(GRAM + REACH + F.least("at", F.lit(REACH)))
    held = [c for c in spots.columns if c not in ("w", "h")]
    return spots.select(*held, F.slice("w", start + 1, length).alias("near"), F.slice("h", start + 1, length).alias("near_h"), F.pmod(F.monotonically_increasing_id(), F.lit(SALT)).alias("salt"))


def _kept() -> Column:
    """Whether the gram is the leftmost smallest of some stretch of grams around it."""
    size = REACH + 1
    own = F.least("at", F.lit(REACH))
    count = F.size("near_h") - GRAM + 1
    grams = F.transform(F.sequence(F.lit(1), count), lambda i: F.xxhash64(F.lit(0), F.slice("near_h", i, GRAM)))
    first = lambda g, o: o + F.array_position(F.slice(g, o, size), F.array_min(F.slice(g, o, size))) - 2
    inside = lambda g: F.exists(F.sequence(F.lit(1), count - size + 1), lambda o: first(g, o) == own)
    # the grams are bound once, as the only element of an array
    bound = F.exists(F.array(grams), inside)
    return F.when(F.col("n") > 0, True).when(count >= size, bound).otherwise(False)


def _aligned(pad: str) -> Column:
    """The words around a winnowed gram, filled up so that the gram has one place; ``pad`` is no word."""
    filled = F.concat(F.array_repeat(F.lit(pad), F.greatest(REACH - F.col("at"), F.lit(0))), F.col("near"), F.array_repeat(F.lit(pad), F.lit(REACH)))
    return F.when(F.col("n") > 0, F.col("near")).otherwise(filled)


def benchmark_keys(items: DataFrame) -> DataFrame:
    """(gram, n, item_id, item_near): kept grams of items with a window; short items whole, with n words."""
    base = items.select(F.col("item_id").cast("string").alias("item_id"), words().alias("w"))
    spots = _spots(_hashed(base.where(F.size("w") >= WINDOW)), []).where("at >= 0 and gram is not null")
    long = _around(spots).where(_kept() & (F.col("salt") >= 0))
    short = _hashed(base.where((F.size("w") > 0) & (F.size("w") < WINDOW)))
    whole = short.select(F.xxhash64(F.size("w"), "h").alias("gram"), F.size("w").alias("n"), "item_id", F.col("w").alias("item_near"))
    return long.select("gram", "n", "item_id", _aligned(" ").alias("item_near")).unionByName(whole)


def _candidates(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(_row, doc_id, n_words, at, n, near, near_h, item_id, item_near): grams that a
    document shares with the benchmark, and one row with ``at`` = -1 for each document."""
    lengths = sorted(r.n for r in keys.where("n > 0").select("n").distinct().collect())  # at most WINDOW - 1 numbers
    base = _hashed(docs.select("doc_id", words().alias("w")).withColumn("_row", F.monotonically_increasing_id()))
    spots = _spots(base.withColumn("n_words", F.size("w")), lengths)
    grams = keys.select("gram").distinct()
    if grams.count() <= BROADCAST_GRAMS:
        itself = keys.sparkSession.range(1).select(F.lit(ITSELF).cast("long").alias("gram"))
        found = _around(spots.join(F.broadcast(grams.unionByName(itself).distinct()), "gram"))
    else:
        found = _around(spots.where("gram is not null")).where((F.col("at") < 0) | _kept())
    few = keys.count() <= BROADCAST_KEYS
    # a text's own row has a key of its own, so that these rows are spread
    own = F.col("at") < 0
    found = found.withColumns({"gram": F.when(own, F.xxhash64("_row")).otherwise(F.col("gram")), "n": F.when(own, -1).otherwise(F.col("n"))})
    if few:
        return found.join(F.broadcast(keys), ["gram", "n"], "left")
    copies = keys.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    return found.join(copies, ["gram", "n", "salt"], "left")


def hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` with its hit words and items.

    Columns doc_id, n_words, n_hit, items (sorted ids).
    """
    joined = _candidates(docs, cut(benchmark_keys(items), KEYS)).withColumn("near", _aligned(""))
    short = F.col("n") > 0
    # windows that hold the gram: each starts so many words after the start of "near"
    starts = F.filter(F.sequence(F.lit(0), F.lit(REACH)), lambda o: F.slice("near", o + 1, WINDOW) == F.slice("item_near", o + 1, WINDOW))
    windows = F.transform(F.when(_kept(), starts), lambda o: F.col("at") - REACH + o)
    matched = F.when(short, F.when(F.col("near") == F.col("item_near"), F.array("at"))).otherwise(windows)
    spans = F.transform(F.when(F.col("item_near").isNotNull(), matched), lambda s: F.struct(s.alias("s"), (s + F.when(short, F.col("n")).otherwise(F.lit(WINDOW))).alias("e")))
    found = joined.select("_row", "doc_id", "n_words", "item_id", spans.alias("spans"))
    found = found.withColumn("item_id", F.when(F.size("spans") > 0, F.col("item_id")))
    merged = found.groupBy("_row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").cast("long").alias("n_words"), F.array_sort(F.collect_set("item_id")).alias("items"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("spans")))).alias("spans"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], acc["end"]))).alias("n"), F.greatest(acc["end"], x["e"]).alias("end")),
        lambda acc: acc["n"].cast("long"),
    )
    return merged.select("doc_id", "n_words", covered.alias("n_hit"), "items")


def contaminated() -> Column:
    """The contract's rule: some words are hit, and at least one in twenty."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def summarize(docs: DataFrame, items: DataFrame) -> DataFrame:
    return hits(docs, items).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), contaminated().alias("contaminated"))
