"""The registered corpus queries; each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bpe, decontaminate, fingerprint, lm, merkle, neardup, periodic, pii, quality, sharding, token_counts, toxicity, url_filter
from gridloom.llm.common import crc_bucket, table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summarize(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.summarize(table(spark, sf_dir, "documents"))


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.mark(table(spark, sf_dir, "documents"), 0.85)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.summarize(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, net)
    return scored.select("doc_id", (crc_bucket() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = lm.train(docs.where(crc_bucket() != 1))
    scored = lm.score(docs, model)
    return scored.select("doc_id", (crc_bucket() == 1).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", (crc_bucket() == 0).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.assign(table(spark, sf_dir, "documents"), 16)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.attribute(table(spark, sf_dir, "documents"))
    return counts.withColumn("n_tokens", F.col("n_tokens").cast("long"))


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.summarize(table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.summarize(table(spark, sf_dir, "documents"))


#: The entries that pages are judged by.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "verdict string, rule string"))


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.summarize(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_bpe": op2_bpe,
    "op3_neardup": op3_neardup,
    "op4_decontamination": op4_decontamination,
    "op5_toxicity": op5_toxicity,
    "op6_lm": op6_lm,
    "op7_quality": op7_quality,
    "op8_sharding": op8_sharding,
    "op9_token_counts": op9_token_counts,
    "op10_fingerprint": op10_fingerprint,
    "op11_merkle": op11_merkle,
    "op12_url_filter": op12_url_filter,
    "op13_periodic": op13_periodic,
}

_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORDS = f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{decontaminate._UPPER}', '{decontaminate._LOWER}'), '{_GAP}'), lambda x: x <> '')"

#: crc32 of the decimal id, one step for each bit
_CRC = """xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ord(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
          lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295)"""


def _leaf_sql(text: str) -> str:
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return f"sha256({' || '.join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in fields)})"


def _tree_sql(name: str, leaves: str, tree: str, digest: str) -> str:
    """Tables ``name`` of nodes by height, and ``name``_run of the digests of each run."""
    return f"""{name} AS (SELECT {tree} AS tree, 0 AS h, slot AS i, {digest} AS d, n FROM {leaves}
          UNION ALL SELECT tree, h + 1, i // 8, sha256(string_agg(d, '' ORDER BY i)), (n + 7) // 8 FROM {name} WHERE n > 1 GROUP BY tree, h, i // 8, n),
        {name}_run AS (SELECT tree, h, i // 8 AS r, list(d ORDER BY i) AS ds FROM {name} WHERE n > 1 GROUP BY tree, h, i // 8)"""


def _climb_sql(name: str, start: str, nodes: str) -> str:
    """Table ``name``: rows (k, tree, i, proof, fold) climbing one run at a time; ``top`` at the end."""
    left, right = "array_to_string(ds[1:i % 8], '')", "array_to_string(ds[i % 8 + 2:], '')"
    return f"""{name}_all AS ({start}
          UNION ALL SELECT k, c.tree, c.h + 1, i // 8, proof || {left} || {right}, sha256({left} || fold || {right}) FROM {name}_all c JOIN {nodes}_run s ON c.tree = s.tree AND c.h = s.h AND i // 8 = s.r),
        {name} AS (SELECT k, arg_max(tree, h) AS tree, arg_max(proof, h) AS proof, arg_max(fold, h) AS fold FROM {name}_all GROUP BY k)"""


ORACLE_SQL: dict[str, str] = {
    "op11_merkle": f"""
        WITH RECURSIVE l AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf_sql("text")} AS leaf,
          CASE WHEN {_CRC} % 3 = 0 THEN {_leaf_sql(f"translate(text, '{decontaminate._UPPER}', '{decontaminate._LOWER}')")} ELSE {_leaf_sql("text")} END AS start FROM documents),
        num AS (SELECT *, row_number() OVER (ORDER BY tree, doc_id NULLS FIRST, leaf) AS k, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS slot, count(*) OVER (PARTITION BY tree) AS n FROM l),
        {_tree_sql("up", "num", "tree", "leaf")},
        sub AS (SELECT tree AS key, d AS subroot, row_number() OVER (ORDER BY tree) - 1 AS slot, count(*) OVER () AS n FROM up WHERE n = 1),
        {_tree_sql("top", "sub", "''", "subroot")},
        {_climb_sql("low", "SELECT k, tree, 0 AS h, slot AS i, '' AS proof, start AS fold FROM num", "up")},
        {_climb_sql("high", "SELECT k, '' AS tree, 0 AS h, slot AS i, proof, fold FROM low JOIN sub ON low.tree = sub.key", "top")}
        SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified
        FROM num JOIN high ON num.k = high.k JOIN sub ON num.tree = sub.key, (SELECT d AS root FROM top WHERE n = 1)""",
    "op12_url_filter": f"""
        WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{decontaminate._UPPER}', '{decontaminate._LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        r AS (SELECT verdict, rule, split_part(rule, '/', 1) AS h, substr(rule, instr(rule, '/')) AS q FROM (VALUES {", ".join(map(str, URL_RULES))}) v(verdict, rule)),
        m AS (SELECT page_id, host, path, arg_max(rule, length(h) * 1000 + length(q)) AS rule, arg_max(verdict, length(h) * 1000 + length(q)) AS verdict
          FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY page_id, host, path)
        SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m ON p.page_id IS NOT DISTINCT FROM m.page_id AND p.host = m.host AND p.path = m.path""",
    "op4_decontamination": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
        win AS (SELECT item_id, list_slice(w, k, k + least(len(w), 13) - 1) AS g FROM i, LATERAL (SELECT unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS k) WHERE len(w) > 0),
        spot AS (SELECT doc_id, p, n, list_slice(w, p, p + n - 1) AS g FROM d, (SELECT DISTINCT len(g) AS n FROM win), LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS p)),
        hit AS (SELECT doc_id, p, n, item_id FROM spot JOIN win ON spot.g = win.g),
        pos AS (SELECT doc_id, count(DISTINCT p + o) AS n_hit FROM hit, LATERAL (SELECT unnest(range(n)) AS o) GROUP BY doc_id),
        its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hit GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
          coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN its ON d.doc_id = its.doc_id""",
}
