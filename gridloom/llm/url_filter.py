"""Allow and block lists for urls: a trie over reversed host labels and path segments.

An entry is a host and a path, such as ``example.net/en/``: it fits urls of that
host and of all its subdomains whose path starts with the entry's. Of the entries
that fit, the longest decides, be it to allow or to block: the one with the longest
host, then the one with the longest path. Where both lists have the same entry it
blocks. Urls that no entry fits get the ``default``.

Lists of up to ``MOST_RULES`` entries and ``MOST_BYTES`` bytes, both counted before
anything is collected, are sent to the workers as a trie. Longer lists are joined: the
different urls meet the hosts of the list by each of their host's suffixes, then
its entries by the prefixes of their path that are as long as an entry's.

Defined results: a null url, or one without ``://``, has an empty host and path, and
no entry fits. Capitals A to Z of the host, and of an entry's host, count as small
letters; ports and user names are part of the host as written. Equal pages have equal
rows, one each; urls of any length are judged whole; an empty table gives no rows, an
empty list gives the default. Columns other than the id and the url are not looked at.
"""

from __future__ import annotations

import string

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import cut, join_keys

ALLOW, BLOCK = "allow", "block"
#: Lists beyond this are joined instead of being sent to the workers.
MOST_RULES, MOST_BYTES = 200_000, 16_000_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in small letters and path of a url; empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def entries(rules: DataFrame) -> DataFrame:
    """(rule, host, path, verdict) of rules (verdict, rule); of equal ones the one that blocks."""
    slash = F.instr("rule", "/")
    host = F.translate(F.when(slash > 0, F.substring("rule", F.lit(1), slash - 1)).otherwise(F.col("rule")), string.ascii_uppercase, string.ascii_lowercase)
    path = F.when(slash > 0, F.col("rule").substr(slash, F.length("rule"))).otherwise("")
    cut_up = rules.where("rule is not null").select("rule", host.alias("host"), path.alias("path"), "verdict").where("host <> ''")
    return cut_up.groupBy("host", "path").agg(F.max(F.struct("verdict", "rule")).alias("_r")).select("_r.rule", "host", "path", "_r.verdict")


class Trie:
    """Entries by reversed host labels, then by whole path segments and the rest of the path."""

    def __init__(self, found: list[tuple[str, str, str, str]]):
        self.top: dict = {}
        for rule, host, path, verdict in found:
            node = self.top
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            *whole, rest = path.split("/")
            node = node.setdefault("/", {})  # no label or segment holds a slash
            for segment in whole:
                node = node.setdefault(segment, {})
            node.setdefault("/", {})[rest] = (rule, verdict)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest entry that fits."""
        best, node = None, self.top
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if "/" in node:
                best = self._along(node["/"], segments) or best
        return best

    @staticmethod
    def _along(node: dict, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for k, segment in enumerate(segments):
            ends = node.get("/")
            if ends:
                best = next((ends[segment[:n]] for n in sorted({*map(len, ends)}, reverse=True) if segment[:n] in ends), best)
            node = node.get(segment) if k < len(segments) - 1 else None  # the last one is not followed by a slash
            if node is None:
                break
        return best


def _by_trie(urls: DataFrame, found: list[tuple[str, str, str, str]], default: str) -> DataFrame:
    trie = urls.sparkSession.sparkContext.broadcast(Trie(found))

    @F.pandas_udf("rule string, verdict string")
    def decide(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        at = [trie.value.find(h, p) or (None, default) for h, p in zip(host, path, strict=True)]
        return pd.DataFrame(at, columns=["rule", "verdict"], dtype=object)

    return urls.withColumn("_d", decide("host", "path")).select("*", "_d.rule", "_d.verdict").drop("_d")


def _counted(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """``keys`` with the number of ``rows`` that have each."""
    return keys.join(rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")), on)


def _by_joins(urls: DataFrame, found: DataFrame, default: str) -> DataFrame:
    urls, found = cut(urls), cut(found)
    each = cut(urls.groupBy("host", "path").agg(F.count(F.lit(1)).alias("_n")))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    spread = cut(each.select(F.col("host").alias("_host"), F.col("path").alias("_path"), F.explode(suffixes).alias("host")))
    hosts = found.groupBy("host").agg(F.collect_set(F.length("path")).alias("_lengths"))
    near = join_keys(spread, _counted(spread, hosts, ["host"]), ["host"], "_path")
    lengths = F.filter("_lengths", lambda n: n <= F.length("_path"))
    tried = cut(near.select("_host", "_path", "host", F.explode(lengths).alias("_k")).select("_host", "_path", "host", F.col("_path").substr(F.lit(1), F.col("_k")).alias("path")))
    fits = join_keys(tried, _counted(tried, found, ["host", "path"]), ["host", "path"], "_path")
    longest = F.max(F.struct(F.length("host").alias("h"), F.length("path").alias("p"), "rule", "verdict")).alias("_b")
    best = fits.groupBy("_host", "_path").agg(longest).select(F.col("_host").alias("host"), F.col("_path").alias("path"), "_b.rule", "_b.verdict")
    judged = join_keys(urls, each.join(best, ["host", "path"]), ["host", "path"], "_row", how="left")
    return judged.withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def judge(pages: DataFrame, rules: DataFrame, *, default: str = ALLOW, key: str = "page_id", url: str = "url", most_rules: int = MOST_RULES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(key, host, path, rule, verdict) of every page, by rules (verdict, rule)."""
    host, path = host_and_path(F.col(url))
    urls = pages.select(key, host.alias("host"), path.alias("path"))
    urls = urls.select(key, *(F.coalesce(c, F.lit("")).alias(c) for c in ("host", "path")))
    found = entries(rules)
    n, size = found.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("rule")), F.lit(0))).first()
    if n <= most_rules and size <= most_bytes:
        return _by_trie(urls, [tuple(r) for r in found.collect()], default)
    numbered = urls.withColumn("_row", F.monotonically_increasing_id())
    return _by_joins(numbered, found, default).select(key, "host", "path", "rule", "verdict")
