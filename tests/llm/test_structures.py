"""Merkle manifests, url entries and periodic runs against plain versions."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import merkle, periodic, queries, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, text):
    return h(*map(field, (r[0], r[3], r[2], r[4], text)))


def tree(nodes):
    """(root, [(left, right), ...] of every leaf), level by level."""
    where, paths = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for k, at in enumerate(where):
            run = nodes[at // 8 * 8 : at // 8 * 8 + 8]
            paths[k].append(("".join(run[: at % 8]), "".join(run[at % 8 + 1 :])))
        nodes, where = [h(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)], [at // 8 for at in where]
    return nodes[0], paths


def plain_manifest(rows):
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    langs = sorted(by, key=lambda v: (v is not None, (v or "").encode()))
    grown = {}
    for lang in langs:
        by[lang].sort(key=lambda x: x[:3])
        grown[lang] = tree([x[2] for x in by[lang]])
    root, tops = tree([grown[lang][0] for lang in langs])
    out = []
    for lang, above in zip(langs, tops, strict=True):
        subroot, paths = grown[lang]
        for (_, _, own, r), path in zip(by[lang], paths, strict=True):
            whole = path + above
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            d = leaf(r, r[1] if r[1] is None else re.sub("[A-Z]", lambda m: m[0].lower(), r[1])) if tampered else own
            for left, right in whole:
                d = h(left, d, right)
            out.append((r[0], own, subroot, root, h(*(a + b for a, b in whole)), d, d == root))
    return sorted(out, key=str)


def documents(rnd, n):
    langs = [None, "en", "en", "en", "en", "DE", "fr", "é", ""]
    return [(rnd.choice([None, k, k, k, 7]), rnd.choice([None, "", "Some Text", "plain", "Ünï AZ " * 3, f"T{k}"]), rnd.choice(langs), rnd.choice([None, "s"]), rnd.choice([None, k])) for k in range(n)]


@pytest.mark.parametrize("n,levels", [(0, 3), (1, 3), (7, 3), (700, 3), (300, 1), (130, 2)])
def test_manifest(spark, n, levels):
    rows = documents(random.Random(n), n)
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("leaf", F.lit(1)).withColumn("root", F.lit("x"))
    found = merkle.summarize(docs, levels)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == (plain_manifest(rows) if n else [])


def test_many_languages_and_a_long_text(spark):
    rows = [(k, "x" * (2_000_000 if k == 3 else k), f"l{k:03}", "s", k) for k in range(90)]
    assert sorted((tuple(r) for r in merkle.summarize(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == plain_manifest(rows)


def test_equal_rows_have_places_of_their_own(spark):
    rows = [(5, "A", "en", "s", 1)] * 20 + [(None, None, None, None, None)] * 3
    found = merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.tree, r.slot) for r in found) == [("", k) for k in range(3)] + [("=en", k) for k in range(20)]
    assert len({r.root for r in found}) == 1


def test_sweeps_keep_few_messages():
    nodes = merkle.forward([str(k) for k in range(100)], 3)
    assert [n[:2] for n in nodes[:10]] == [(1, k) for k in range(8)] + [(2, 0), (1, 8)]
    assert len(nodes) == 13 + 2 + 1
    paths = merkle.backward(nodes, 3, ["top"])
    assert len(paths) == 100 and all(p[3:] == ["top"] for p in paths.values())


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
    return re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]


def plain_verdict(url, rules, default):
    host, path = parts(url)
    best = None
    for verdict, rule in rules:
        name, slash, rest = rule.partition("/")
        name, rest = name.lower(), slash + rest
        if name and (host == name or host.endswith("." + name)) and path.startswith(rest):
            best = max(best or (-1,), (len(name), len(rest), verdict, rule))
    return host, path, best and best[3], best[2] if best else default


URLS = [
    None, "", "no scheme.net/", "http://net/", "http://net", "https://A.Example.NET/en/x?q#f", "http://example.net/EN/", "http://example.net/en", "ftp://x://y.net/a", "http://notnet/", "http://.net/",
    "http://net./", "http://example.com/de/1", "http://www.example.com/de?x", "http://example.com:80/de/", "http://a.org/fr/", "http://org/fr/", "http://a.org/fr", "http://?net/", "http://a.net?/x", "http://é.net/ü/", "://net//", "http://a.net/en/b/c", "http://x\ny.net/\n/",
]


def test_urls_of_the_query(spark):
    rows = [(k, u, "<html>") for k, u in enumerate(URLS)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(0)).withColumn("verdict", F.lit(0))
    found = url_filter.judge(pages, spark.createDataFrame(queries.URL_RULES, "verdict string, rule string"))
    assert found.columns == ["page_id", "host", "path", "rule", "verdict"]
    expected = [(k, *plain_verdict(u, queries.URL_RULES, "allow")) for k, u, _ in rows]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str)


@pytest.mark.parametrize("most", [url_filter.MOST_RULES, 0])
def test_random_entries_by_trie_and_by_joins(spark, most):
    rnd = random.Random(5)
    host = lambda: ".".join(rnd.choice(["a", "b", "net", "", "x1"]) for _ in range(rnd.randint(1, 4)))
    path = lambda: "".join("/" + rnd.choice(["", "en", "e", "en1", "de"]) for _ in range(rnd.randint(0, 4)))
    rules = [(rnd.choice(["allow", "block"]), host() + path()) for _ in range(150)] + [("allow", "B.net/en"), ("block", "b.net/en"), ("block", "/x"), ("block", "")]
    rows = [(k % 350, f"http://{host()}{path()}{rnd.choice(['', '?a', '#b'])}") for k in range(400)] + [(900, None)] * 50
    pages = spark.createDataFrame(rows, "page_id long, url string")
    found = url_filter.judge(pages, spark.createDataFrame(rules, "verdict string, rule string"), default="block", most_rules=most).collect()
    expected = [(k, *plain_verdict(u, rules, "block")) for k, u in rows]
    # of entries that differ only in capitals either may be named
    short = lambda r: (r[0], r[1], r[2], r[3] and r[3].lower(), r[4])
    assert sorted(map(short, found), key=str) == sorted(map(short, expected), key=str)


def test_no_entries_and_no_pages(spark):
    none = spark.createDataFrame([], "verdict string, rule string")
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert [tuple(r) for r in url_filter.judge(pages, none, default="block").collect()] == [(1, "a.net", "/", None, "block")]
    assert url_filter.judge(pages.limit(0), none, most_rules=-1).collect() == []


def plain_runs(w):
    n, found = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            k = i
            while k + q < n and w[k] == w[k + q]:
                k += 1
            if k > i and k - i + q >= max(6, 4 * q):
                found.setdefault((i, k - i + q), q)
            i = max(k, i + 1)
    return sorted((s, length, q) for (s, length), q in found.items())


def periodic_words(rnd):
    kind, letters = rnd.randint(0, 4), "ab" if rnd.random() < 0.5 else "abcdef"
    if kind == 0:
        return rnd.choices(letters, k=rnd.randint(0, 120))
    if kind == 1:
        return sum((rnd.choices(letters, k=rnd.randint(1, 5)) * rnd.randint(1, 9) for _ in range(rnd.randint(1, 8))), [])
    if kind == 2:
        return ["a"] * rnd.randint(0, 150)
    if kind == 3:  # repeats of repeats
        inner = rnd.choices(letters, k=rnd.randint(1, 3)) * rnd.randint(1, 6) + rnd.choices(letters, k=rnd.randint(0, 3))
        return (inner * rnd.randint(1, 8) + rnd.choices(letters, k=rnd.randint(0, 4))) * rnd.randint(1, 4)
    base = rnd.choices("abcdefghij", k=rnd.randint(10, 40))
    return rnd.choices(letters, k=rnd.randint(0, 20)) + base * rnd.randint(3, 7) + base[: rnd.randint(0, 9)]


def test_runs_of_random_words():
    rnd = random.Random(11)
    seen = 0
    for _ in range(3000):
        w = [c.encode() for c in periodic_words(rnd)]
        got = periodic.runs(periodic.numbers(w))
        assert got == plain_runs(w), w
        seen += len(got)
    assert seen > 2000


def test_runs_of_very_long_texts():
    rng = np.random.default_rng(1)
    word = lambda n: [b"%d" % v for v in rng.integers(0, 10**6, n)]
    w = word(5000) + word(40_000) * 5 + [b"x"] * 100_000 + [b"a", b"b"] * 3 + word(10)
    found = periodic.runs(periodic.numbers(w))
    assert (5000, 200_000, 40_000) in found and (205_000, 100_000, 1) in found and (305_000, 6, 2) not in found
    assert len(periodic.collapsed(w, found)) == 5000 + 40_000 + 1 + 6 + 10


def plain_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc_id is not None and n and (crc := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = crc // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    kept = " ".join(x for k, x in enumerate(w) if k not in gone)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], h(lines), h(kept))


def test_query_rows(spark):
    rnd = random.Random(3)
    texts = ["".join(c + rnd.choice([" ", "\t", "\n\x0b ", "\x0c\r"]) for c in periodic_words(rnd)) for _ in range(300)]
    rows = [*enumerate(texts), *enumerate(texts[:40]), (None, "a a a a a a a"), (None, None), (3, None), (10, ""), (20, " \x1c\x85\u00a0 \u2003 x\u3000x "), (30, "ü " * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit("x")).withColumn("collapsed", F.lit(2))
    found = periodic.summarize(docs)
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted((plain_row(*r) for r in rows), key=str)
    assert sum(zlib.crc32(str(k).encode()) % 10 == 0 for k in range(300)) > 10
    assert periodic.summarize(docs.limit(0)).collect() == []


def test_real_outputs(spark):
    docs = spark.createDataFrame([("k", "one a b a b a b a b two"), ("l", None)], "name string, text string")
    found = {r["name"]: r for r in periodic.detect(docs, "name").collect()}
    assert [tuple(r) for r in found["k"].runs] == [(1, 8, 2)] and found["k"].collapsed == "one a b two"
    assert found["l"].runs == [] and found["l"].collapsed == ""
