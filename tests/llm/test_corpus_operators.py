"""Operators over the whole corpus, against brute force."""

import collections
import hashlib
import math
import pathlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import common, decontaminate, lm, neardup, sharding


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def groups_by_brute_force(rows, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    above = {i: i for i in sets}

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = top(a), top(b)
                above[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


def near_copies(rnd, n, length, edits):
    base = [f"w{rnd.randint(0, 10**6)}" for _ in range(length)]
    out = []
    for _ in range(n):
        copy = list(base)
        for k in rnd.sample(range(length), rnd.randint(*edits)):
            copy[k] = f"x{rnd.randint(0, 10**6)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("small,tile", [(neardup.SMALL, neardup.TILE), (6, 10)])
def test_near_duplicates(spark, monkeypatch, small, tile):
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "TILE", tile)
    rnd = random.Random(7)
    texts = near_copies(rnd, 60, 300, (1, 9)) + near_copies(rnd, 50, 120, (2, 4)) + near_copies(rnd, 30, 60, (0, 1))
    texts += ["", None, "one two", "One  TWO", "one two three four five", " x y"] + ["same text over and over again"] * 5
    passage = " ".join(f"p{i}" for i in range(15))
    texts += [passage + " " + " ".join(f"r{rnd.randint(0, 10**6)}" for _ in range(40)) for _ in range(40)]
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, component_id int")
    expected = groups_by_brute_force(rows, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.mark(docs, 0.85).collect()}
    assert got == expected
    assert len({c for _, c in expected.values()}) < len(rows) - 30


def test_near_duplicates_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (9, "A b c d e F")], "doc_id long, text string")
    rows = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in neardup.mark(docs, 0.85).collect())
    assert rows == [(0, 0, True), (0, 0, True), (4, 4, True), (4, 4, True), (9, 4, False)]
    assert neardup.mark(docs.limit(0)).count() == 0


def test_near_duplicates_that_one_tree_parts(spark, monkeypatch):
    # all four values that the first tree may branch by first differ; another tree must hold the pair
    monkeypatch.setattr(neardup, "SMALL", 1)
    rnd = random.Random(1)
    while True:
        a, b = near_copies(rnd, 2, 60, (0, 0))
        words = a.split()
        words[rnd.randrange(10, 50)] = "other"
        b = " ".join(words)
        x, y = (neardup.sketch(neardup.shingles(t))[-1][neardup.TREES : neardup.TREES + neardup.CHOICE] for t in (a, b))
        if all(i != j for i, j in zip(x, y)):
            break
    docs = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    assert neardup.similar(neardup.shingles(a), neardup.shingles(b), 80)
    assert {r.component_id for r in neardup.mark(docs, 0.8).collect()} == {1}


def test_components_of_a_long_chain(spark):
    n = 40
    edges = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(n)] + [(b"z", b"y")], "a binary, b binary")
    got = {bytes(r.vertex): bytes(r.label) for r in neardup.components(edges).collect()}
    assert got == {bytes([i]): bytes([0]) for i in range(n + 1)} | {b"y": b"y", b"z": b"y"}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def decontaminated(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 12)) if w else ():
            windows.setdefault(tuple(w[k : k + 13]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if x := windows.get(tuple(w[s : s + n])):
                    found |= x - {None}
                    hit |= set(range(s, s + n))
        joined = ",".join(sorted(map(str, found)))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(joined.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_decontamination(spark):
    rnd = random.Random(3)
    make = lambda n, a: " ".join(rnd.choice(a) for _ in range(n))
    many, few = [f"w{i}" for i in range(60)], ["a", "B"]
    items = [(f"i{i}", make(rnd.choice([13, 14, 20, 40, 5, 3, 12]), many)) for i in range(25)]
    items += [("s1", "a b a b a b a b a b a b a b a"), (None, "w1 w2"), ("e", ""), ("n", None), ("z", "x y")]
    docs = []
    for d in range(100):
        parts = []
        for _ in range(rnd.randint(0, 6)):
            if rnd.random() < 0.5:
                t = (rnd.choice(items)[1] or "").split()
                a = rnd.randint(0, max(0, len(t) - 1))
                parts.append(("-" if rnd.random() < 0.3 else " ").join(t[a : rnd.randint(a, len(t))] if rnd.random() < 0.4 else t).upper())
            else:
                parts.append(make(rnd.randint(0, 40), many if rnd.random() < 0.8 else few))
        docs.append((d, ", ".join(parts)))
    docs += [(None, "a b"), (7, docs[7][1]), (900, None), (901, ""), (902, "é ü x y"), (903, "q " * 30000 + "x y")]
    left = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int")
    right = spark.createDataFrame(items, "item_id string, text string")
    assert sorted(map(tuple, decontaminate.summarize(left, right).collect()), key=str) == decontaminated(docs, items)
    assert decontaminate.summarize(left.limit(0), right).count() == 0
    assert decontaminate.summarize(left, right.limit(0)).where("contaminated").count() == 0
    plan = decontaminate.summarize(left, right)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_decontamination_without_broadcasts(spark, monkeypatch):
    rnd = random.Random(13)
    make = lambda n: " ".join(f"w{rnd.randint(0, 30)}" for _ in range(n))
    items = [(f"i{k}", make(rnd.choice([3, 13, 30]))) for k in range(20)]
    docs = [(d, " ".join(x for _ in range(3) for x in (make(8), rnd.choice(items)[1]))) for d in range(40)] + [(99, None)] * 2
    left, right = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    for grams, keys in ((10**6, 0), (0, 0)):
        monkeypatch.setattr(decontaminate, "BROADCAST_GRAMS", grams)
        monkeypatch.setattr(decontaminate, "BROADCAST_KEYS", keys)
        assert sorted(map(tuple, decontaminate.summarize(left, right).collect()), key=str) == decontaminated(docs, items)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_joins_of_hot_keys(spark, monkeypatch, how):
    monkeypatch.setattr(common, "LIGHT_ROWS", 5)
    rows = spark.createDataFrame([(i, 0 if i % 3 == 0 else i % 40) for i in range(600)] + [(1000, None)], "r long, k long")
    keys = rows.groupBy("k").agg(F.count("*").alias("_n"), F.min("r").alias("m")).where("k % 2 = 0")
    got, plain = common.join_keys(rows, keys, ["k"], "r", how), rows.join(keys.drop("_n"), ["k"], how)
    assert got.columns == plain.columns and sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
    assert common.join_keys(rows.limit(0), keys, ["k"], "r", how).count() == 0


def discounts(counts):
    n = [sum(1 for x in counts.values() if x == k) for k in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1])
    return [0, 1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]


@pytest.mark.parametrize("loads", [1, 8])
def test_language_model(spark, monkeypatch, loads):
    monkeypatch.setattr(lm, "LOADS", loads)  # at one bucket's load many contexts are heavy, at eight none here
    rnd = random.Random(8)
    vocabulary = [f"w{int(rnd.expovariate(0.02))}" for _ in range(4000)]
    rows = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randint(0, 80)))) for i in range(150)] + [(1000, None), (1001, "New words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = {i: [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), None] for i, t in rows}
    model = lm.train(docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1))
    uni, bi = collections.Counter(), collections.Counter()
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            uni.update(t)
            bi.update(zip([0, *t[:-1]], t))
    n, v = sum(uni.values()), len(uni)
    before = collections.Counter(w for _, w in bi)
    d2, d1 = discounts(bi), discounts(before)
    total = sum(before.values())
    spare = sum(d1[min(x, 3)] for x in before.values()) / total
    seen, weight = collections.Counter(), collections.Counter()
    for (u, _), c in bi.items():
        seen[u] += c
        weight[u] += d2[min(c, 3)]
    low = lambda w: (before[w] - d1[min(before[w], 3)]) / total + spare / (v + 1)
    assert abs(sum(low(w) for w in uni) + low("unseen") - 1) < 1e-9
    for r in lm.score(docs, model).collect():
        t = texts[r.doc_id]
        base = sum(math.log10((uni[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        score = sum(math.log10((bi[u, w] - d2[min(bi[u, w], 3)]) / seen[u] + weight[u] / seen[u] * low(w) if seen[u] else low(w)) for u, w in zip([0, *t[:-1]], t))
        assert r.n_tokens == len(t) and r.n_known == sum(uni[w] > 0 for w in t)
        assert abs(base - r.base_score) < 1e-8 and abs(score - r.score) < 1e-8
    assert (len(model.heavy) > 3) == (loads == 1)
    empty = lm.score(docs, lm.train(docs.limit(0))).agg(F.min("score"), F.max("score")).first()
    assert tuple(empty) == (0, 0)


def test_language_model_misses_no_file(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c a b"), (None, "b c"), (1, "a b c a b"), (2, "long " * 50000)], "doc_id long, text string")
    model = lm.train(docs, str(tmp_path))
    whole = [r.score for r in lm.score(docs, model).collect()]
    assert len(whole) == 4 and whole[0] == whole[2] and all(s < 0 for s in whole)
    assert lm.score(docs.limit(0), model).count() == 0
    for name in ("bi", "ctx"):
        for f in pathlib.Path(model.folder).glob(f"{name}_[0-9]*.npy"):
            f.unlink()
    lm._mapped.cache_clear()
    with pytest.raises(FileNotFoundError):
        model.score([lm.tokens("a b")])
    with pytest.raises(ValueError):
        lm.train(docs, "hdfs://somewhere/else")
    assert lm.bits_for(10**14) > 16 and 10**14 / 2 ** lm.bits_for(10**14) <= lm.MOST_BYTES


@pytest.mark.parametrize("size", [10**8, 10**9, 10**10, 6 * 10**10])
def test_workers_keep_a_whole_language_model_mapped(size):
    files = 2 * len(lm._NAMES) * 2 ** lm.bits_for(size)
    assert files <= lm._mapped.cache_parameters()["maxsize"]
    assert size / 2 ** lm.bits_for(size) <= lm.MOST_BYTES


def test_shards_keep_groups_whole_and_level(spark):
    rnd = random.Random(14)
    texts = [f"{i} " + "y" * int(rnd.expovariate(1 / 300)) for i in range(900)] + ["twice the same text"] * 2 + ["z" * 9000] * 3 + [None, "", "x" * 30000]
    docs = spark.createDataFrame([(i, t, f"s{i % 5}", "en", 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string, node int, size int")
    got = sharding.assign(docs, 8).collect()
    share = sum(r.size for r in got) / 8
    sizes = [sum(r.size for r in got if r.shard == s) for s in range(8)]
    assert max(sizes) - min(sizes) < 0.02 * share
    groups = collections.defaultdict(set)
    for r in got:
        groups[r.text_crc32, r.size].add(r.shard)
    assert {len(s) for s in groups.values()} == {1}
    moves = dict(sharding.levelled(np.array([100.0, 40.0]), [[(10, "a"), (50, "b"), (30, "c")], [(5, "d")]], 5))
    assert moves == {"c": 1}


def test_sharding(spark):
    rnd = random.Random(9)
    texts = ["x" * rnd.randint(0, 400) + str(i) for i in range(1500)] + ["copy of a text " * 3] * 30 + [None] * 5
    rows = [(i, t, rnd.choice(["s0", "s0", "s0", "s1", None]), rnd.choice(["en", "de"])) for i, t in enumerate(texts)] + [(None, "z", "s", "l"), (3, "repeated", "s", "l"), (3, "repeated", "s", "l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = sharding.assign(docs, 5).collect()
    assert len(got) == len(rows)
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, _, _ in rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert sorted(by) == list(range(5))
    sizes = [sum(r.size for r in x) for x in by.values()]
    assert max(sizes) - min(sizes) < 0.02 * sum(sizes)
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())
    copies = {r.shard for r in got if r.text_crc32 == zlib.crc32(("copy of a text " * 3).encode())}
    assert len(copies) == 1
    assert sharding.assign(docs.limit(0), 5).count() == 0
    assert sharding.assign(spark.createDataFrame([(1, "a", "s", "l")] * 50, docs.schema), 4).groupBy("shard").count().count() == 4


def plain_tree(rows, room, share, first=0):
    """The shard of each row, by one sorted walk over the rows of every node."""
    if len(room) == 1:
        return {r.row: first for r in rows}
    half = len(room) // 2
    widths = [max(r.dims[i] for r in rows) - min(r.dims[i] for r in rows) for i in range(3)]
    dim = widths.index(max(widths))
    want = sum(room[:half]) / sum(room) * sum(r.size for r in rows)
    left, right, done = [], [], False
    for _, group in itertools.groupby(sorted(rows, key=lambda r: (r.dims[dim], r.tie, r.row)), key=lambda r: (r.dims[dim], r.tie)):
        group = list(group)
        n = sum(r.size for r in group)
        if done:
            right += group
        elif n <= want:
            left += group
            want -= n
        elif n <= share:
            done = True
            (right if 2 * want < n else left).extend(group)
        else:
            done = True
            ends = itertools.accumulate(r.size for r in group)
            for r, end in zip(group, ends, strict=True):
                (left if end <= want else right).append(r)
    return plain_tree(left, room[:half], share, first) | plain_tree(right, room[half:], share, first + half)


@pytest.mark.parametrize("seed", (1, 2))
def test_tree_against_a_sorted_walk(spark, monkeypatch, seed):
    monkeypatch.setattr(sharding, "BINS", 16)
    rnd = random.Random(seed)
    texts = ["x" * int(rnd.expovariate(1 / 200)) + str(i) for i in range(600)] + ["one group " * 9] * 40 + ["of more than a share " * 20] * 150
    docs = spark.createDataFrame([(i, t, rnd.choice(["a", "a", "b", None]), rnd.choice(["en", "de", "fr"])) for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string")
    rows = sharding.cut(sharding.metadata(docs))
    room = np.array([1, 3, 2, 2, 4, 4, 1, 15])  # ratios of halves are exact
    share = sum(r.size for r in rows.collect()) / 8
    got = {r.row: r.node for r in sharding._tree(rows, room, share).collect()}
    assert got == plain_tree(rows.collect(), room.tolist(), share)
