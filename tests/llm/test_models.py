"""Models and their queries against plain versions, word by word and tree by tree."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import queries, quality, token_counts, toxicity


def test_network_forward_word_by_word():
    rng = np.random.default_rng(3)
    n, lengths = 3, (4, 9, toxicity.WINDOW)
    net = toxicity.Network(toxicity._start(), np.zeros(0), 0.5)
    gates = rng.normal(size=(2, toxicity.WINDOW, n, 3 * toxicity.HIDDEN)).astype(np.float32)
    live = (np.arange(toxicity.WINDOW)[:, None] < np.array(lengths)).astype(np.float32)[:, :, None]
    got = net.logits(gates[0], gates[1], live)
    w, h = {k: v.astype(float) for k, v in net.weights.items()}, toxicity.HIDDEN
    sigmoid = lambda v: 1 / (1 + math.exp(-v))

    def states(inputs, recur):
        state, out = [0.0] * h, []
        for g in inputs:
            mix = [sum(state[i] * recur[i][k] for i in range(h)) for k in range(3 * h)]
            z = [sigmoid(g[k] + mix[k]) for k in range(h)]
            r = [sigmoid(g[h + k] + mix[h + k]) for k in range(h)]
            new = [math.tanh(g[2 * h + k] + r[k] * mix[2 * h + k]) for k in range(h)]
            state = [(1 - z[k]) * state[k] + z[k] * new[k] for k in range(h)]
            out.append(state)
        return out

    for b, length in enumerate(lengths):
        ahead = states(gates[0, :length, b].astype(float), w["recur_f"])
        back = states(gates[1, :length, b].astype(float)[::-1], w["recur_b"])[::-1]
        both = [x + y for x, y in zip(ahead, back, strict=True)]
        e = [float(np.tanh(np.array(s) @ w["attend"]) @ w["query"]) for s in both]
        a = [math.exp(x - max(e)) for x in e]
        pooled = sum(np.array(s) * x / sum(a) for s, x in zip(both, a, strict=True))
        assert abs(float(pooled @ w["out"] + w["out_bias"][0]) - got[b]) < 1e-4


def test_windows_cover_whole_texts():
    for n in (0, 1, toxicity.WINDOW - 1, toxicity.WINDOW, toxicity.WINDOW + 1, 1000):
        starts = toxicity.window_starts(n)
        held = {k for s in starts.tolist() for k in range(s, min(n, s + toxicity.WINDOW))}
        assert held == set(range(n))


def test_trees_one_row_at_a_time():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 7))
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] * x[:, 1] > 0)).astype(float)
    trees = quality.grow(x, y, trees=25, depth=3)
    inner = trees.feature.shape[1]

    def plain(row):
        total = trees.base
        for feature, cut, leaf in zip(trees.feature.tolist(), trees.cut.tolist(), trees.leaf.tolist(), strict=True):
            node = 0
            while node < inner:
                node = 2 * node + (2 if row[feature[node]] > cut[node] else 1)
            total += leaf[node - inner]
        return 1 / (1 + math.exp(-total))

    assert np.allclose(trees.score(x), [plain(r) for r in x.tolist()])
    assert np.mean((trees.score(x) >= 0.5) == (y == 1)) > 0.85 and trees.score(x[:0]).shape == (0,)


def test_first_split_is_the_best_of_all():
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(200, 3)), 1)
    y = (x[:, 1] + 0.3 * rng.normal(size=200) > 0.3).astype(float)
    trees = quality.grow(x, y, trees=1, depth=1, rate=1.0, ridge=2.0, bins=64)
    p = y.mean()
    g, h = y - p, np.full(len(y), p * (1 - p))
    gain = lambda left: g[left].sum() ** 2 / (h[left].sum() + 2) + g[~left].sum() ** 2 / (h[~left].sum() + 2)
    best = max(((gain(x[:, f] <= c), f, c) for f in range(3) for c in np.unique(np.quantile(x[:, f], np.linspace(0, 1, 65)[1:-1])) if 1 < (x[:, f] <= c).sum() < 199), key=lambda t: t[0])
    left = x[:, trees.feature[0, 0]] <= trees.cut[0, 0]
    assert abs(gain(left) - best[0]) < 1e-9
    assert np.allclose(trees.leaf[0], [g[left].sum() / (h[left].sum() + 2), g[~left].sum() / (h[~left].sum() + 2)])


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_allocation_character_by_character(rule):
    rnd = random.Random(6)
    for _ in range(300):
        length = rnd.randint(1, 40)
        cuts = sorted({0, length, *(rnd.randint(0, length) for _ in range(rnd.randint(0, 12)))})
        tokens = list(zip(cuts, cuts[1:], strict=False))
        edges = sorted({rnd.randint(0, length) for _ in range(rnd.randint(0, 6))})
        sections = [(rnd.choice("xyz"), a, b) for a, b in zip(edges, edges[1:], strict=False) if rnd.random() < 0.7]
        # pieces of the text in order: the given sections and what lies between
        pieces, done = [], 0
        for name, a, b in sections:
            pieces += [(None, done, a)] * (a > done) + [(name, a, b)]
            done = b
        pieces += [(None, done, length)] * (done < length)
        expected = {}
        for name, a, b in pieces:
            expected.setdefault(name, [0.0, 0])[1] += b - a
        for a, b in tokens:
            held = [sum(p <= c < q for c in range(a, b)) for _, p, q in pieces]
            if rule == "split":
                for k, m in enumerate(held):
                    expected[pieces[k][0]][0] += m / (b - a)
            else:
                k = next(k for k, m in enumerate(held) if (m == max(held) if rule == "majority" else m))
                expected[pieces[k][0]][0] += 1
        starts, ends = (np.array(x) for x in zip(*tokens, strict=True))
        got = {r[0]: (r[1], r[2]) for r in token_counts.allocate(starts, ends, sections, length, rule)}
        assert got.keys() == expected.keys() and all(abs(got[k][0] - v[0]) < 1e-9 and got[k][1] == v[1] for k, v in expected.items())


def test_sections_by_line():
    text = "Head\na | b | c\n1 | 2 | 3\nplain\nmore"
    assert [(n, text[a:b]) for n, a, b in token_counts.line_sections(text)] == [("title", "Head\n"), ("table", "a | b | c\n1 | 2 | 3\n"), ("body", "plain\nmore")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables like the given ones, with the cases that operators must bear."""
    out = str(tmp_path_factory.mktemp("tables"))
    rnd = random.Random(9)
    words = ["".join(rnd.choice("aeiou") + rnd.choice("lmnrst") for _ in range(3)) for _ in range(200)]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 120))) + (" vile nasty rotten" if i % 4 == 0 else ""), "en", f"s{i % 3}") for i in range(120)]
    rows += [(200, None, None, None), (201, "", "en", "s0"), (None, "no id here", "en", "s1"), (3, rows[3][1], "en", "s0"), (202, "mail a@b.org " * 3000, "de", "s2"), (203, rows[5][1], "en", "s1")]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), 1.0, 2, "x", "y") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, `_row` string, `_n` string")
    docs.repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), int(i % 4 == 0)) for i in range(120)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([("i1", " ".join(rows[7][1].split()[:20])), ("i2", None), (None, "a b")], "item_id string, text string").write.parquet(f"{out}/benchmark.parquet")
    spark.createDataFrame([(1, "https://a.example.com/de/x", "<p>"), (2, None, None), (None, "", "")], "page_id long, url string, html string").write.parquet(f"{out}/pages.parquet")
    return out, rows


BUCKET = lambda i: 0 if i is None else zlib.crc32(str(i).encode()) % 5


@pytest.mark.parametrize("name,fold", [("op5_toxicity", 0), ("op7_quality", 0), ("op6_lm", 1)])
def test_scoring_queries(spark, folder, name, fold):
    got = queries.QUERIES[name](spark, folder[0]).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.held_out) for r in got) == sorted((i if i is not None else -1, BUCKET(i) == fold) for i, *_ in folder[1])
    if name != "op6_lm":
        least = 0.5 if name == "op5_toxicity" else 0.3
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= least) for r in got)
    else:
        texts = {i: t for i, t, *_ in folder[1]}
        assert all(r.n_tokens == len((texts[r.doc_id] or "").split()) + 1 for r in got)
        assert {r.train_tokens for r in got} == {sum(len((t or "").split()) + 1 for i, t, *_ in folder[1] if BUCKET(i) != 1)}
        assert all(r.n_known == r.n_tokens and r.score < 0 for r in got if not r.held_out)


def test_sharding_query(spark, folder):
    got = queries.op8_sharding(spark, folder[0]).collect()
    assert len(got) == len(folder[1]) and {(r.law, r.grown_shard) for r in got} == {("bytes", None)}
    assert sorted(r.size for r in got) == sorted(len((t or "").encode()) + 1 for _, t, *_ in folder[1])
    for s in range(16):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_text_queries(spark, folder):
    texts = sorted((i if i is not None else -1, t or "") for i, t, *_ in folder[1])
    bpe = queries.op2_bpe(spark, folder[0]).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.decoded_sha256) for r in bpe) == [(i, hashlib.sha256(t.encode()).hexdigest()) for i, t in texts]
    counts = queries.op9_token_counts(spark, folder[0]).groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.sum("n_chars").alias("c")).collect()
    both = {r.doc_id: (r.n, r.c) for r in counts}
    for r in bpe:
        if r.doc_id != 3:
            assert both[r.doc_id] == (r.n_tokens, len(dict(texts)[r.doc_id if r.doc_id is not None else -1]))
    found = {r.doc_id: r for r in queries.op1_pii(spark, folder[0]).collect()}
    assert found[202].n_email == 3000 and found[200].spans == ""
    marks = queries.op10_fingerprint(spark, folder[0]).collect()
    assert len(marks) == len(texts) and {r.group_id for r in marks if r.doc_id in (5, 203)} == {5}


def test_comparing_queries(spark, folder):
    near = {r.doc_id: (r.component_id, r.kept) for r in queries.op3_neardup(spark, folder[0]).collect()}
    assert near[203] == (5, False) and near[200] == (200, True) and near[None] == (None, True)
    hits = {r.doc_id: r for r in queries.op4_decontamination(spark, folder[0]).collect()}
    words = len((dict((i, t) for i, t, *_ in folder[1])[7] or "").split())
    assert hits[7].contaminated == (words >= 20 or words >= 13) or hits[7].n_words < 13
    assert hits[200].n_words == 0 and not hits[200].contaminated


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_of_empty_tables(spark, folder, tmp_path, name):
    for t in ("documents", "labels", "benchmark", "pages"):
        spark.read.parquet(f"{folder[0]}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0
