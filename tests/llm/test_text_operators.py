"""Operators that read one text at a time, against plain versions."""

import base64
import hashlib
import pickle
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from gridloom.llm import bpe, fingerprint, pii, quality, token_counts, toxicity

DOCS = [(1, "Mail a.b@x.org or +1 (555) 123-4567 now"), (2, None), (3, ""), (None, "null id 1.2.3.4"), (1, "again"), (5, "x" * 70000 + " y@z.de"), (6, "4111 1111 1111 1111")]


@pytest.fixture(scope="module")
def docs(spark):
    # a column named like an output must not get in the way
    return spark.createDataFrame([(*r, 0.5, "s", "en") for r in DOCS], "doc_id long, text string, score double, source string, lang string")


def plain_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 16 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_pii_base_matches_plain_patterns():
    rnd = random.Random(1)
    for _ in range(4000):
        text = "".join(rnd.choice("ab@@..1234567890- +()é%") for _ in range(rnd.randint(0, 70)))
        assert plain_spans(text) == [x[:3] for x in pii.spans_of(text) if x[0] in pii.BASE_KINDS]


def test_pii_checksums_and_context():
    kinds = lambda t: [x[0] for x in pii.spans_of(t)]
    assert kinds("IBAN DE89 3704 0044 0532 0130 00") == ["iban"]
    assert kinds("IBAN DE88 3704 0044 0532 0130 00") == []
    assert kinds("call 555-123-4567") == ["local_phone"]
    assert kinds("item 555-123-4567") == []


def test_pii_numbers_that_are_not_given_out():
    kinds = lambda t: [x[0] for x in pii.spans_of(t)]
    assert kinds("ssn 123-45-6789, ssn 899-01-0001") == ["ssn"] * 2
    assert kinds("ssn 000-12-3456 or 666-45-1234 or 900-12-3456 or 987-65-4321 or 123-00-4567 or 123-45-0000") == []
    assert kinds("call 212-555-0100") == ["local_phone"]
    assert kinds("call 112-555-0100 or 291-555-0100 or 911-555-0100 or 012-555-0100") == []
    assert kinds("IBAN GB82WEST12345698765432 ABCD") == kinds("IBAN NO93 8601 1117 947") == ["iban"]
    assert kinds("IBAN ZZ82WEST12345698765432") == kinds("IBAN GB82WEST1234569876543") == kinds("IBAN GB82WEST12345698765432X") == []


def plain_extras(text, base):
    """Every later kind against all spans before it, pair by pair."""
    out = list(base)
    places = {
        "iban": [(m.start(), m.start() + k) for m in re.finditer(r"(?<![A-Za-z0-9])DE[0-9]{2}", text) for k in range(22, 45) if (c := text[m.start() : m.start() + k].replace(" ", "")) and len(c) == 22 and re.fullmatch(r"DE[0-9]{2}( ?[A-Z0-9])+", text[m.start() : m.start() + k]) and re.match(r"(?![A-Za-z0-9])", text[m.start() + k :]) and int("".join(str(int(x, 36)) for x in c[4:] + c[:4])) % 97 == 1],
        "local_phone": [m.span() for m in pii._LOCAL_PHONE.finditer(text) if re.match(r"[2-9](?!11)[0-8]", re.sub("[^0-9]", "", m.group()))],
        "ssn": [m.span() for m in pii._SSN.finditer(text) if re.match(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)", m.group())],
    }
    for kind, found in places.items():
        for s, e in found:
            near = f"{text[max(0, s - pii.REACH) : s]} {text[e : e + pii.REACH]}".lower()
            hit = any(re.search(rf"(?<![a-z]){w}", near) for w in pii.CONTEXT[kind])
            if pii.PRIOR[kind] + 0.3 * hit >= pii.THRESHOLD and all(b <= s or e <= a for _, a, b in out):
                out.append((kind, s, e))
    return out


def test_pii_added_spans_pair_by_pair():
    rnd, kinds = random.Random(5), set()
    pieces = ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "212-555-0100", "(212) 555 0100", "+1 212-555-0100", "123-45-6789", "000-45-6789", "4111 1111 1111 1111", "call", "ssn", "bank", "x", ",", "1.2.3.4", "a@b.de", "999"]
    for _ in range(3000):
        text = "".join(rnd.choice(pieces) + rnd.choice(["", " ", " ", "-", " zz "]) for _ in range(rnd.randint(1, 9)))
        got = [x[:3] for x in pii.spans_of(text)]
        assert got == plain_extras(text, plain_spans(text)), text
        kinds |= {x[0] for x in got}
    assert kinds == set(pii.KINDS)


def test_pii_of_a_very_long_text():
    text = "call 212-555-0100, ssn 123-45-6789; " * 30_000  # over a million characters
    began = time.monotonic()
    found = pii.spans_of(text)
    assert [len([x for x in found if x[0] == k]) for k in pii.KINDS] == [0, 0, 0, 0, 0, 30_000, 30_000]
    assert time.monotonic() - began < 20


def test_pii_queries(spark, docs):
    got = {(r.doc_id, r.n_email): r for r in pii.summarize(docs).collect()}
    assert got[1, 1].spans.startswith("email:5:14,phone:18:")
    assert got[2, 0].base_sha256 == hashlib.sha256(b"").hexdigest()
    masked = pii.redact(docs)
    assert masked.columns == docs.columns and masked.count() == len(DOCS)
    assert "<email>" in masked.where("doc_id = 5").first().text
    assert pii.summarize(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(bpe.RANK_FILE), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_reference(reference):
    v, rnd = bpe.vocabulary(), random.Random(2)
    alphabet = "abcdefgh the  \n\t'sll'reé漢字²½1234.,!?-_\x1c\x85\xa0 ß😀"
    for _ in range(1500):
        s = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60)))
        assert v.encode(s).tolist() == reference.encode_ordinary(s)
        assert v.decode(v.encode(s)) == s.encode()
    s = "ab" * 20000
    assert v.encode(s).tolist() == reference.encode_ordinary(s)


def test_perfect_hash_is_minimal():
    keys = {f"k{i}".encode(): i for i in range(3000)}
    h = bpe.PerfectHash.build(keys)
    assert sorted(h.keys) == sorted(keys) and all(h.get(k) == i for k, i in keys.items())
    assert h.get(b"absent") is None


def test_bpe_round_trip(spark, docs):
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs.where("doc_id <> 1"))).collect()}
    assert back == {i: t or "" for i, t in DOCS if i not in (1, None)}
    rows = bpe.summarize(docs).collect()
    assert len(rows) == len(DOCS) and min(r.n_tokens for r in rows) == 0


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts_sum_to_the_whole(rule):
    v, rnd = bpe.vocabulary(), random.Random(4)
    for _ in range(200):
        text = "".join(rnd.choice("ab é漢 \n|") for _ in range(rnd.randint(1, 80)))
        a, b = sorted(rnd.sample(range(len(text) + 1), 2))
        ids = v.encode(text)
        spans = token_counts.token_spans(text, ids, v.lengths)
        rows = token_counts.allocate(*spans, [("x", a, b)], len(text), rule)
        assert abs(sum(r[1] for r in rows) - len(ids)) < 1e-9 and sum(r[2] for r in rows) == len(text)
        if rule == "first":
            assert sum(r[1] for r in rows if r[0] == "x") == sum(a <= s < b for s in spans[0])


def test_token_counts_majority_and_ties():
    starts, ends = np.array([0, 4]), np.array([4, 8])
    rows = token_counts.allocate(starts, ends, [("a", 0, 2), ("b", 2, 5), ("c", 5, 8)], 8, "majority")
    assert {r[0]: (r[1], r[3]) for r in rows} == {"a": (1, 1), "b": (0, 0), "c": (1, 1)}


def test_token_counts_rows(spark, docs):
    rows = token_counts.attribute(docs).collect()
    assert sum(r.section is None for r in rows) == 2  # the null and the empty text
    with pytest.raises(ValueError):
        token_counts.attribute(docs, rule="other")


def test_quality_separates_and_handles_odd_tables(spark, docs):
    good = [(i, f"Plain words go here, line {i}. " * (1 + i % 5), 1) for i in range(0, 120, 2)]
    bad = [(i, f"buy!! | now | {i} $$$ | " * (1 + i % 5), 0) for i in range(1, 120, 2)]
    table = spark.createDataFrame([x[:2] for x in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in good + bad] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality.train(table, labels)
    got = {r.doc_id: r.score for r in quality.score(table, model).collect()}
    assert all((got[i] >= 0.5) == (y == 1) for i, _, y in good + bad)
    kept = quality.keep_good(table, model)
    assert kept.columns == table.columns and kept.count() == len(good)
    none = quality.train(table, labels.limit(0))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}


def test_toxicity_learns_words_and_stems(spark, docs):
    rnd = random.Random(5)
    plain = ["".join(rnd.choice("aeiou") + rnd.choice("lmnrst") for _ in range(3)) for _ in range(150)]
    rows = []
    for i in range(400):
        y = int(i % 5 == 0)
        text = [rnd.choice(plain) for _ in range(rnd.randint(20, 200))]
        for k in rnd.sample(range(len(text)), 4) if y else ():
            text[k] = rnd.choice(["vilebad", "vilegross", "nastyone"])
        rows.append((i, " ".join(text), y))
    table = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    net = toxicity.train(table, labels)
    got = {r.doc_id: r.score for r in toxicity.score(table, net).collect()}
    assert np.mean([(got[i] >= 0.5) == (y == 1) for i, _, y in rows]) > 0.97
    odd = [r.score for r in toxicity.score(docs, net).collect()]
    assert len(odd) == len(DOCS) and all(0 <= s <= 1 for s in odd)
    assert not toxicity.train(table, labels.limit(0)).fitted


def test_toxicity_counts_all_but_the_held_out_fifth(spark):
    rnd = random.Random(6)
    rows = []
    for i in range(500):
        bucket, y = zlib.crc32(str(i).encode()) % 5, int(i % 4 == 0)
        text = [f"w{rnd.randint(0, 99)}" for _ in range(30)] + ["vile", f"only{bucket}"] * y
        rows.append((i, " ".join(text), y, bucket))
    table = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    net = toxicity.train(table, labels, sample=40)
    assert [net.z[toxicity.word_hash(f"only{k}")] > 0 for k in range(5)] == [False, True, True, True, True]

    # a document's own counts are left out of what the final step sees of it
    known = toxicity._labelled(labels, "toxic")
    toxic, seen = toxicity.statistics(table, known, net.share)
    own = next(r for r in rows if r[2] and r[3] == 1)
    got = toxicity.own_summaries(table, known.where(f"doc_id = {own[0]}"), net, toxic, seen).first()
    hashes, flat, _ = toxicity.score_keys(sorted(set(toxicity.words(own[1]))))
    for k in np.unique(np.r_[hashes, flat]):
        toxic[k], seen[k] = max(toxic[k] - 1, 0), max(seen[k] - 1, 0)
    less = toxicity.Network(net.weights, toxicity.suspicion(toxic, seen, net.share), net.share)
    expected = toxicity.summaries(table.where(f"doc_id = {own[0]}"), less).first()
    assert (got.doc_id, got.y) == (own[0], 1) and np.allclose(got.summary, expected.summary)


def test_toxicity_sends_tables_without_zeros(spark, monkeypatch):
    rows = [(i, f"plain words number w{i % 20}" + " vile nasty" * (i % 4 == 0), int(i % 4 == 0)) for i in range(200)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    sent, kind = [], type(spark.sparkContext)
    broadcast = kind.broadcast
    monkeypatch.setattr(kind, "broadcast", lambda self, value: sent.append(len(pickle.dumps(value))) or broadcast(self, value))
    net = toxicity.train(docs, labels, sample=60)
    got = {r.doc_id: r.score for r in toxicity.score(docs, net).collect()}
    assert all((got[i] >= 0.5) == (y == 1) for i, _, y in rows)
    assert len(sent) == 3 and max(sent) < 2_000_000  # whole tables would be up to 40 MB
    copy = pickle.loads(pickle.dumps(net))
    assert np.count_nonzero(net.z) and np.array_equal(copy.z, net.z) and copy.z.dtype == net.z.dtype
    assert all(np.array_equal(copy.weights[k], v) for k, v in net.weights.items()) and np.array_equal(copy.final, net.final)


@pytest.mark.parametrize("values", [[], [0], [7], [0] * 21, [5, 0, -3] * 7, list(range(1, 40))])
def test_sparse_tables_come_back_whole(values):
    for kind in (np.int64, np.float32):
        table = np.array(values, kind) * (1 << 20)
        got = pickle.loads(pickle.dumps(toxicity.Sparse(table))).values
        assert got.dtype == table.dtype and np.array_equal(got, table)


def test_toxicity_gradients():
    rng = np.random.default_rng(0)
    n = 3
    live = np.arange(toxicity.WINDOW) < np.array([[5], [9], [toxicity.WINDOW]])
    words = [[f"w{rng.integers(30)}" for _ in range(toxicity.WINDOW)] for _ in range(n)]
    parts = [toxicity.trigrams(w) for w in words]
    offset = np.cumsum([0, *(len(f) for f, _ in parts[:-1])])
    data = toxicity.Windows(np.arange(n), np.array([1, 0, 1]), rng.normal(size=(n, toxicity.WINDOW, 2)).astype(np.float32), rng.integers(0, 50, (n, toxicity.WINDOW)), live, np.concatenate([f for f, _ in parts]), np.concatenate([s + o for (_, s), o in zip(parts, offset)]))
    net = toxicity.Network(toxicity._start(), np.zeros(0), 0.5)
    for k in ("words", "chars"):
        net.weights[k] = rng.normal(size=net.weights[k].shape).astype(np.float32)
    y, rows = np.array([1.0, 0.0, 1.0], np.float32), np.arange(n)

    class Keep:
        random = staticmethod(lambda k: np.zeros(k))

    def loss():
        z = data.forward(net, rows)[0].astype(float)
        return np.mean(np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y))

    grads = toxicity._gradients(net, data, rows, y, Keep)
    for k in ("out", "query", "attend", "recur_f", "recur_b", "in_f", "bias_b"):
        w, g = net.weights[k], grads[k]
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = w[at]
        w[at] = old + 0.01
        up = loss()
        w[at] = old - 0.01
        down = loss()
        w[at] = old
        assert abs((up - down) / 0.02 - g[at]) < 0.02 * abs(g[at]) + 2e-4, k


def test_fingerprints_group_exactly(spark):
    rows = [(1, "Straße  Eins"), (2, "STRASSE eins\n"), (3, "other"), (4, None), (5, ""), (None, "Other"), (3, "other"), (7, "ﬁn"), (8, "fin")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = sorted((r.doc_id or 0, r.group_id) for r in fingerprint.exact_groups(docs).collect())
    assert groups == [(0, 3), (1, 1), (2, 1), (3, 3), (3, 3), (4, 4), (5, 4), (7, 7), (8, 7)]
    assert fingerprint.summarize(docs.limit(0)).count() == 0


def test_fingerprint_of_edited_texts(spark):
    rnd = random.Random(6)
    rows = [(i, "".join(rnd.choice("abé ") for _ in range(rnd.randint(0, 30)))) for i in rnd.sample(range(1000), 60)] + [(5000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r.doc_id: r for r in fingerprint.summarize(docs).collect()}
    ordered = sorted((i, t or "") for i, t in rows)
    assert len(got) == len(rows)
    for (i, t), (_, n) in zip(ordered, ordered[1:] + ordered[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)
        assert got[i].near_next == float(fingerprint.canonical(t) == fingerprint.canonical(n))


def test_fingerprints_of_many_rows_without_an_id(spark):
    rows = [(None, f"{i:05d}text" + "z" * (i % 50)) for i in range(400)] + [(7, f"{i:05d}shared") for i in range(1000, 1300)] + [(8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = fingerprint.against_next(docs.repartition(5)).collect()
    assert sorted((r.doc_id or 0, r.n_chars, r.fingerprint) for r in got) == sorted((i or 0, len(t or ""), fingerprint.fingerprint_of(t or "")) for i, t in rows)
    # the half that stays tells the texts apart, so each was edited once
    assert len({r.edited_sha256 for r in got}) == len(rows)


def test_samples_are_bounded_by_rows(spark, monkeypatch):
    rows = [(i, f"plain words number {i} and more of them") for i in range(60)] + [(6, f"another text of one id {i}") for i in range(500)] + [(7, "the same text again")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    seen = {}
    grow, fit = quality.grow, toxicity.fit
    monkeypatch.setattr(quality, "grow", lambda x, y: seen.update(quality=len(x)) or grow(x, y))
    monkeypatch.setattr(toxicity, "fit", lambda windows, *rest: seen.update(toxic=len(windows.y)) or fit(windows, *rest))
    quality.train(docs, labels, sample=40)
    toxicity.train(docs, labels, sample=40)
    assert 20 <= seen["quality"] <= 40 and 20 <= seen["toxic"] <= 40 * (toxicity.SUSPECT + toxicity.OTHER)
