"""The pipeline's stages on a small corpus, against plain versions of each."""

import hashlib
import random

import pytest

import corpus_pipeline
from gridloom.llm import bpe, pii
from test_corpus_operators import decontaminated, groups_by_brute_force, near_copies


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    rnd = random.Random(11)
    make = lambda n: " ".join(rnd.choice("river stone walks under old bridge while birds sing and wind turns".split()) + str(rnd.randint(0, 999)) for _ in range(n))
    items = [(f"i{k}", make(30)) for k in range(5)]
    texts = [make(80) for _ in range(60)] + near_copies(rnd, 12, 90, (0, 1)) + [f"{make(20)} {t} {make(20)}" for _, t in items]
    texts += [f"{make(40)} mail me at a{k}@site.org or +1 (555) 123-45{k:02d} now" for k in range(10)]
    junk = [" | ".join(f"!!{rnd.randint(0, 9)}$$" for _ in range(60)) for _ in range(40)]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(1000 + i, t, 0) for i, t in enumerate(junk)]
    docs = [(i, t, "en", "s", len(t)) for i, t, _ in rows] + [(3, texts[3], "en", "s", len(texts[3])), (None, make(30), None, None, None), (5000, None, None, None, None), (5001, "", "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, {i: t for i, t, _ in rows}, items


def test_stages(spark, corpus):
    folder, texts, items = corpus
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "decontamination", "personal_data", "bpe"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns

    good = stages["quality"](spark, docs, folder).cache()
    ids = [r.doc_id for r in good.collect()]
    assert good.columns == columns and not any(i and 1000 <= i < 2000 for i in ids)
    assert {i for i in texts if i < 1000} <= set(ids)

    kept = stages["near_duplicates"](spark, good, folder).cache()
    groups = groups_by_brute_force([(r.doc_id, r.text) for r in good.collect() if r.doc_id is not None], 80)
    expected = sorted({c for _, c in groups.values()})
    assert kept.columns == columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == expected
    assert kept.where("doc_id is null").count() == good.where("doc_id is null").count()

    clean = stages["decontamination"](spark, kept, folder).cache()
    bad = {r[0] for r in decontaminated([(r.doc_id, r.text) for r in kept.collect()], items) if r[5]}
    assert len(bad) == 5 and {r.doc_id for r in clean.collect()} == {r.doc_id for r in kept.collect()} - bad

    masked = stages["personal_data"](spark, clean, folder).cache()
    before = {r.doc_id: r.text for r in clean.collect()}
    for r in masked.collect():
        assert r.text == pii.redact_text(before[r.doc_id]) and (r.text is None or r.n_chars in (None, len(r.text)) or r.doc_id is None)
    assert masked.where("text like '%<email>%'").count() == 10

    out = {r.doc_id: r for r in stages["bpe"](spark, masked, folder).collect()}
    for r in masked.collect():
        assert out[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
        assert out[r.doc_id].n_tokens == len(bpe.vocabulary().encode(r.text))

    whole = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, folder).collect()}
    assert whole == {i: r.ids_sha256 for i, r in out.items()}


def test_empty_stages(spark, corpus):
    folder = corpus[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.count() == 0


def test_rows_that_share_or_lack_an_id(spark, tmp_path):
    rnd = random.Random(12)
    make = lambda n: " ".join(f"w{rnd.randint(0, 10**6)}" for _ in range(n))
    a, b, c, item = make(60), make(60), make(60), make(20)
    rows = [(1, a), (1, b), (2, c), (2, c), (3, a), (None, b), (None, c + " x"), (None, f"{make(9)} {item}"), (4, f"{make(9)} {item}"), (4, make(50)), (5, None), (5, ""), (5, " \n")]
    docs = spark.createDataFrame([(i, t, "k", 7, 8, 9) for i, t in rows], "doc_id long, text string, `_copy` string, `_KEY` int, `_key2` int, label int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("i", item)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert order((r.doc_id, r.text) for r in kept.collect()) == order([(1, a), (1, b), (2, c), rows[7], rows[8], rows[9], *rows[10:]])
    clean = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns
    assert order((r.doc_id, r.text) for r in clean.collect()) == order(r for r in rows if item not in (r[1] or ""))
