"""The pipeline's stages, each against a plain version of its rule."""

import collections

import corpus_pipeline
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        out.append((docs, docs := stage(spark, docs, SF).cache()))
    return out


def test_stages_return_documents(stages):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for before, after in stages[:-1]:
        assert after.columns == before.columns and after.count() <= before.count()


def test_quality_stage_keeps_what_labels_call_good(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = corpus_pipeline.quality(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir).join(labels, "doc_id")
    assert kept.where("quality = 1").count() >= 0.98 * labels.where("quality = 1").count()
    assert kept.where("quality = 0").count() <= 0.2 * labels.where("quality = 0").count()


def test_exact_stage_keeps_the_first_of_equal_texts(stages):
    before, after = stages[1]
    first = {}
    for r in before.collect():
        first[r.text] = min(first.get(r.text, r.doc_id), r.doc_id)
    assert {r.doc_id for r in after.collect()} == set(first.values())


def test_near_stage_keeps_one_of_each_class(stages):
    from tests.llm.test_dedup import near_by_force

    before, after = stages[2]
    want = {d for d, _, _, kept in near_by_force([(r.doc_id, r.text) for r in before.collect()]) if kept}
    assert {r.doc_id for r in after.collect()} == want


def test_decontamination_stage(spark, stages):
    from tests.llm.test_texts import contamination_by_force

    before, after = stages[3]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {d for d, _, hit, _ in contamination_by_force([(r.doc_id, r.text) for r in before.collect()], items) if not hit}
    assert {r.doc_id for r in after.collect()} == want


def test_packing_stage_holds_every_document(stages):
    before, after = stages[4]
    tokens, whole = collections.Counter(), {}
    for r in after.collect():
        tokens[r.doc_id] += r.length
        whole[r.doc_id] = r.doc_tokens
    assert tokens == whole and set(whole) == {r.doc_id for r in before.collect()}


def test_run_equals_the_stages(spark, stages):
    got = {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").distinct().collect()}
    assert got == {r.doc_id for r in stages[4][1].select("doc_id").distinct().collect()}


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None), (1, None, "en", "a", 0), (1, "", "en", "a", 0), (2, "word " * 20_000, None, None, None), (None, "some words", "en", "a", 10)]])
def test_stages_take_empty_tables_and_odd_rows(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert docs.count() >= len(rows) - 2


def test_rows_with_shared_or_no_ids_are_judged_by_their_own_texts(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(None, base), (None, base), (3, base + " more"), (3, base), (3, "a text of its own"), (None, item), (5, item), (5, "clean, but of an id that has a bad row"), (None, "clean and without an id")]
    docs = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    for _, stage in corpus_pipeline.STAGES[1:4]:
        docs = stage(spark, docs, SF).cache()
    assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr) == sorted([rows[2], rows[4], rows[7], rows[8]], key=repr)
