"""The pipeline's stages on a small copy of the tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weftline.llm import common, secrets, simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SF), name)
        out.append(docs)
    return out


def test_stages_keep_the_columns_and_only_lose_rows(stages):
    for before, after in zip(stages, stages[1:-1], strict=False):
        assert after.columns == stages[0].columns
        assert not {r[0] for r in after.select("doc_id").collect()} - {r[0] for r in before.select("doc_id").collect()}


def test_one_document_of_each_component_stays(stages):
    found = simhash.near_duplicates(stages[2])
    want = {r["component_id"] for r in found.collect()}
    assert {r["doc_id"] for r in stages[3].collect()} == want and stages[3].count() == len(want)


def test_no_secret_is_left(stages):
    assert secrets.find_secrets(stages[4]).where("spans <> ''").count() == 0
    assert stages[4].where(F.length("text") != F.col("n_chars")).count() == 0


def test_pieces_cover_the_documents(stages):
    pieces = stages[5].groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n"))
    assert pieces.where("n <> doc_tokens").count() == 0 and pieces.count() == stages[4].count()


def test_empty_and_odd_rows_pass_through(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", None, None, 0), (1, "", None, None, 0)], schema)
    for some in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            corpus_pipeline.written(stage(spark, some, SF), name).count()


def test_odd_rows_have_their_defined_results(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = [r["text"] for r in docs.join(spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 and doc_id > 0"), "doc_id").where("n_chars > 1500").limit(3).collect()]
    long = " ".join(f"w{i}x{i % 89}" for i in range(100_000))
    rows = [(7, good[0], "en", "a", 1), (7, good[1], "en", "a", 1), (None, good[2], None, None, None), (None, good[2], None, None, None), (9, good[0] + " end", "en", "b", 1), (10, long, "en", "a", 1), (11, None, "en", "a", 0), (12, "", "en", "a", 0)]
    few = spark.createDataFrame([(*r, "q", "f", "k", "z") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, q_text string, file string, kept string, fp string")
    after = [few]
    for name, stage in corpus_pipeline.STAGES[1:4]:  # what the classifier says of invented rows is not the point
        after.append(corpus_pipeline.written(stage(spark, after[-1], SF), name))
        assert after[-1].columns == few.columns
    ids = [sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in d.collect()) for d in after]
    assert ids[1] == [(False, 7), (False, 7), (False, 9), (False, 10), (True, 0), (True, 0)]
    assert ids[2] == ids[3] == [(False, 7), (False, 7), (False, 10), (True, 0)]
    pieces = corpus_pipeline.pack(spark, after[3], SF)
    assert pieces.select("doc_id", "doc_tokens").distinct().count() == 4


def test_run_leaves_only_its_result(spark):
    mark = common.mark_written()
    got = corpus_pipeline.run(spark, SF)
    assert [x._weftline_path for x in common._MADE[mark:]] == [got._weftline_path] and got.count()
