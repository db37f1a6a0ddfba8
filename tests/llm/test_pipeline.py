"""The pipeline's stages, each against brute force on its own input."""

import re

import corpus_pipeline
import pytest
from govlens.llm.quality import select_quality
from pyspark.sql import functions as F
from test_text_operators import ITEMS, TEXTS, brute_hits, brute_lines, components, shingles, whole_ids


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").cache()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def stage(name, spark, docs, folder):
    return dict(corpus_pipeline.STAGES)[name](spark, docs, folder)


def test_quality_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r.doc_id for r in select_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("kept").collect()}
    assert {r.doc_id for r in stage("quality", spark, docs, sf_dir).collect()} == kept and 0 < len(kept) < docs.count()


def test_line_dedup_stage(spark, docs, folder):
    found = {r.doc_id: (r.text, r.n_chars) for r in stage("line_dedup", spark, docs, folder).collect()}
    expected = {}
    for i, t in brute_lines(TEXTS).items():
        if t == TEXTS[i] or t.strip(" "):
            expected[i] = (t, len(t or ""))
    assert found == expected


def test_near_duplicates_stage(spark, docs, folder):
    sets = [shingles(t, 5) for t in TEXTS]
    root = components(len(TEXTS), lambda i, j: sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]))
    assert {r.doc_id for r in stage("near_duplicates", spark, docs, folder).collect()} == set(root)


def test_decontamination_stage(spark, docs, folder):
    clean = {i for i, hit in enumerate(brute_hits(TEXTS, ITEMS)) if not hit[4]}
    assert {r.doc_id for r in stage("decontamination", spark, docs, folder).collect()} == clean


def test_packing_stage(spark, docs, folder):
    packed = stage("packing", spark, docs, folder)
    assert {r.doc_id: r.n for r in packed.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == {i: len(whole_ids(t)) + 1 for i, t in enumerate(TEXTS)}


def test_stages_chain(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs
    for name, f in corpus_pipeline.STAGES[:-1]:
        after = f(spark, before, sf_dir).cache()
        assert after.dtypes == docs.dtypes, name
        assert 0 < after.count() <= before.count() and not after.join(before, "doc_id", "left_anti").count()
        before = after
    assert corpus_pipeline.run(spark, sf_dir).select("doc_id").distinct().count() == before.count()


def test_main_path_of_line_dedup_is_native(spark, docs, folder):
    plan = stage("line_dedup", spark, docs, folder)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_stages_with_clashing_columns_and_empty_tables(spark, docs, folder, tmp_path):
    clash = docs
    for name in ("n_lines", "n_deleted", "deleted_runs", "key", "kept", "region", "component_id", "window", "a.b"):
        clash = clash.withColumn(name, F.lit(7))
    labels = [(i, int(i % 3 > 0), 0) for i in range(0, len(TEXTS), 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, clash, folder)
        assert 0 < out.count()
        assert name == "packing" or out.columns == clash.columns
        assert not f(spark, clash.limit(0), folder).count()
