"""The registered queries: their SQL, the pipeline's stages, and the scale of their results."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.compare import differences, sql_connection
from tests.llm.plain import DOC_SCHEMA, prose
from vitrina.llm.minhash import near_duplicates
from vitrina.llm.mixing import mix_sources
from vitrina.llm.quality import host_rules
from vitrina.llm.queries import QUERIES, SQL

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    assert differences(spark, sql_connection(SF_DIR), QUERIES[name], SQL[name], SF_DIR) == []


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark, odd, none):
    docs = odd
    for (name, stage), names in zip(corpus_pipeline.STAGES, ["quality", "near-dedup", "pii", "mix", "pack"]):
        assert name == names
        before, docs = docs, corpus_pipeline.keep(stage(spark, docs, SF_DIR), "stage")
        if name != "pack":
            assert docs.columns == odd.columns
        if name == "quality":
            kept = host_rules(before).where("kept")
            assert sorted(r[0] or -1 for r in docs.select("doc_id").collect()) == sorted(r[0] or -1 for r in kept.select("doc_id").collect())
        if name == "near-dedup":
            assert docs.count() == docs.select("doc_id").distinct().count()
            assert near_duplicates(docs).where("not kept").count() == 0
            assert docs.count() == near_duplicates(before).select("component_id").distinct().count()
        if name == "pii":
            assert docs.count() == before.count()
        if name == "mix":
            want = {r[0]: r[1] for r in mix_sources(before).where("copies > 0").select("doc_id", "copies").collect()}
            assert {r[0]: r[1] for r in docs.groupBy("doc_id").count().collect()} == want
        if name == "pack":
            assert docs.where("piece = 0").count() == before.count()
            assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, none, SF_DIR).count() == 0
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF_DIR).count() == 0


def test_pipeline_keeps_texts_of_null_and_repeated_ids(spark):
    """No clean text is lost to another one's id, and none is multiplied by it."""
    shared, unique = prose(70, 90), [prose(71 + k, 90) for k in range(5)]
    rows = [(3, shared), (7, unique[0]), (7, shared), (7, unique[0]), (8, unique[1]), (8, unique[2]),
            (None, unique[3]), (None, unique[4]), (None, unique[4]), (None, ""), (None, ""), (None, None), (9, " ")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "size", "kept", "words", "row") for i, t in rows], DOC_SCHEMA)
    kept = corpus_pipeline.dedup(spark, docs, SF_DIR)
    want = Counter([(3, shared), (7, unique[0]), (8, unique[1]), (8, unique[2]), (None, unique[3]), (None, unique[4]), *rows[-4:]])
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == want
    # One source: the mix takes each document once.
    assert Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.mix(spark, corpus_pipeline.keep(kept, "kept"), SF_DIR).collect()) == want
