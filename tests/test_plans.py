"""Source pages and the end-to-end ingest plan."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from scour.operators import index as idx
from scour.plans.ingest import ingest, ingest_event, qa_documents
from scour.sources import qa
from tests.conftest import SF_SMALL


def test_source_pages_cover_all_rows_once(spark):
    conv = spark.read.parquet(f"{SF_SMALL}/conversations.parquet")
    q, a = qa.questions_from_conversations(conv), qa.answers_from_conversations(conv)
    total = qa.qa_pairs(q, a).count()
    seen = []
    for off in range(0, total + 7, 7):
        seen += sorted(r["question_id"] for r in qa.source_page(q, a, 7, off).collect())
    assert len(seen) == total and seen == sorted(set(seen))


def test_deep_pages_equal_positions(spark):
    n = 200_000
    q = spark.range(n).select(F.pmod(F.col("id") * 7919, F.lit(n)).alias("id"), F.lit("t").alias("title"),
                              F.lit("b").alias("body"), F.col("id").alias("accepted_answer_id"))
    a = spark.range(5).select("id", F.lit("a").alias("body"))
    for many, off in [(100, 0), (100, 125_000), (300, 199_900), (10, n)]:
        got = sorted(r["question_id"] for r in qa.source_page(q, a, many, off).collect())
        assert got == list(range(off, min(n, off + many)))


def test_wrong_width_ingest_writes_nothing_and_reports_rejects(spark):
    docs = spark.createDataFrame([(i, f"id{i}", f"text {i}") for i in range(20)],
                                 "ord long, doc_id string, text string")

    def embed(df, text):
        v = F.array(F.lit(1.0), F.lit(float("nan")), F.lit(0.0)).cast("array<float>")
        return df.withColumn("embedding", v).withColumn("error", F.lit(None).cast("string"))

    path = os.path.join(tempfile.mkdtemp(), "index")
    resp, _, rejects = ingest(spark, docs, path, order_col="ord", dim=64, embed=embed)
    assert json.loads(resp["body"])["results"] == 0 and rejects.count() == 20
    assert idx.index_dimension(spark, path) == 64 and idx.read_index(spark, path).count() == 0
    resp, _, rejects = ingest(spark, docs, os.path.join(tempfile.mkdtemp(), "i"), order_col="ord",
                              dim=3, embed=embed)
    assert {r["error"] for r in rejects.collect()} == {"null or NaN cell"}


def test_plugin_vectors_are_stored_with_unit_length(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "ord long, doc_id string, text string")

    def embed(df, text):
        return (df.withColumn("embedding", F.array(F.lit(3.0), F.lit(4.0)).cast("array<float>"))
                .withColumn("error", F.lit(None).cast("string")))

    path = os.path.join(tempfile.mkdtemp(), "index")
    event = {"number_of_records": "10", "batch_size": "1"}
    ingest_event(spark, docs, path, event, order_col="ord", dim=2, embed=embed)
    for r in idx.read_index(spark, path).collect():
        assert r["embedding"] == pytest.approx([0.6, 0.8])
    with pytest.raises(ValueError):
        ingest_event(spark, docs, path, {"batch_size": "many"}, order_col="ord", dim=2)


def test_ingest_twice_adds_nothing(spark):
    conv = spark.read.parquet(f"{SF_SMALL}/conversations.parquet")
    pairs = qa.qa_pairs(qa.questions_from_conversations(conv), qa.answers_from_conversations(conv))
    docs = qa_documents(pairs)
    path = os.path.join(tempfile.mkdtemp(), "index")
    resp, batches, rejects = ingest(spark, docs, path, order_col="question_id",
                                    number_of_records=1000, batch_size=10)
    n = json.loads(resp["body"])["results"]
    assert resp["statusCode"] == 200 and n == docs.select("doc_id").distinct().count()
    assert idx.read_index(spark, path).count() == n
    with_none = docs.filter(F.col("text").contains("Accepted Answer: None")).count()
    assert with_none > 0                         # dangling answers are indexed with None
    resp2, _, _ = ingest(spark, docs, path, order_col="question_id",
                         number_of_records=1000, batch_size=10)
    assert json.loads(resp2["body"])["results"] == 0
    assert idx.read_index(spark, path).count() == n


def test_ingest_stops_after_n(spark):
    conv = spark.read.parquet(f"{SF_SMALL}/conversations.parquet")
    pairs = qa.qa_pairs(qa.questions_from_conversations(conv), qa.answers_from_conversations(conv))
    path = os.path.join(tempfile.mkdtemp(), "index")
    resp, batches, _ = ingest(spark, qa_documents(pairs), path, order_col="question_id",
                              number_of_records=12, batch_size=5, offset=3)
    n = json.loads(resp["body"])["results"]
    assert 12 <= n < 12 + 5                      # stop is tested between batches
    assert [r["page_offset"] for r in batches.orderBy("batch_no").collect()] == [3, 8, 13]
