"""From raw documents to tokens: five stages over whole tables.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as
Parquet and read again as the next one's docs. What a stage takes out is named
by document ids, so texts are not shuffled to drop a document where the ids are
few enough to be broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scour.llm import bpe, decontaminate, jaccard_join, pii, quality_classifier
from scour.llm.common import stage, table

#: Document ids up to this many are broadcast (8 bytes each); more are shuffled.
BROADCAST_ROWS = 2_000_000


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` but those whose doc_id is in ``ids``; a null doc_id stays."""
    gone = stage(ids.select(F.col("doc_id").alias("_gone")).distinct(), "pipeline-gone")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. A doc_id that repeats goes
    if one of its rows is rejected."""
    scored = quality_classifier.classify(docs, table(spark, sf_dir, "labels"))
    return without(docs, scored.filter("predicted = 0"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of documents linked by 80 % of their 5-grams:
    that of the smallest doc_id, a repeated row of it once. Wordless documents are linked with
    nothing and stay."""
    grouped = stage(jaccard_join.join_components(docs, n=5, percent=80), "pipeline-groups")
    left = without(docs, grouped.filter("component_id != doc_id"))
    again = stage(grouped.filter("n_shingles > 0").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id"), "pipeline-repeated")
    if again.isEmpty():
        return left
    repeated = left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return without(left, again).unionByName(repeated.select(*docs.columns))


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, found)


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text."""
    out = pii.redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), and the SHA-256 of
    the ids and of the text decoded from them."""
    return bpe.encode(docs, bpe.default_vocabulary(), decoded=True).select(
        "doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality_classifier", quality),
    ("jaccard_join", near_duplicates),
    ("decontaminate", benchmark_free),
    ("pii", no_personal_data),
    ("bpe", tokens),
]

#: The stages are a trained model, an iterative join, hashed windows, patterns
#: with checks and a tokenizer: SQL can't express them; tests hold them against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
