"""Registered queries of the operators in this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scour.llm.common import table
from scour.llm.oracle import ORACLE  # noqa: F401 - the driver reads both from here


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scour.llm import jaccard_join

    return jaccard_join.join_components(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scour.llm import quality_rules

    return quality_rules.apply_rules(table(spark, sf_dir, "documents"),
                                     table(spark, sf_dir, "labels"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scour.llm import warc_zip

    return warc_zip.round_trip(spark, table(spark, sf_dir, "pages"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scour.llm import decontaminate

    found = decontaminate.contaminated(table(spark, sf_dir, "documents"),
                                       table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"))


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scour.llm import html_extract

    return html_extract.extract(table(spark, sf_dir, "pages"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scour.llm import quality_classifier

    return quality_classifier.classify(table(spark, sf_dir, "documents"),
                                       table(spark, sf_dir, "labels"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scour.llm import bpe

    return bpe.digests(table(spark, sf_dir, "documents"), bpe.default_vocabulary())


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scour.llm import secret_scan

    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scour.llm import substring_dedup

    return substring_dedup.digest(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scour.llm import pii

    return pii.digest(table(spark, sf_dir, "documents"))


def op11_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scour.llm import seed_extend

    return seed_extend.digest(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scour.llm import periodic_runs

    return periodic_runs.digest(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scour.llm import merkle_manifest

    docs = table(spark, sf_dir, "documents")
    return merkle_manifest.verify(docs, merkle_manifest.tampered(docs))


QUERIES = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_quality_rules": op2_quality_rules,
    "op3_warc": op3_warc,
    "op4_decontaminate": op4_decontaminate,
    "op5_html_extract": op5_html_extract,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_bpe": op7_bpe,
    "op8_secret_scan": op8_secret_scan,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_pii": op10_pii,
    "op11_seed_extend": op11_seed_extend,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_merkle_manifest": op13_merkle_manifest,
}
