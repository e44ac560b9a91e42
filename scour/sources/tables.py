"""Driver table access: explicit parquet scans, one function per table family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


#: A scan of at most so many splits is dealt out anew: at the usual split size
#: that is under 256 MB, so the exchange stays small whatever the cluster.
FEW_SPLITS = 2


def spread(df: DataFrame) -> DataFrame:
    """One partition per core for a table of very few splits.

    A table stored as one large row group scans as one split, which would put
    all scan-side work (hashing, tokenising, distances) on one core. Larger
    tables are left as they are scanned. Catalyst prunes columns and pushes
    filters below the exchange, so only the needed columns move."""
    try:
        cores = df.sparkSession.sparkContext.defaultParallelism
        parts = df.rdd.getNumPartitions()
    except Exception:  # pragma: no cover - no RDD access (e.g. Spark Connect)
        return df
    return df.repartition(cores) if parts <= FEW_SPLITS < cores else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan of one driver table; Catalyst prunes columns and pushes filters."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))
