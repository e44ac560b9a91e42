"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scour.session import materialize

#: Text held at once by a Python helper, in characters; longer documents are
#: handled whole, one at a time.
BATCH_CHARS = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan of one input table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the cluster's shared folder and read it back."""
    return materialize(df, name)


def id_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator works on; a null text is the empty text."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def text_blocks(batches: Iterator[pa.RecordBatch],
                chars: int = BATCH_CHARS) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) blocks of at most ``chars`` characters (one document at least)."""
    for batch in batches:
        ids, size = [], 0
        texts: list[str] = []
        column = batch.column(1)
        for i, d in enumerate(batch.column(0).to_pylist()):
            t = column[i].as_py() or ""
            if texts and size + len(t) > chars:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(d)
            texts.append(t)
            size += len(t)
        if texts:
            yield ids, texts
        del batch, column, texts
        pa.default_memory_pool().release_unused()        # the worker lives on, beside the next steps
