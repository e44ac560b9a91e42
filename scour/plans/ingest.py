"""Ingest plan: source pairs -> documents -> skip stored -> embed -> index.

``ingest`` is the batch form of the paged ingest loop; the streaming form is
``scour.streaming.ingest_stream``. Both write through the same keyed index.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scour.functions.text import content_id, document_text
from scour.operators.embed import DEFAULT_DIM, checked, hash_embedder
from scour.operators.index import (append_rows, create_if_missing, index_dimension, stored_among,
                                   to_index_rows, upsert)
from scour.operators.ingest import batch_plan
from scour.session import Stages, materialize


def qa_documents(pairs: DataFrame) -> DataFrame:
    """One document per accepted pair: ``question_id, doc_id, text``."""
    text = document_text("question_title", "question_body", "accepted_answer_body")
    return pairs.select("question_id", text.alias("text")).withColumn("doc_id", content_id("text"))


def default_embedder(dim: int = DEFAULT_DIM, max_chars: int | None = None):
    return hash_embedder(dim, max_chars)


def number(value, default: int) -> int:
    """An event's integer parameter: missing gives the default, a number or
    numeric text its value; anything else fails."""
    return default if value is None else int(value)


def ingest(spark: SparkSession, docs: DataFrame, index_path: str, *, order_col: str,
           number_of_records=1000, batch_size=100, offset=0,
           dim: int = DEFAULT_DIM, embed=None, run_id: int = 0, keyed_write: bool = False):
    """Index up to ``number_of_records`` new documents (see ``batch_plan``).

    ``docs`` has ``order_col``, ``doc_id`` and ``text``. The index is created
    with the vector width; vectors of another width, or with NULL or NaN cells,
    are rejects, the others are stored with unit length. Returns
    ``(response dict, batches DataFrame, rejects DataFrame)``; the batch report
    and the rejects are read back from the shared folder.
    """
    create_if_missing(spark, index_path, dim)
    dim = index_dimension(spark, index_path) or dim
    stages = Stages(spark)

    def stored(rows: DataFrame) -> DataFrame:
        return stored_among(spark, index_path, rows, stages=stages)

    kept, rejects, batches = batch_plan(
        docs, order_col, stored, checked(embed or default_embedder(dim), dim),
        number_of_records=number(number_of_records, 1000), batch_size=number(batch_size, 100),
        offset=number(offset, 0), stages=stages)
    rows = to_index_rows(kept, run_id)
    batches = materialize(batches, "ingest-batches")
    rejects = materialize(rejects, "ingest-rejects")
    if keyed_write:
        upsert(spark, index_path, rows, dim)
    else:
        # batch_plan has already skipped the stored ids (a re-run skips what
        # this run wrote): append, folding copies of an id
        append_rows(spark, index_path, rows)
    stages.clear()
    total = batches.agg(F.coalesce(F.sum("indexed"), F.lit(0)).alias("n")).first()["n"]
    return {"statusCode": 200, "body": json.dumps({"results": int(total)})}, batches, rejects


def ingest_event(spark: SparkSession, docs: DataFrame, index_path: str, event: dict, *,
                 order_col: str, **options):
    """``ingest`` with the parameters of an event, as numbers or numeric text."""
    return ingest(spark, docs, index_path, order_col=order_col,
                  number_of_records=event.get("number_of_records"),
                  batch_size=event.get("batch_size"), offset=event.get("records_offset"), **options)
