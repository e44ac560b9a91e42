"""Status choice and the response sink (``status_code`` + JSON ``body``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Response messages, checked in this order.
MSG_NO_QUERY = "No query text provided in event."
MSG_UNAUTHORIZED = "Unauthorized"
MSG_EMBED_FAILED = "Embedding generation failed: "
MSG_NO_MATCHES = "No matches found"
MSG_SEARCH_FAILED = "Opensearch query failed: "


def missing_query(query_text: Column) -> Column:
    """Missing or empty query (a blank ' ' is a query, as in the original)."""
    return F.coalesce(query_text, F.lit("")) == ""


def unauthorized(api_key_header: Column, api_key: str | None) -> Column:
    """Only when a key is configured; a missing header or NULL map fails."""
    if not api_key:
        return F.lit(False)
    return ~api_key_header.eqNullSafe(F.lit(api_key))


def with_status(df: DataFrame, api_key: str | None) -> DataFrame:
    """Adds status_code, error and error_stage from the request outcome columns
    ``query_text``, ``api_key_header``, ``embed_error``, ``hit_count``,
    ``search_error`` and ``markdown``."""
    no_q = missing_query(F.col("query_text"))
    no_auth = unauthorized(F.col("api_key_header"), api_key)
    embed_err = F.col("embed_error").isNotNull()
    no_hits = F.coalesce(F.col("hit_count"), F.lit(0)) == 0
    search_err = F.col("search_error").isNotNull()
    status = (F.when(no_q, 400).when(no_auth, 401).when(embed_err, 500)
              .when(no_hits, 404).when(search_err, 500).otherwise(200)).cast("int")
    error = (F.when(no_q, F.lit(MSG_NO_QUERY))
             .when(no_auth, F.lit(MSG_UNAUTHORIZED))
             .when(embed_err, F.concat(F.lit(MSG_EMBED_FAILED), F.col("embed_error")))
             .when(no_hits, F.lit(MSG_NO_MATCHES))
             .when(search_err, F.concat(F.lit(MSG_SEARCH_FAILED), F.col("search_error"))))
    stage = (F.when(no_q, "validate").when(no_auth, "authorize").when(embed_err, "embed")
             .when(no_hits, "search").when(search_err, "answer"))
    return (df.withColumn("status_code", status).withColumn("error", error)
            .withColumn("error_stage", stage)
            .withColumn("markdown", F.when(status == 200, F.col("markdown"))))


def body_json(status_code: Column, markdown: Column, error: Column) -> Column:
    """``{"markdown": ...}`` for 200, else ``{"error": ...}``."""
    return F.when(status_code == 200, F.to_json(F.struct(markdown.alias("markdown")))) \
            .otherwise(F.to_json(F.struct(error.alias("error"))))


def to_responses(df: DataFrame, key: str = "query_id") -> DataFrame:
    return df.select(key, "status_code",
                     body_json(F.col("status_code"), F.col("markdown"), F.col("error")).alias("body"))
