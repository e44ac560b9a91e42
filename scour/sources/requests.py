"""Request sources: decode gateway events and request URLs into columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scour.schemas import REQUEST_EVENT

# Fixed value: the client's query parameter name and the API-key header name.
QUERY_PARAM = "query"
API_KEY_HEADER = "api_key"


def decode_events(df: DataFrame, col: str = "event") -> DataFrame:
    """JSON request events -> typed struct columns (explicit schema, no inference)."""
    ev = F.from_json(F.col(col), REQUEST_EVENT)
    return df.withColumn("_ev", ev).select(
        "*", F.col("_ev.queryStringParameters").alias("params"),
        F.col("_ev.headers").alias("headers")).drop("_ev")


def request_fields(df: DataFrame, params: str = "params", headers: str = "headers") -> DataFrame:
    """Query text and API-key header; a missing key or a NULL map gives NULL."""
    return (df.withColumn("query_text", F.element_at(F.col(params), F.lit(QUERY_PARAM)))
            .withColumn("api_key_header", F.element_at(F.col(headers), F.lit(API_KEY_HEADER))))


def int_param(params: Column, name: str, default: int) -> Column:
    """Integer parameter with a default: a missing or non-numeric value gives it."""
    return F.coalesce(F.element_at(params, F.lit(name)).try_cast("int"), F.lit(default))


def url_requests(df: DataFrame, url: str = "url", param: str = QUERY_PARAM) -> DataFrame:
    """Request URL -> path, parameter map, and the URL-decoded value of ``param``."""
    q = F.parse_url(F.col(url), F.lit("QUERY"))
    return (df.withColumn("path", F.parse_url(F.col(url), F.lit("PATH")))
            .withColumn("params", F.when(q.isNotNull(), F.str_to_map(q, F.lit("&"), F.lit("="))))
            .withColumn("param_value", F.url_decode(F.parse_url(F.col(url), F.lit("QUERY"), F.lit(param)))))


def requests_from_conversations(conv: DataFrame) -> DataFrame:
    """Driver-table binding: one search request per user or system turn.

    User turns carry their text as the ``query`` parameter; system turns are
    sent without it. Headers model three kinds of callers, chosen by
    conversation: the right key, a wrong key, and no headers at all.
    """
    qid = F.col("conv_id") * 1000 + F.col("turn")
    params = F.when(F.col("role") == "user", F.create_map(F.lit(QUERY_PARAM), F.col("text"))) \
              .otherwise(F.create_map(F.lit("q"), F.col("text")))
    caller = F.pmod(F.col("conv_id"), F.lit(9))
    headers = (F.when(caller == 7, F.lit(None).cast("map<string,string>"))
               .when(caller == 4, F.create_map(F.lit(API_KEY_HEADER), F.lit("wrong-key")))
               .otherwise(F.create_map(F.lit(API_KEY_HEADER), F.lit(DEFAULT_API_KEY))))
    return (conv.filter(F.col("role").isin("user", "system"))
            .select(qid.alias("query_id"), params.alias("params"), headers.alias("headers")))


DEFAULT_API_KEY = "local-key"
