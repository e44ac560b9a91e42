"""Answer side: hit texts, prompt assembly, answer model, answer extraction."""

from __future__ import annotations

import json
from dataclasses import replace
from typing import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scour.functions.text import (MARKDOWN_CLOSE, MARKDOWN_OPEN, SYSTEM_PROMPT,
                                  TEMPERATURE, extract_tagged, join_parts, prompt_text)
from scour.operators.service import ONE_BY_ONE, ServiceCalls
from scour.schemas import MODEL_RESPONSE
from scour.session import materialize


#: Hits whose keys, counted beforehand, are under this are broadcast.
BROADCAST_BYTES = 64 << 20
HIT_BYTES = 128


def hits_with_text(hits: DataFrame, texts: DataFrame, hit_key: str, text_key: str,
                   text_col: str = "text", qid: str = "query_id",
                   broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Attach the stored text of each hit; a hit without a text gets ''.

    The hit table (queries x k rows) is written once and counted. While its keys
    are under ``broadcast_bytes`` they are broadcast and the text store streams
    past them; beyond that both sides are joined by a shuffle. A left join on
    (query, rank) keeps hits with no text."""
    hits = materialize(hits, "hits")
    wanted = hits.select(qid, "rank", hit_key)
    if hits.count() * HIT_BYTES <= broadcast_bytes:
        wanted = F.broadcast(wanted)
    t = texts.select(F.col(text_key).alias(hit_key), F.col(text_col).alias("_tt"))
    matched = t.join(wanted, hit_key).select(qid, "rank", "_tt")
    return (hits.join(matched, [qid, "rank"], "left")
            .withColumn("text", F.coalesce(F.col("_tt"), F.lit("")))
            .drop("_tt"))


def assemble_prompts(requests: DataFrame, hits: DataFrame, qid: str = "query_id",
                     query_col: str = "query_text") -> DataFrame:
    """One prompt per request with at least one hit: matches in rank order,
    numbered from 0, and ``matches``, their texts. Each group holds at most k hits."""
    per_q = (hits.groupBy(qid)
             .agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("_m"),
                  F.count(F.lit(1)).alias("hit_count")))
    texts = F.transform(F.col("_m"), lambda s: s["text"])
    return (requests.select(qid, query_col).join(per_q, qid)
            .select(qid, query_col, "hit_count", texts.alias("matches"),
                    prompt_text(F.col(query_col), texts).alias("prompt")))


# --------------------------------------------------------------------------
# answer models
# --------------------------------------------------------------------------

def _response_json(parts: F.Column) -> F.Column:
    msg = F.struct(F.lit("assistant").alias("role"),
                   F.transform(parts, lambda p: F.struct(p.alias("text"))).alias("content"))
    return F.to_json(F.struct(F.struct(msg.alias("message")).alias("output")))


def offline_model(prompts: DataFrame, matches_col: str = "matches") -> DataFrame:
    """Deterministic stand-in for the language model, in Catalyst expressions:
    the reply names how many matches it read and puts the top match, whole,
    inside the markdown tags. It reads the matches, not the prompt, so a text
    that holds a marker is not cut. Adds ``response`` (JSON) and ``model_error``."""
    m = F.col(matches_col)
    parts = F.array(F.concat(F.lit("Read "), F.size(m).cast("string"), F.lit(" matches.")),
                    F.concat(F.lit(MARKDOWN_OPEN), F.element_at(m, 1), F.lit(MARKDOWN_CLOSE)))
    return prompts.withColumn("response", _response_json(parts)) \
                  .withColumn("model_error", F.lit(None).cast("string"))


def map_model(prompts: DataFrame, factory: Callable[[], Callable[..., dict]],
              qid: str = "query_id", prompt_col: str = "prompt",
              retryable: tuple[type[BaseException], ...] = (Exception,),
              calls: ServiceCalls = ONE_BY_ONE) -> DataFrame:
    """Call a user answer model once per prompt; the client is built once per
    partition. ``fn(prompt=..., system=..., temperature=...)`` returns the
    response dict (``output.message.content[*].text``). Errors of a retryable
    class become ``model_error``, after the attempts that ``calls`` allows; it also
    says how many prompts are on their way at once (``batch`` is not used: a model
    answers one prompt)."""
    out_fields = [f for f in prompts.schema.fields] + [
        T.StructField("response", T.StringType()), T.StructField("model_error", T.StringType())]
    schema = T.StructType(out_fields)

    def run(batches):
        fn = factory()

        def ask(prompt):
            return json.dumps(fn(prompt=prompt, system=SYSTEM_PROMPT, temperature=TEMPERATURE))

        for pdf in batches:
            out = list(replace(calls, batch=1).map(ask, pdf[prompt_col].tolist(), retryable))
            resp = [r for r, _ in out]
            errs = [None if e is None else str(e) for _, e in out]
            yield pdf.assign(response=pd.Series(resp, dtype=object),
                             model_error=pd.Series(errs, dtype=object))

    return prompts.mapInPandas(run, schema)


def extract_answer(responses: DataFrame, response_col: str = "response") -> DataFrame:
    """Decode the model response, join its text parts with newline and keep
    what is inside the markdown tags (or the whole text without them)."""
    parsed = F.from_json(F.col(response_col), MODEL_RESPONSE)
    result = join_parts(parsed["output"]["message"]["content"])
    return responses.withColumn("markdown", extract_tagged(result))
