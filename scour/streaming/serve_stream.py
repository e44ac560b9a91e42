"""Searching as a Structured Streaming job: request events in, responses out.

``readStream`` over a folder of JSON request events -> ``foreachBatch``: decode,
search the index as it is now, write one response per request. The responses of
an epoch are a folder of their own, named by the stream and the epoch and replaced as
a whole, so an epoch that runs again leaves the same single answer per request.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scour.operators.index import read_index
from scour.operators.respond import to_responses
from scour.plans.search import search
from scour.session import Stages
from scour.sources.requests import decode_events

REQUESTS = "query_id long, event string"
RESPONSES = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("status_code", T.IntegerType()),
                          T.StructField("body", T.StringType()), T.StructField("stream", T.StringType()),
                          T.StructField("epoch", T.LongType())])


def serve_batch(spark: SparkSession, batch: DataFrame, epoch: int, index_path: str, out: str, stream: str,
                **options) -> None:
    """Answer one micro-batch of requests (query_id, event); ``options`` are those of
    ``search``. A request that repeats inside the batch is answered once."""
    stages = Stages(spark)
    requests = stages.write(batch.dropDuplicates(["query_id"]), "serve-requests")
    index = read_index(spark, index_path, options.get("dim"))
    answers = to_responses(search(decode_events(requests), index, **options))
    answers.write.mode("overwrite").parquet(f"{out}/stream={stream}/epoch={int(epoch)}")
    stages.clear()


def serve_stream(spark: SparkSession, source_dir: str, index_path: str, out: str, checkpoint: str, *,
                 stream: str = "requests", max_files_per_trigger: int = 1, **options):
    """Answer everything available now and return the query. A stream keeps its name
    and its checkpoint together: another checkpoint needs another name."""
    events = (spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", max_files_per_trigger)
              .parquet(source_dir))

    def each(batch: DataFrame, epoch: int) -> None:
        serve_batch(spark, batch, epoch, index_path, out, stream, **options)

    q = (events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def read_responses(spark: SparkSession, out: str) -> DataFrame:
    """query_id, status_code, body, stream, epoch: all that was answered."""
    spark.catalog.refreshByPath(out)
    return spark.read.schema(RESPONSES).parquet(out)
