"""Ingest control as one set-oriented job.

The sequential loop "fetch a page at ``offset``, skip what is stored, embed,
count successes, flush, advance by ``batch_size``, stop once ``total >= N``"
becomes:

1. global ordinals in source order (``key_ordinals``, no single-task window);
2. ``batch_no = (rn - offset) div batch_size`` for ``rn >= offset``;
3. anti-join against the ids already in the index;
4. embed every new id once (map-only, written once);
5. a repeat counts only in the first batch that embeds it (copies inside that
   batch all count, as they are flushed together); rows of an id whose
   embedding failed are rejects of every batch that offers them;
6. per-batch counts, an exclusive running total (``prefix_sum``, two-level so
   no task holds all batches), keep batches whose total before them is < N;
7. the kept rows are the rows to write.

Steps 3-6 run in rounds of consecutive batches. A round looks up ids until it has
as many new ones as N still needs, then embeds those, so that a small N over a large
source embeds a small prefix, not the whole source, and one round mostly suffices.
"""

from __future__ import annotations

import math

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from scour.session import Stages, materialize

_PID_SHIFT = 33  # monotonically_increasing_id puts the partition id above bit 33
#: Keys are broadcast while their bytes, counted beforehand, are under this.
BROADCAST_BYTES = 64 << 20
#: Bytes of a broadcast key: a 64-character content id and its row.
KEY_BYTES = 128


def key_ordinals(df: DataFrame, order_col: str, out: str = "rn", partitions: int | None = None,
                 stages: Stages | None = None) -> DataFrame:
    """(order_col, rn): the 0-based global position of each key in key order.

    The key column alone is range-partitioned, sorted, numbered inside its
    partition by ``monotonically_increasing_id`` and written. Counts per
    partition (a row each, so they are broadcast) and rows are both read from
    that one table; a second exchange would sample other bounds. Keys must be
    unique and not null.

    The partition count defaults to the cluster's shuffle width
    (``spark.sql.shuffle.partitions``, at least one per core)."""
    spark = df.sparkSession
    n = partitions or max(spark.sparkContext.defaultParallelism,
                          int(spark.conf.get("spark.sql.shuffle.partitions")))
    numbered = (df.select(order_col).repartitionByRange(n, F.col(order_col))
                .sortWithinPartitions(order_col)
                .withColumn("_mid", F.monotonically_increasing_id()))
    numbered = (stages.write if stages else materialize)(numbered, "key-ordinals")
    numbered = numbered.withColumn("_pid", F.shiftright(F.col("_mid"), _PID_SHIFT)) \
                       .withColumn("_loc", F.col("_mid") - F.shiftleft(F.col("_pid"), _PID_SHIFT))
    counts = numbered.groupBy("_pid").agg((F.max("_loc") + 1).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_start"))
    return (numbered.join(F.broadcast(starts), "_pid")
            .select(order_col, (F.col("_start") + F.col("_loc")).alias(out)))


def row_ordinals(df: DataFrame, order_col: str, out: str = "rn",
                 partitions: int | None = None) -> DataFrame:
    """``df`` with the 0-based global position of each row in ``order_col`` order."""
    return df.join(key_ordinals(df, order_col, out, partitions), order_col)


def prefix_sum(df: DataFrame, order_col: str, value_col: str, out: str,
               inclusive: bool = False, block: int = 4096) -> DataFrame:
    """Running total of ``value_col`` in ``order_col`` order (integer order key).

    Two levels: totals per block of ``block`` consecutive keys (a table of
    n/block rows), a running total over blocks, then a window partitioned by
    block. No task ever holds more than one block.
    """
    blk = F.floor(F.col(order_col) / block)
    d = df.withColumn("_blk", blk)
    totals = d.groupBy("_blk").agg(F.sum(value_col).alias("_bt"))
    wb = Window.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    bstart = totals.select("_blk", F.coalesce(F.sum("_bt").over(wb), F.lit(0)).alias("_bs"))
    hi = 0 if inclusive else -1
    wi = Window.partitionBy("_blk").orderBy(order_col).rowsBetween(Window.unboundedPreceding, hi)
    within = F.coalesce(F.sum(value_col).over(wi), F.lit(0))
    return (d.join(bstart, "_blk")
            .withColumn(out, F.col("_bs") + within)
            .drop("_blk", "_bs"))


def skip_stored(docs: DataFrame, stored_ids: DataFrame, key: str = "doc_id",
                rows_bound: int | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Documents whose content id is not in the index.

    By default one anti-join: AQE broadcasts the stored ids while they are
    small and plans a sort-merge join otherwise. When the caller knows an
    upper bound ``rows_bound`` on the rows of ``docs`` (a counted micro-batch,
    an ingest round) and their keys are under ``broadcast_bytes``, the keys of
    ``docs`` are broadcast instead and the index streams past them (left
    semi-join): the index is scanned, never shuffled, and a small anti-join
    drops the hits. Both give the same rows.
    """
    if rows_bound is not None and rows_bound * KEY_BYTES <= broadcast_bytes:
        hit = stored_ids.select(key).join(F.broadcast(docs.select(key)), key, "left_semi")
        return docs.join(hit, key, "left_anti")
    return docs.join(stored_ids.select(key), key, "left_anti")


def plan_batches(source: DataFrame, order_col: str, offset: int, batch_size: int,
                 stages: Stages | None = None) -> DataFrame:
    """Keys with ordinals and page numbers; rows before ``offset`` are never fetched."""
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")
    return (key_ordinals(source, order_col, stages=stages).filter(F.col("rn") >= offset)
            .withColumn("batch_no", F.floor((F.col("rn") - offset) / batch_size).cast("long")))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def batch_plan(source: DataFrame, order_col: str,
               stored_ids: DataFrame | Callable[[DataFrame], DataFrame],
               embed, number_of_records: int = 1000, batch_size: int = 100,
               offset: int = 0, key: str = "doc_id", text: str = "text",
               exact: bool = False, growth: float = 2.0,
               broadcast_bytes: int = BROADCAST_BYTES, stages: Stages | None = None):
    """Rows the sequential ingest loop would index.

    ``source`` has a unique, non-null ``order_col``, a content id ``key`` and
    ``text``. ``stored_ids`` is a table of ids, or a function that gives the stored ones
    (``key``) among the ids of a table. ``embed(df, text) -> df`` adds ``embedding`` and
    ``error`` per row (see ``scour.operators.embed``) and gives a text the same result
    every time it is offered. Returns ``(kept, rejects, batches)``:
      kept    - order_col, rn, batch_no, key, text, embedding
      rejects - order_col, rn, batch_no, key, error
      batches - batch_no, page_offset, fetched, indexed, total_before, total_after
    ``exact=True`` cuts the last batch so that exactly N rows are kept.

    * ordinals are computed once on the order key alone and written;
    * a round reads keys through a pushed-down range filter on the order
      key and joins their ordinals (counted, broadcast under ``broadcast_bytes``),
      drops the stored ids and writes the rest, keys without texts. While these are
      fewer than N needs, the next batches (``growth`` times as many) are looked up;
    * then the ids of the round are embedded, each once, whatever the number of its
      copies, and none that an earlier round embedded;
    * a round ends at the batch that has enough, so the first embeds no more than N
      and the rest of a batch; a later one is sized by the yield so far (ids that
      fail or repeat) and a fourth more.

    The driver reads a few numbers per round and nothing else.
    """
    spark = source.sparkSession
    stages = stages or Stages(spark)
    pages = plan_batches(source, order_col, offset, batch_size, stages)
    shape = pages.agg(F.max("batch_no").alias("m"), F.count(F.lit(1)).alias("n")).first()
    last = -1 if shape["m"] is None else int(shape["m"])
    n_after = int(shape["n"])
    total, b0, share = 0, 0, None                       # share: indexed of those embedded
    nb = max(1, math.ceil(number_of_records / batch_size))
    kept_parts, reject_parts, batch_parts, seen = [], [], [], []
    while b0 <= last and total < number_of_records:
        parts, new_rows, b1 = [], 0, b0
        need = number_of_records - total
        if share is not None:
            need = math.ceil(1.25 * need / share)
        while b1 <= last and new_rows < need:
            b2 = min(last + 1, b1 + nb)
            part, count = _offered(source, pages, order_col, key, stored_ids, b1, b2,
                                   (b2 - b1) * batch_size, broadcast_bytes, stages)
            parts.append(part)
            new_rows += count
            nb = max(math.ceil(nb * growth),
                     math.ceil(1.1 * (need - new_rows) * (b2 - b0) / max(new_rows, 1)))
            b1 = b2
        offered = _union(parts)
        if new_rows > need:                             # end at the batch that has enough
            sizes = offered.groupBy("batch_no").agg(F.count(F.lit(1)).alias("n"))
            enough = (prefix_sum(sizes, "batch_no", "n", "before").filter(F.col("before") < need)
                      .agg(F.max("batch_no").alias("b"), F.sum("n").alias("n")).first())
            b1, new_rows = int(enough["b"]) + 1, int(enough["n"])
            offered = offered.filter(F.col("batch_no") < b1)
        once = offered.groupBy(key).agg(F.min(order_col).alias(order_col))
        if seen:                                        # embedded by an earlier round
            once = once.join(_union(seen).select(key), key, "left_anti")
        small = new_rows * KEY_BYTES <= broadcast_bytes
        texts = source.select(order_col, text).join(F.broadcast(once) if small else once, order_col)
        tagged = stages.write(embed(texts.select(key, text), text).select(key, text, "embedding", "error"),
                              "embedded-ids")           # the embedder runs once
        ok_ids = tagged.filter(F.col("error").isNull() & F.col("embedding").isNotNull())
        ok = offered.join(ok_ids.select(key, text, "embedding"), key)
        first = ok.groupBy(key).agg(F.min("batch_no").alias("batch_no"))
        ok = ok.join(first, [key, "batch_no"], "left_semi")
        seen.append(tagged.select(key, "error"))
        failed = _union(seen).filter(F.col("error").isNotNull())
        # every page is full but the last one: no count needed
        fetched = spark.range(b0, b1).select(
            F.col("id").alias("batch_no"),
            F.least(F.lit(batch_size).cast("long"),
                    F.lit(n_after) - F.col("id") * batch_size).alias("fetched"))
        indexed = ok.groupBy("batch_no").agg(F.count(F.lit(1)).alias("indexed"))
        per_batch = (fetched.join(indexed, "batch_no", "left")
                     .withColumn("indexed", F.coalesce("indexed", F.lit(0))))
        per_batch = prefix_sum(per_batch, "batch_no", "indexed", "total_before") \
            .withColumn("total_before", F.col("total_before") + F.lit(total))
        counted = Observation()
        batches = stages.write(
            per_batch.filter(F.col("total_before") < number_of_records)
            .withColumn("page_offset", F.lit(offset) + F.col("batch_no") * batch_size)
            .withColumn("indexed", F.least("indexed", F.lit(number_of_records) - F.col("total_before"))
                        if exact else F.col("indexed"))
            .withColumn("total_after", F.col("total_before") + F.col("indexed"))
            .select("batch_no", "page_offset", "fetched", "indexed", "total_before", "total_after")
            .observe(counted, F.sum("indexed").alias("n")),
            "ingest-batches")
        got = int(counted.get.get("n") or 0)
        kept = ok.join(batches.select("batch_no", "total_before"), "batch_no")
        if exact:
            w = Window.partitionBy("batch_no").orderBy("rn")
            kept = (kept.withColumn("_i", F.row_number().over(w))
                    .filter(F.col("total_before") + F.col("_i") <= number_of_records))
        kept_parts.append(kept.select(order_col, "rn", "batch_no", key, text, "embedding"))
        reject_parts.append(offered.join(failed, key)
                            .join(batches.select("batch_no"), "batch_no", "left_semi")
                            .select(order_col, "rn", "batch_no", key, "error"))
        batch_parts.append(batches)
        total += got
        if new_rows:
            share = min(share or 1.0, max(0.01, got / new_rows))
        nb = max(1, math.ceil(1.1 * (b1 - b0) * (number_of_records - total) / max(got, 1)))
        b0 = b1
    if not batch_parts:                                 # nothing after the offset, or N is 0
        order_type = source.schema[order_col].dataType.simpleString()
        at = f"{order_col} {order_type}, rn long, batch_no long, {key} string, "
        return (spark.createDataFrame([], at + f"{text} string, embedding array<float>"),
                spark.createDataFrame([], at + "error string"),
                spark.createDataFrame([], "batch_no long, page_offset long, fetched long, "
                                          "indexed long, total_before long, total_after long"))
    return _union(kept_parts), _union(reject_parts), _union(batch_parts)


def _offered(source: DataFrame, pages: DataFrame, order_col: str, key: str, stored_ids, b0: int,
             b1: int, bound: int, broadcast_bytes: int, stages: Stages) -> tuple[DataFrame, int]:
    """(order_col, key, rn, batch_no) of the rows of batches b0 to b1 - 1 whose id is not
    stored, written, and how many they are; ``bound``: rows of these batches at most."""
    rk = pages.filter((F.col("batch_no") >= b0) & (F.col("batch_no") < b1))
    ends = rk.agg(F.min(order_col).alias("lo"), F.max(order_col).alias("hi")).first()
    small = bound * KEY_BYTES <= broadcast_bytes
    rows = (source.select(order_col, key)
            .filter(F.col(order_col).between(ends["lo"], ends["hi"]))
            .join(F.broadcast(rk) if small else rk, order_col))
    if callable(stored_ids):
        fresh = rows.join(stored_ids(rows), key, "left_anti")
    else:
        fresh = skip_stored(rows, stored_ids, key, bound, broadcast_bytes)
    seen = Observation()
    part = stages.write(fresh.select(order_col, "rn", "batch_no", key).observe(
        seen, F.count(F.lit(1)).alias("n")), "offered-rows")
    return part, int(seen.get.get("n") or 0)
