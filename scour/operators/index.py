"""The document index on plain Parquet: create, validate, append, keyed upsert.

Layout: ``doc_id`` (SHA-256 hex of the text), ``text``, ``embedding``,
``run_id`` and the partition column ``id_prefix`` (first hex digit of the id).
Every write appends: stored files are never read to be written again. A keyed
upsert appends its rows too, and the ids it brings that are stored already go to
a table of repeated ids; readers resolve those, and those alone, to their newest
``run_id``. ``compact`` folds them into one row per id.

Beside the rows lie Bloom filters of the stored ids, in blocks per prefix. They
say of most ids of a batch that they are not stored; only the others are looked
up, in their own prefix folders. A write adds its filters before its rows, so a
write that fails between the two leaves filters that promise too much, never too
little.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scour.schemas import FILTERS, INDEX
from scour.session import Stages

# One hex digit: 16 prefix folders. Content ids are uniform hashes; id lookups
# use the (prefix, id) sort inside the files.
PREFIX_CHARS = 1

#: Bits of a filter block (fixed by ``bitmap_construct_agg``), ids it is made for
#: (13 bits each: about 3 in 1,000 other ids pass), and bits set per id.
BLOCK_BITS, BLOCK_IDS, BITS_PER_ID = 32_768, 2_500, 8
#: Ids are broadcast while they are under so many bytes, at so many each.
BROADCAST_BYTES, KEY_BYTES = 64 << 20, 128


def _write(df: DataFrame, path: str, mode: str) -> int:
    """Partitioned index write; the rows are counted as they are written. Range-partitioning on (prefix, id) gives each
    task a contiguous key range - one or two prefix folders per task instead
    of one file per prefix per task - and AQE sizes the tasks; rows are sorted
    by id inside a task, so row-group statistics serve id lookups."""
    seen = Observation()
    (df.repartitionByRange(F.col("id_prefix"), F.col("doc_id"))
     .sortWithinPartitions("id_prefix", "doc_id").observe(seen, F.count(F.lit(1)).alias("rows"))
     .write.mode(mode).partitionBy("id_prefix").parquet(path))
    return int(seen.get.get("rows", 0))


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def stored_bytes(spark: SparkSession, path: str, prefixes=None) -> int:
    """Bytes on disk under the index (or under the given prefix folders only),
    from file-system metadata - no Spark job."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    total = 0
    folders = [path] if prefixes is None else [f"{path}/id_prefix={pre}" for pre in prefixes]
    for folder in folders:
        p = jvm.org.apache.hadoop.fs.Path(folder)
        fs = p.getFileSystem(conf)
        if fs.exists(p):
            total += fs.getContentSummary(p).getLength()
    return total


def create_if_missing(spark: SparkSession, path: str, dim: int | None = None) -> str:
    """Write an empty index with the fixed schema when ``path`` is absent; the
    vector width is kept next to it in ``_meta`` (ignored by data readers)."""
    if not _exists(spark, path):
        (spark.createDataFrame([], INDEX).write.mode("overwrite")
         .partitionBy("id_prefix").parquet(path))
        spark.createDataFrame([], FILTERS).write.mode("overwrite").parquet(_filters(path))
        if dim is not None:
            (spark.createDataFrame([(int(dim),)], "dimension int").coalesce(1)
             .write.mode("overwrite").parquet(f"{path}/_meta"))
    return path


def index_dimension(spark: SparkSession, path: str) -> int | None:
    """Vector width recorded when the index was created (None if not recorded)."""
    if not _exists(spark, f"{path}/_meta"):
        return None
    return int(spark.read.parquet(f"{path}/_meta").first()["dimension"])


def _repeated(path: str) -> str:
    return f"{path}/_repeated"                          # ignored by data readers, as is


def _filters(path: str) -> str:
    return f"{path}/_filters"


def _filtered(spark: SparkSession, path: str) -> bool:
    """Whether the filters are whole: an index of another make has none, and one whose
    rebuild was cut off has no mark of success."""
    return _exists(spark, f"{_filters(path)}/_SUCCESS")


def _block(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(0)), blocks).cast("int")


def _bits() -> list[Column]:
    """The places of an id in its block: eight pieces of 15 bits of two hashes."""
    return [F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 15 * i).bitwiseAND(BLOCK_BITS - 1)
            for seed in (1, 2) for i in range(BITS_PER_ID // 2)]


def _add_filters(rows: DataFrame, path: str, count: int, mode: str = "append") -> None:
    """Write the filters of ``rows`` (doc_id, id_prefix), about ``count`` of them. Each
    write has filters of its own; their number of blocks is a power of 4, so that an
    index has few different ones."""
    blocks = 1
    while blocks * BLOCK_IDS * 16 ** PREFIX_CHARS < count:
        blocks *= 4
    (rows.select("id_prefix", F.lit(blocks).alias("blocks"), _block(F.lit(blocks)).alias("block"),
                 F.explode(F.array(*_bits())).alias("bit"))
     .groupBy("id_prefix", "blocks", "block").agg(F.bitmap_construct_agg("bit").alias("bits"))
     .write.mode(mode).parquet(_filters(path)))


def _maybe_stored(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """The rows of ``ids`` (doc_id, id_prefix) that some filter lets pass."""
    filters = spark.read.schema(FILTERS).parquet(_filters(path))
    sizes = [r["blocks"] for r in filters.select("blocks").distinct().collect()]   # powers of 4
    if not sizes:
        return ids.limit(0)
    asked = ids.select("doc_id", "id_prefix", F.explode(F.array(*[
        F.struct(F.lit(n).alias("blocks"), _block(F.lit(n)).alias("block")) for n in sizes]))
        .alias("at")).select("doc_id", "id_prefix", "at.*")
    byte = lambda bit: F.conv(F.hex(F.substring(
        F.col("bits"), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = F.lit(True)
    for bit in _bits():
        held = held & (F.call_function("getbit", byte(bit), (bit % 8).cast("int")) == 1)
    return (asked.join(filters, ["id_prefix", "blocks", "block"]).filter(held)
            .select("doc_id", "id_prefix").distinct())


def stored_among(spark: SparkSession, path: str, ids: DataFrame, key: str = "doc_id",
                 stages: Stages | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id: those of ``ids`` that the index holds, each once.

    The filters are asked first; ids that pass are written and counted per prefix, and
    the id column of their prefix folders streams past them (a shuffle join beyond
    ``broadcast_bytes``). Folders of other prefixes are not read, and none is if no id
    passes. An index without filters is read whole. Null ids are never stored."""
    stages = stages or Stages(spark)
    spark.catalog.refreshByPath(path)
    stored = spark.read.schema(INDEX).parquet(path).select("doc_id", "id_prefix")
    wanted = ids.select(F.col(key).alias("doc_id")).filter("doc_id is not null").distinct() \
                .withColumn("id_prefix", F.substring("doc_id", 1, PREFIX_CHARS))
    if not _filtered(spark, path):
        return wanted.join(stored, "doc_id", "left_semi").select("doc_id")
    maybe = stages.write(_maybe_stored(spark, path, wanted), "index-maybe")
    many = {r["id_prefix"]: r["count"] for r in maybe.groupBy("id_prefix").count().collect()}
    small = sum(many.values()) * KEY_BYTES <= broadcast_bytes
    return (stored.filter(F.col("id_prefix").isin(list(many)))
            .join(F.broadcast(maybe) if small else maybe, ["id_prefix", "doc_id"], "left_semi")
            .select("doc_id").distinct())


def read_index(spark: SparkSession, path: str, dim: int | None = None,
               broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per id: of an id written by several runs, the newest run's.

    An index without repeated ids is a plain scan. In others the rows of the repeated ids
    are picked out and resolved, and the rest passes an anti-join against those
    ids; they were listed when written, so a read shuffles their rows and no others
    while the list is under ``broadcast_bytes`` (``compact`` empties it)."""
    create_if_missing(spark, path, dim)
    spark.catalog.refreshByPath(path)
    rows = spark.read.schema(INDEX).parquet(path)
    if not _exists(spark, _repeated(path)):
        return rows
    many = spark.read.schema("doc_id string").parquet(_repeated(path)).distinct()
    if many.count() * KEY_BYTES <= broadcast_bytes:
        many = F.broadcast(many)
    newest = newest_per_id(rows.join(many, "doc_id", "left_semi"))
    return rows.join(many, "doc_id", "left_anti").unionByName(newest.select(*rows.columns))


def compact(spark: SparkSession, path: str) -> None:
    """Fold repeated ids into one row per id, and the filters of all writes into
    those of one; readers must wait for the end. The folded rows are written aside
    first; only prefix folders with repeated ids are written anew."""
    stages = Stages(spark)
    if _exists(spark, _repeated(path)):
        listed = spark.read.schema("doc_id string").parquet(_repeated(path))
        touched = [r["p"] for r in listed.select(
            F.substring("doc_id", 1, PREFIX_CHARS).alias("p")).distinct().collect()]
        folded = stages.write(read_index(spark, path).filter(F.col("id_prefix").isin(touched)),
                              "index-compact")
        (folded.repartitionByRange(F.col("id_prefix"), F.col("doc_id"))
         .sortWithinPartitions("id_prefix", "doc_id").write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("id_prefix").parquet(path))
        jvm = spark.sparkContext._jvm
        gone = jvm.org.apache.hadoop.fs.Path(_repeated(path))
        gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)
    spark.catalog.refreshByPath(path)
    stored = spark.read.schema(INDEX).parquet(path).select("doc_id", "id_prefix")
    _add_filters(stored, path, stored.count(), "overwrite")
    stages.clear()


def check_vectors(df: DataFrame, vec: str, dim) -> DataFrame:
    """Adds ``valid`` and ``reason``: a vector must be present, of width ``dim``
    (a number or a column), and free of NULL / NaN cells."""
    size = F.size(F.col(vec))
    dim = dim if isinstance(dim, Column) else F.lit(int(dim))
    bad_cell = F.exists(F.col(vec), lambda x: x.isNull() | F.isnan(x))
    reason = (F.when(F.col(vec).isNull(), F.lit("missing vector"))
              .when(size != dim, F.concat(F.lit("width "), size.cast("string"),
                                          F.lit(" != "), dim.cast("string")))
              .when(bad_cell, F.lit("null or NaN cell")))
    return df.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())


def to_index_rows(docs: DataFrame, run_id: int, key: str = "doc_id", text: str = "text",
                  vec: str = "embedding") -> DataFrame:
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"),
                       F.col(vec).cast(T.ArrayType(T.FloatType())).alias("embedding"),
                       F.lit(run_id).cast("long").alias("run_id"),
                       F.substring(F.col(key), 1, PREFIX_CHARS).alias("id_prefix"))


def newest_per_id(rows: DataFrame) -> DataFrame:
    """One row per ``doc_id``: the newest ``run_id`` (none is the oldest); of
    rows of one run, any (their text is the same, as the id is its hash). Copies
    collapse before the shuffle."""
    rest = [c for c in rows.columns if c != "doc_id"]
    return rows.groupBy("doc_id").agg(
        F.max_by(F.struct(*rest), F.coalesce("run_id", F.lit(-(1 << 62)))).alias("_r")) \
        .select("doc_id", *[F.col(f"_r.{c}").alias(c) for c in rest])


def _checked(stages: Stages, rows: DataFrame, dim: int) -> tuple[DataFrame, int, int]:
    """(valid rows, how many they are, how many others there were). The rows are written
    once, so that the embedder upstream runs once, and counted on the way."""
    tested = check_vectors(rows.select(*INDEX.fieldNames()), "embedding", dim)
    seen = Observation()
    tested = stages.write(tested.observe(seen, F.count_if("valid").alias("valid"),
                                         F.count(F.lit(1)).alias("rows")), "index-staging")
    good, every = int(seen.get.get("valid", 0)), int(seen.get.get("rows", 0))
    return tested.filter("valid").select(*INDEX.fieldNames()), good, every - good


def _append(spark: SparkSession, path: str, rows: DataFrame, count: int) -> int:
    """Filters first, then rows, one per id: an id that is stored always passes its filter."""
    if _filtered(spark, path):
        _add_filters(rows, path, count)
    written = _write(newest_per_id(rows), path, "append")
    spark.catalog.refreshByPath(path)
    return written


def upsert(spark: SparkSession, path: str, new_rows: DataFrame, dim: int) -> dict:
    """Keyed write of ``new_rows`` (index schema). Rows with a bad vector are not
    written; of several rows of an id in the batch the newest run is. The rows
    are appended; ids that are stored already (``stored_among``) are listed as
    repeated before that. Returns written and rejected rows
    and the number of ids that replace stored ones."""
    create_if_missing(spark, path, dim)
    dim = index_dimension(spark, path) or dim
    stages = Stages(spark)
    rows, good, rejected = _checked(stages, new_rows, dim)
    written = replaced = 0
    if good:
        seen = Observation()
        again = stages.write(stored_among(spark, path, rows, stages=stages).observe(
            seen, F.count(F.lit(1)).alias("n")), "index-replaced")
        replaced = int(seen.get.get("n", 0))
        if replaced:
            again.write.mode("append").parquet(_repeated(path))
        written = _append(spark, path, rows, good)
    stages.clear()
    return {"written": written, "rejected": rejected, "replaced": replaced}


def append_rows(spark: SparkSession, path: str, new_rows: DataFrame, dim: int | None = None) -> dict:
    """Append rows whose ids the caller has already checked against the index
    (e.g. with ``stored_among``); copies of an id are folded and rows with a bad
    vector are not written. The index must know its width, or be told ``dim``.
    Returns written and rejected rows."""
    create_if_missing(spark, path, dim)
    width = index_dimension(spark, path) or dim
    if width is None:
        raise ValueError(f"the width of the vectors in {path} is not recorded: give dim")
    stages = Stages(spark)
    rows, good, rejected = _checked(stages, new_rows, width)
    written = _append(spark, path, rows, good) if good else 0
    stages.clear()
    return {"written": written, "rejected": rejected}


def append_new(spark: SparkSession, path: str, new_rows: DataFrame, dim: int | None = None) -> dict:
    """Append without the ids that are stored already, so the write is
    idempotent under replay."""
    create_if_missing(spark, path, dim)
    stages = Stages(spark)
    stored = stored_among(spark, path, new_rows, stages=stages)
    report = append_rows(spark, path, new_rows.join(stored, "doc_id", "left_anti"), dim)
    stages.clear()
    return report
