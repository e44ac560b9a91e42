"""Index writes (create, width check, upsert, idempotent append) and the stream."""

import os
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from scour.operators import index as idx
from scour.operators.embed import hash_embed_text
from scour.session import checkpoint_dir
from scour.streaming.ingest_stream import ingest_stream


def _rows(spark, texts, run_id, width=None):
    import hashlib

    data = []
    for t in texts:
        v = hash_embed_text(t)
        if width:
            v = v[:width]
        data.append((hashlib.sha256(t.encode()).hexdigest(), t, v))
    df = spark.createDataFrame(data, "doc_id string, text string, embedding array<float>")
    return idx.to_index_rows(df, run_id)


def test_create_and_width(spark):
    path = os.path.join(tempfile.mkdtemp(), "index")
    idx.create_if_missing(spark, path, 64)
    assert idx.index_dimension(spark, path) == 64
    assert idx.read_index(spark, path).count() == 0


def test_upsert_newest_wins_and_rejects_bad_width(spark):
    path = os.path.join(tempfile.mkdtemp(), "index")
    r1 = idx.upsert(spark, path, _rows(spark, ["a b", "c d"], 1), 64)
    assert r1["written"] == 2
    r2 = idx.upsert(spark, path, _rows(spark, ["a b", "e f"], 2).unionByName(
        _rows(spark, ["short one"], 2, width=10)), 64)
    assert r2["rejected"] == 1
    got = {r["text"]: r["run_id"] for r in idx.read_index(spark, path).collect()}
    assert got == {"a b": 2, "c d": 1, "e f": 2}


def test_append_is_idempotent(spark):
    path = os.path.join(tempfile.mkdtemp(), "index")
    rows = _rows(spark, ["x", "y", "x"], 0)
    idx.append_new(spark, path, rows, 64)
    idx.append_new(spark, path, rows)
    assert idx.read_index(spark, path).count() == 2


def test_batch_keeps_newest_run_of_an_id(spark):
    path = os.path.join(tempfile.mkdtemp(), "index")
    texts = [f"text {i}" for i in range(6)]
    both = _rows(spark, texts, 1).unionByName(_rows(spark, texts, 2)).repartition(3)
    report = idx.upsert(spark, path, both, 64)
    assert report["written"] == 6
    assert {r["run_id"] for r in idx.read_index(spark, path).collect()} == {2}


def test_upsert_older_or_missing_run_never_replaces_newer(spark):
    path = os.path.join(tempfile.mkdtemp(), "index")
    idx.upsert(spark, path, _rows(spark, ["a b", "c d"], 5), 64)
    idx.upsert(spark, path, _rows(spark, ["a b", "g h"], 3), 64)
    idx.upsert(spark, path, _rows(spark, ["c d", "i j"], 5), 64)
    idx.upsert(spark, path, _rows(spark, ["a b"], 9).withColumn("run_id", F.lit(None).cast("long")), 64)
    want = [("a b", 5), ("c d", 5), ("g h", 3), ("i j", 5)]
    assert sorted((r["text"], r["run_id"]) for r in idx.read_index(spark, path).collect()) == want
    idx.compact(spark, path)
    assert spark.read.parquet(path).count() == 4
    assert sorted((r["text"], r["run_id"]) for r in idx.read_index(spark, path).collect()) == want


def _files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f))
            for d, _, names in os.walk(path) for f in names
            if f.startswith("part-") and "id_prefix=" in d}


def test_upsert_of_few_ids_rewrites_no_file(spark):
    path = os.path.join(tempfile.mkdtemp(), "index")
    stored = idx.upsert(spark, path, _rows(spark, [f"text {i}" for i in range(200)], 1), 64)
    before = _files(path)
    idx.upsert(spark, path, _rows(spark, ["text 3", "text 4"], 2), 64)
    after = _files(path)
    assert all(after.get(f) == t for f, t in before.items()) and len(after) > len(before)
    runs = {r["text"]: r["run_id"] for r in idx.read_index(spark, path).collect()}
    assert len(runs) == stored["written"] > 190 and runs["text 3"] == 2 and runs["text 5"] == 1


def test_files_are_sorted_and_scratch_is_deleted(spark):
    path = os.path.join(tempfile.mkdtemp(), "index")
    shared = checkpoint_dir(spark)
    before = set(os.listdir(shared))
    idx.append_rows(spark, path, _rows(spark, [f"text {i}" for i in range(300)], 1), 64)
    assert set(os.listdir(shared)) == before
    for f in _files(path):
        ids = [r["doc_id"] for r in spark.read.parquet(f).collect()]
        assert ids == sorted(ids)


def test_append_rejects_bad_vectors(spark):
    path = os.path.join(tempfile.mkdtemp(), "index")
    idx.create_if_missing(spark, path, 64)
    report = idx.append_rows(spark, path, _rows(spark, ["a", "b"], 0).unionByName(
        _rows(spark, ["short"], 0, width=3)))
    assert report == {"written": 2, "rejected": 1}


def test_width_is_required(spark):
    path = os.path.join(tempfile.mkdtemp(), "index")
    with pytest.raises(ValueError, match="width"):
        idx.append_rows(spark, path, _rows(spark, ["a"], 0))


def _ids(spark, texts):
    return _rows(spark, texts, 0).select("doc_id")


def test_stored_among_equals_a_join_with_and_without_filters(spark):
    path = os.path.join(tempfile.mkdtemp(), "index")
    for run in range(3):                                 # three writes, filters of their own
        idx.append_rows(spark, path, _rows(spark, [f"t {run} {i}" for i in range(150)], run), 64)
    idx.upsert(spark, path, _rows(spark, ["t 0 3", "t 9 9"], 5), 64)
    asked = _ids(spark, [f"t {run} {i}" for run in range(5) for i in range(0, 300, 7)] + ["t 9 9"] * 2)
    asked = asked.unionByName(spark.createDataFrame([(None,), ("",), ("no hash",)], "doc_id string"))
    want = sorted(r[0] for r in asked.distinct().join(spark.read.parquet(path), "doc_id", "left_semi").collect())
    found = lambda **o: sorted(r[0] for r in idx.stored_among(spark, path, asked, **o).collect())
    assert len(want) > 60 and found() == want and found(broadcast_bytes=0) == want
    idx.compact(spark, path)
    assert found() == want and not os.path.exists(f"{path}/_repeated")
    os.remove(f"{path}/_filters/_SUCCESS")               # a rebuild that was cut off
    assert found() == want


def test_prefixes_without_a_candidate_are_not_read(spark):
    path = os.path.join(tempfile.mkdtemp(), "index")
    idx.append_rows(spark, path, _rows(spark, [f"t {i}" for i in range(400)], 0), 64)
    one = idx.stored_among(spark, path, _ids(spark, ["t 7"]))
    prefix = one.first()["doc_id"][0]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert re.search(rf"PartitionFilters: \[[^]]*id_prefix#\d+ (= {prefix}\)|IN \({prefix}\))", plan)
    none = idx.stored_among(spark, path, _ids(spark, ["new text"]))
    assert none.count() == 0


def test_filters_hold_every_id_in_many_blocks_and_few_others(spark, monkeypatch):
    monkeypatch.setattr(idx, "BLOCK_IDS", 40)
    path = os.path.join(tempfile.mkdtemp(), "index")
    texts = [f"t {i}" for i in range(3000)]
    rows = _rows(spark, texts, 0)
    idx.create_if_missing(spark, path, 64)
    idx._add_filters(rows, path, 3000)
    idx._add_filters(rows.limit(100), path, 100)         # another number of blocks
    with_prefix = lambda t: _rows(spark, t, 0).select("doc_id", "id_prefix")
    assert idx._maybe_stored(spark, path, with_prefix(texts)).count() == 3000
    others = idx._maybe_stored(spark, path, with_prefix([f"other {i}" for i in range(2000)])).count()
    assert others <= 20


def test_marked_index_reads_without_a_shuffle_of_all_ids(spark):
    path = os.path.join(tempfile.mkdtemp(), "index")
    first = idx.upsert(spark, path, _rows(spark, [f"t {i}" for i in range(300)], 1), 64)
    report = idx.upsert(spark, path, _rows(spark, ["t 5", "t 6", "new"], 2), 64)
    assert report["replaced"] == 2
    assert {r[0] for r in spark.read.parquet(f"{path}/_repeated").collect()} == {
        r[0] for r in _ids(spark, ["t 5", "t 6"]).collect()}
    runs = {r["text"]: r["run_id"] for r in idx.read_index(spark, path).collect()}
    assert len(runs) == first["written"] + 1 > 280 and runs["t 5"] == runs["t 6"] == runs["new"] == 2 and runs["t 7"] == 1
    far = idx.read_index(spark, path, broadcast_bytes=0)
    assert sorted(far.collect()) == sorted(idx.read_index(spark, path).collect())


def test_stream_replay_adds_nothing(spark):
    base = tempfile.mkdtemp()
    src = os.path.join(base, "src")
    spark.createDataFrame([("one two",), ("three",), ("one two",)], "text string") \
        .coalesce(1).write.parquet(os.path.join(src, "p1"))
    spark.createDataFrame([("four five",), ("three",)], "text string") \
        .coalesce(1).write.parquet(os.path.join(src, "p2"))
    path, ckpt = os.path.join(base, "index"), os.path.join(base, "ckpt")
    ingest_stream(spark, src + "/*", path, ckpt)
    assert idx.read_index(spark, path).count() == 3
    # a new checkpoint replays everything: the content ids make it a no-op
    ingest_stream(spark, src + "/*", path, os.path.join(base, "ckpt2"))
    assert idx.read_index(spark, path).count() == 3


def test_stream_source_has_files_by_its_splits(spark, monkeypatch):
    """As many micro-batches at any size, but no file of a third of a large input."""
    from scour.plans import registry
    from tests.conftest import SF_SMALL

    runs = []
    monkeypatch.setattr(registry, "_ingest_stream", lambda spark, source, *a, max_files_per_trigger, **o: runs.append(
        (len(spark.read.parquet(source).inputFiles()), max_files_per_trigger)))
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "4096")
    try:
        many = registry._t(spark, SF_SMALL, "documents").rdd.getNumPartitions()
        registry.ingest_stream(spark, SF_SMALL)
    finally:
        spark.conf.set(key, before)
    assert many > 3 and runs[0][0] >= many and runs[-1][1] == runs[0][0]
    assert runs[0] == runs[1] and -(-runs[0][0] // runs[0][1]) == registry.STREAM_FILES
