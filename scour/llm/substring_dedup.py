"""Removal of repeated byte strings by distributed prefix doubling.

Every byte covered by a ``length``-byte string that also starts earlier (in a
smaller document, or earlier in the same one) goes. As in suffix-array
construction by prefix doubling, positions are named by ranks of ever longer
strings, a longer name being made of a pair of shorter ones at a growing offset
(1, 2, 4, ... bytes, at last the full length), and only positions whose name is
not unique yet go on. Two things make that affordable at corpus size:

* Names are 64-bit hashes of the pair instead of places in a sorted list, so
  the names inside a document need no shuffle. Spark sorts and compares names
  only to find which are repeated, and who is first.
* Positions go through the rounds in groups. Every window of ``length`` bytes
  has an anchor, its first smallest 32-byte name; equal windows have equal
  anchors at equal offsets. Round one sorts the runs of windows that share an
  anchor: a run equal to an earlier one is repeated as a whole, a run whose
  anchor is unique is done. Round two sorts what is left in cells of at most
  eight windows by the 93 bytes they have in common, round three the single
  windows of the cells that are still undecided.

Each round is one shuffle by name. Equal groups of one block of documents are
folded into one row before it, so copies of one document meet as a row per
block. Undecided positions are looked up in the text again rather than carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scour.llm.common import id_text, stage, text_blocks
from scour.llm.jaccard_join import mix

ANCHOR = 32                     # bytes of an anchor's name
CELL = 8                        # windows of a cell
PLACE_BITS = 28                 # of an anchor's order key: the place breaks ties
#: Document ids up to this many are broadcast (8 bytes each); more are shuffled.
BROADCAST_ROWS = 2_000_000
ROW = "k long, h long, doc_id long, start long, n int, copies array<struct<doc_id:long,start:long>>"
COPY = pa.struct([("doc_id", pa.int64()), ("start", pa.int64())])


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + b + np.uint64(1))


def byte_names(seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2 ** 64, 256, dtype=np.uint64)


def names(raw: np.ndarray, lengths: list[int], table: np.ndarray) -> dict[int, np.ndarray]:
    """Names of the strings of the given lengths at every place, by doubling."""
    now, size = table[raw], 1
    out = {}
    for length in sorted(lengths):
        while 2 * size <= length:
            now, size = pair(now[:-size], now[size:]), 2 * size
        more = length - size
        out[length] = pair(now[:len(now) - more], now[more:]) if more else now
    return out


def runs(raw: np.ndarray, length: int, table: np.ndarray,
         ) -> tuple[dict[int, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """names by length; first and last window of every run, and its anchor."""
    named = names(raw, [ANCHOR, length - CELL + 1, length], table)
    g = named[ANCHOR]
    place = np.arange(len(g), dtype=np.uint64)
    low = np.uint64((1 << PLACE_BITS) - 1)
    key = (mix(g) >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | (place & low)
    span, size = length - ANCHOR + 1, 1
    while 2 * size <= span:
        key, size = np.minimum(key[:-size], key[size:]), 2 * size
    if size < span:
        key = np.minimum(key[:len(key) - (span - size)], key[span - size:])
    anchor = (key & low).astype(np.int64)
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    last = np.r_[first[1:], len(anchor)] - 1
    return named, first, last, anchor[first]


def groups(k: list, h: list, doc: list, start: list, n: list) -> pa.RecordBatch:
    """Rows of a block; equal ones folded into their first with the rest as copies."""
    if not k:
        k = h = start = n = doc = [np.zeros(0, np.int64)]
    k, h = np.concatenate(k).view(np.int64), np.concatenate(h).view(np.int64)
    doc, start, n = np.concatenate(doc), np.concatenate(start), np.concatenate(n)
    order = np.lexsort((start, doc, h))
    k, h, doc, start, n = k[order], h[order], doc[order], start[order], n[order]
    if len(h):                                            # a repeated row is no earlier start
        new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] != start[:-1])]
        k, h, doc, start, n = k[new], h[new], doc[new], start[new], n[new]
    lead = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    rest = np.ones(len(h), bool)
    rest[lead] = False
    many = np.diff(np.r_[lead, len(h)]) - 1
    offsets = np.r_[0, np.cumsum(many)].astype(np.int32)
    copies = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(
        [pa.array(doc[rest], pa.int64()), pa.array(start[rest], pa.int64())], fields=list(COPY)))
    return pa.RecordBatch.from_arrays(
        [pa.array(k[lead]), pa.array(h[lead]), pa.array(doc[lead], pa.int64()),
         pa.array(start[lead], pa.int64()), pa.array(n[lead], pa.int32()), copies],
        ["k", "h", "doc_id", "start", "n", "copies"])


def raw_bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


def run_rows(docs: DataFrame, length: int) -> DataFrame:
    """Round one: k the anchor's name, h the name of all bytes of the run."""
    table = byte_names()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_blocks(batches):
            rows: list[list] = [[], [], [], [], []]
            for d, t in zip(ids, texts, strict=True):
                raw = raw_bytes(t)
                if d is None or len(raw) < length:
                    continue
                named, first, last, anchor = runs(raw, length, table)
                full = named[length]
                shape = ((last - first) * 4096 + (anchor - first)).astype(np.uint64)
                for r, x in zip(rows, (named[ANCHOR][anchor],
                                       pair(pair(full[first], full[last]), shape),
                                       np.full(len(first), d, np.int64), first,
                                       (last - first + 1).astype(np.int32)), strict=True):
                    r.append(x)
            yield groups(*rows)

    return docs.mapInArrow(run, ROW)


def cell_rows(docs: DataFrame, length: int, single: bool) -> DataFrame:
    """Rounds two and three over the undecided groups (column ``todo`` of
    struct<start, n>): cells named by their common bytes, or single windows."""
    table = byte_names()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            size = 0
            for i in range(batch.num_rows):
                d, t, todo = (c[i].as_py() for c in batch.columns)
                raw = raw_bytes(t)
                if len(raw) < length:
                    continue
                starts = np.array([x["start"] for x in todo], np.int64)
                many = np.array([x["n"] for x in todo], np.int64)
                at = np.repeat(starts, many) + np.arange(many.sum()) - np.repeat(
                    np.cumsum(many) - many, many)
                if single:
                    full = names(raw, [length], table)[length]
                    k = h = full[at]
                    first, n = at, np.ones(len(at), np.int32)
                else:
                    named, lead, _, anchor = runs(raw, length, table)
                    full = named[length]
                    p = anchor[np.searchsorted(lead, at, side="right") - 1]
                    cell = (p - at) // CELL
                    cut = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (p[1:] != p[:-1])
                                               | (at[1:] != at[:-1] + 1)])
                    end = np.r_[cut[1:], len(at)] - 1
                    first, last = at[cut], at[end]
                    k = named[length - CELL + 1][p[cut] - CELL * cell[cut]]
                    shape = ((last - first) * 4096 + (p[cut] - first)).astype(np.uint64)
                    h = pair(pair(full[first], full[last]), shape)
                    n = (last - first + 1).astype(np.int32)
                for r, x in zip(rows, (k, h, np.full(len(k), d, np.int64), first, n), strict=True):
                    r.append(x)
                size += len(k)
                if size > 500_000:
                    yield groups(*rows)
                    rows, size = [[], [], [], [], []], 0
            yield groups(*rows)

    return docs.select("doc_id", "text", "todo").mapInArrow(run, ROW)


def decide(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(repeated, undecided): groups with an equal group earlier, with their
    copies; and first groups whose name k some different group has too."""
    by_name, by_group = Window.partitionBy("k"), Window.partitionBy("k", "h")
    at = F.struct("doc_id", "start")
    sorted_rows = stage(
        rows.repartition("k").select(
            "doc_id", "start", "n", "copies", (at > F.min(at).over(by_group)).alias("late"),
            (F.min("h").over(by_name) != F.max("h").over(by_name)).alias("mixed"))
        .filter("late or mixed or size(copies) > 0"), name)
    repeated = sorted_rows.filter("late").select("doc_id", "start", "n").unionByName(
        sorted_rows.filter("size(copies) > 0").select(F.explode("copies").alias("c"), "n")
        .select("c.doc_id", "c.start", "n"))
    return repeated, sorted_rows.filter("mixed and not late").select("doc_id", "start", "n")


def with_lists(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """Documents that have a list, joined to it. Their ids are broadcast first
    where they are few enough, so that only their texts are shuffled."""
    ids = stage(lists.select("doc_id"), "repeats-ids")
    if ids.count() <= BROADCAST_ROWS:
        docs = docs.join(F.broadcast(ids), "doc_id", "left_semi")
    return docs.join(lists, "doc_id")


def repeated_spans(df: DataFrame, length: int = 100, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """doc_id, spans: array of struct<start, end> of the bytes to remove, merged
    and in order, for every document that has some."""
    docs = id_text(df, id_col, text_col)
    first, undecided = decide(run_rows(docs, length), "repeats-runs")
    found = [first]
    for single in (False, True):
        todo = stage(undecided.groupBy("doc_id").agg(
            F.sort_array(F.collect_set(F.struct("start", "n"))).alias("todo")), "repeats-todo")
        more, undecided = decide(cell_rows(with_lists(docs, todo), length, single),
                                 "repeats-windows" if single else "repeats-cells")
        found.append(more)
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    ordered = every.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct(
        "start", (F.col("start") + F.col("n") - 1 + length).alias("end")))).alias("spans"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            out = []
            values = batch.column(1)
            for i in range(batch.num_rows):
                s = values[i].values
                start, end = (s.field(j).to_numpy(zero_copy_only=False) for j in (0, 1))
                reach = np.maximum.accumulate(end)
                cut = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]])
                out.append([{"start": a, "end": b} for a, b in zip(
                    start[cut].tolist(), reach[np.r_[cut[1:], len(start)] - 1].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)],
                                             ["doc_id", "spans"])

    return ordered.mapInArrow(merge, "doc_id long, spans array<struct<start:long,end:long>>")


def remove_repeats(df: DataFrame, length: int = 100, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) of every row.

    Null and empty texts and texts under ``length`` bytes keep all they have.
    Rows that repeat a doc_id are one document: neither is earlier than the
    other, and both come out (if their texts differ, what is found in either goes
    from both). A null doc_id takes no part and keeps all.
    Columns besides the two named are not read; an empty table gives no rows."""
    docs = id_text(df, id_col, text_col)
    spans = stage(repeated_spans(df, length, id_col, text_col), "repeats-spans")
    ids = spans.select("doc_id")
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, removed, many, kept = [], [], [], []
            for i in range(batch.num_rows):
                raw = (batch.column(1)[i].as_py() or "").encode("utf-8", "surrogatepass")
                own = batch.column(2)[i].as_py()
                parts, at = [], 0
                for s in own:
                    parts.append(raw[at:s["start"]])
                    at = s["end"]
                parts.append(raw[at:])
                kept.append(b"".join(parts))
                size.append(len(raw))
                removed.append(len(raw) - len(kept[-1]))
                many.append(len(own))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(many, pa.int64()), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    shape = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    touched = docs.join(ids, "doc_id", "left_semi").join(spans, "doc_id").select(
        "doc_id", "text", "spans").mapInArrow(cut, shape)
    whole = docs.join(ids, "doc_id", "left_anti").select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"),
        F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
        F.col("text").cast("binary").alias("kept"))
    return touched.unionByName(whole)


def digest(df: DataFrame, length: int = 100) -> DataFrame:
    return remove_repeats(df, length).select("doc_id", "n_bytes", "n_removed", "n_spans",
                                             F.sha2("kept", 256).alias("kept_sha256"))
