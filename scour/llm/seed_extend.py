"""Removal of repeated word passages by seed and extend.

Every word covered by a window of ``length`` consecutive words whose word sequence
also starts in a document of a smaller id goes.

* Seeds. Of the names of all ``seed``-word strings in a window the smallest, at its
  first place, is the window's anchor (winnowing). It follows from the window's own
  words, so equal windows have equal anchors at equal offsets, and documents that
  share a window meet on its anchor. Consecutive windows with one anchor are a run.
* Extension. A run is its anchor extended both ways, to the words of all its
  windows. Documents are joined on anchors; an anchor of one document only is done.
  A run equal to one of a smaller document is repeated as a whole. Where runs of
  one anchor differ, the extension goes on in steps: to the words that ``CELL``
  neighbouring windows have in common, then to the single windows. In every step
  those extended strings are compared, equal ones meet, and what is unique stops.
* Maximal repeats. The repeated windows of a document merge to maximal spans.

The extension compares names of extended strings, all partners of an anchor at once,
and not pair by pair: n documents with one passage cost n rows and not n * n
extensions. Names are pairs of 64-bit hashes (of the anchor and of the extended
string), so different strings meet with a chance of 1 in 10^38. Smallest ids are
aggregated before the shuffle and joined back. Equal texts are one class: only
that of the smallest id goes through the steps, its copies are repeated as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scour.llm.common import id_text, stage, text_blocks
from scour.llm.jaccard_join import mix
from scour.llm.substring_dedup import pair

CELL = 7                        # windows of a cell
#: Rows of two numbers up to this many are broadcast (about 50 bytes each); more are shuffled.
BROADCAST_ROWS = 1_000_000
BLOCK_CHARS = 2_000_000
ROW = "k long, h long, doc_id long, c long, start int, n int"


class _Names(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def split_words(text: str) -> list[bytes]:
    """Words parted by ASCII white space."""
    return text.encode("utf-8", "surrogatepass").split()


def class_of(words: list[bytes]) -> tuple[int, int]:
    """Two 64-bit numbers that name a word sequence."""
    whole = xxhash.xxh3_128_intdigest(b" ".join(words))
    return (whole >> 64) - (1 << 63), (whole & ((1 << 64) - 1)) - (1 << 63)


def names(words: list[bytes], lengths: list[int], known: dict) -> dict[int, np.ndarray]:
    """Names of the word strings of the given lengths at every place, by doubling."""
    now, size = mix(np.fromiter(map(known.__getitem__, words), np.uint64, len(words))), 1
    out = {}
    for length in sorted(lengths):
        while 2 * size <= length:
            now, size = pair(now[:-size], now[size:]), 2 * size
        more = length - size
        out[length] = pair(now[:len(now) - more], now[more:]) if more else now
    return out


def anchors(seeds: np.ndarray, span: int) -> np.ndarray:
    """For every window of ``span`` seeds the place of its first smallest name."""
    return (np.lib.stride_tricks.sliding_window_view(mix(seeds), span).argmin(axis=1)
            + np.arange(len(seeds) - span + 1))


def run_names(full: np.ndarray, first: np.ndarray, last: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The name of all words of runs of windows, with their place around the anchor."""
    shape = ((last - first) * 4096 + (place - first)).astype(np.uint64)
    return pair(pair(full[first], full[last]), shape)


def sized(docs: DataFrame, length: int, seed: int) -> DataFrame:
    """doc_id, c, c2 (the class of equal word sequences), n_words, seeds: a struct of
    anchor name k, run name h, first window and number of windows per run."""
    kind = pa.struct([("k", pa.int64()), ("h", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Names()
        for ids, texts in text_blocks(batches, BLOCK_CHARS):
            classes, sizes, rows, many = [], [], [], []
            for d, t in zip(ids, texts, strict=True):
                words = split_words(t)
                classes.append(class_of(words))
                sizes.append(len(words))
                if d is None or len(words) < length:
                    many.append(0)
                    continue
                named = names(words, [seed, length], known)
                place = anchors(named[seed], length - seed + 1)
                first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
                last = np.r_[first[1:], len(place)] - 1
                p = place[first]
                rows.append((named[seed][p], run_names(named[length], first, last, p), first, last - first + 1))
                many.append(len(first))
            flat = [np.concatenate([r[i] for r in rows]) if rows else np.zeros(0, np.int64) for i in range(4)]
            seeds = pa.StructArray.from_arrays(
                [pa.array(flat[0].view(np.int64)), pa.array(flat[1].view(np.int64)),
                 pa.array(flat[2], pa.int32()), pa.array(flat[3], pa.int32())], fields=list(kind))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([c[0] for c in classes], pa.int64()),
                 pa.array([c[1] for c in classes], pa.int64()), pa.array(sizes, pa.int64()),
                 pa.ListArray.from_arrays(np.r_[0, np.cumsum(many)].astype(np.int32), seeds)],
                ["doc_id", "c", "c2", "n_words", "seeds"])

    return docs.mapInArrow(run, "doc_id long, c long, c2 long, n_words long, "
                                "seeds array<struct<k:long,h:long,start:int,n:int>>")


def extended(docs: DataFrame, length: int, seed: int, cells: bool) -> DataFrame:
    """The next step of the undecided runs (column todo of struct<c, start, n>): cells
    named by the words their windows have in common, or single windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Names()
        for batch in batches:
            for i in range(batch.num_rows):
                d, t, todo = (c[i].as_py() for c in batch.columns)
                words = split_words(t)
                own = class_of(words)[0]
                starts = np.array([x["start"] for x in todo if x["c"] == own], np.int64)
                many = np.array([x["n"] for x in todo if x["c"] == own], np.int64)
                if not len(starts) or len(words) < length:
                    continue
                at = np.repeat(starts, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                common = length - CELL + 1
                named = names(words, [seed, common, length], known)
                place = anchors(named[seed], length - seed + 1)[at]
                if cells:
                    cell = (place - at) // CELL
                    cut = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (place[1:] != place[:-1])
                                               | (at[1:] != at[:-1] + 1)])
                    first, last, place, cell = at[cut], at[np.r_[cut[1:], len(at)] - 1], place[cut], cell[cut]
                    k = named[common][place - CELL * cell]
                    h = run_names(named[length], first, last, place)
                else:
                    first = last = at
                    k, h = named[seed][place], named[length][at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k.view(np.int64)), pa.array(h.view(np.int64)),
                     pa.array(np.full(len(k), d, np.int64)), pa.array(np.full(len(k), own, np.int64)),
                     pa.array(first, pa.int32()), pa.array(last - first + 1, pa.int32())],
                    ["k", "h", "doc_id", "c", "start", "n"])

    return docs.select("doc_id", "text", "todo").mapInArrow(run, ROW)


def bounded(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written, and broadcast where they are few enough."""
    rows = stage(rows, name)
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def decide(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repeated, undecided): strings that a smaller document has too; and those first
    of their kind whose name k several documents have with different strings h."""
    keys = (rows.groupBy("k").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"),
                                  (F.min("h") != F.max("h")).alias("mixed"))
            .filter("lo < hi").select("k", "mixed"))
    met = stage(rows.join(bounded(keys, "extend-keys"), "k"), "extend-met")
    first = met.groupBy("k", "h").agg(F.min("doc_id").alias("first"))
    placed = stage(met.join(bounded(first, "extend-first"), ["k", "h"]).select(
        "doc_id", "c", "start", "n", "mixed", (F.col("doc_id") > F.col("first")).alias("late"))
        .filter("late or mixed"), "extend-placed")
    return (placed.filter("late").select("doc_id", "c", "start", "n"),
            placed.filter("not late").select("doc_id", "c", "start", "n"))


def with_lists(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """Documents that have a list, joined to it; other texts are not shuffled where
    the ids of those are few enough to be broadcast."""
    return docs.join(bounded(lists.select("doc_id"), "extend-ids"), "doc_id", "left_semi").join(
        lists, "doc_id")


def repeated_windows(docs: DataFrame, runs: DataFrame, length: int, seed: int) -> DataFrame:
    """doc_id, c, spans: array of struct<start, end> of the words to remove, which may
    overlap, for every text that has some. ``runs``: rows as of ``sized``."""
    rows = stage(runs.select("doc_id", "c", F.explode("seeds").alias("s")).select(
        "s.k", "s.h", "doc_id", "c", "s.start", "s.n"), "extend-runs")
    repeated, undecided = decide(rows)
    for cells in (True, False):
        todo = stage(undecided.groupBy("doc_id").agg(
            F.sort_array(F.collect_set(F.struct("c", "start", "n"))).alias("todo")), "extend-todo")
        more, undecided = decide(stage(extended(with_lists(docs, todo), length, seed, cells), "extend-rows"))
        repeated = repeated.unionByName(more)
    return repeated.groupBy("doc_id", "c").agg(F.sort_array(F.collect_set(F.struct(
        "start", (F.col("start") + F.col("n") - 1 + length).alias("end")))).alias("spans"))


def cut_words(words: list[bytes], spans: list[dict]) -> list[bytes]:
    """The words outside the spans, which are in order of their starts."""
    kept, at = [], 0
    for s in spans:
        if s["start"] > at:
            kept += words[at:s["start"]]
        at = max(at, s["end"])
    return kept + words[at:]


def kept_words(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept of texts with their fates: array of struct<c,
    gone, spans>, or null where all words stay."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, texts = [], [], []
            for i in range(batch.num_rows):
                words = kept = split_words(batch.column(1)[i].as_py())
                fates = batch.column(2)[i].as_py()
                if fates and words:
                    own = class_of(words)[0]
                    for f in fates:
                        if f["c"] == own:
                            kept = [] if f["gone"] else cut_words(words, f["spans"] or [])
                sizes.append(len(words))
                removed.append(len(words) - len(kept))
                texts.append(b" ".join(kept).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(texts, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return docs.select("doc_id", "text", "fates").mapInArrow(
        run, "doc_id long, n_words long, n_removed long, kept string")


def remove_repeats(df: DataFrame, length: int = 50, seed: int = 25, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space) of
    every row. ``length`` is at least ``seed`` + 1 and at least CELL.

    A null or empty text has no words; texts under ``length`` words keep all. Rows of
    one doc_id are no smaller document to each other and are judged each by its own
    words. A null doc_id takes no part and keeps all. Columns besides the two named
    are not read; an empty table gives no rows. Texts of any length are handled whole,
    one at a time."""
    docs = id_text(df, id_col, text_col)
    every = stage(sized(docs, length, seed), "extend-sized")
    known = every.filter("doc_id is not null")
    long = known.filter(F.col("n_words") >= length)
    equal = bounded(long.groupBy("c", "c2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
                    .filter("least < most").drop("most"), "extend-classes")
    ranked = long.join(equal, ["c", "c2"], "left")
    copies = stage(ranked.filter("doc_id > least").select("doc_id", "c", "n_words"), "extend-copies")
    runs = ranked.filter("least is null or doc_id = least").select("doc_id", "c", "seeds")
    spans = stage(repeated_windows(docs, runs, length, seed), "extend-spans")

    again = stage(known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1")
                  .select("doc_id"), "extend-again")
    several = again.count() > 0
    apart = copies.join(again, "doc_id", "left_anti") if several else copies
    fates = spans.select("doc_id", "c", F.lit(False).alias("gone"), "spans")
    if several:                                           # a copy among other rows of its id
        none = F.lit(None).cast("array<struct<start:int,end:int>>")
        fates = fates.unionByName(copies.join(again, "doc_id", "left_semi").select(
            "doc_id", "c", F.lit(True).alias("gone"), none.alias("spans")).distinct())
    fates = stage(fates.groupBy("doc_id").agg(F.collect_list(F.struct("c", "gone", "spans")).alias("fates")),
                  "extend-fates")
    settled = bounded(fates.select("doc_id").unionByName(apart.select("doc_id")), "extend-settled")
    whole = docs.join(settled, "doc_id", "left_anti").withColumn(
        "fates", F.lit(None).cast(fates.schema["fates"].dataType))
    return (kept_words(with_lists(docs, fates)).unionByName(kept_words(whole))
            .unionByName(apart.select("doc_id", "n_words", F.col("n_words").alias("n_removed"),
                                      F.lit("").alias("kept"))))


def digest(df: DataFrame, length: int = 50) -> DataFrame:
    return remove_repeats(df, length).select("doc_id", "n_words", "n_removed",
                                             F.sha2("kept", 256).alias("kept_sha256"))
