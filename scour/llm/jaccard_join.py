"""N-gram Jaccard self-join by vertical partitioning.

A document is its set of distinct word n-grams, each a 64-bit hash; the global
n-gram order is the order of the hashes, which spreads evenly. The order is cut
into fragments, and a set into one segment per fragment:

* Candidates. Two sets of Jaccard similarity >= t differ in at most d =
  (1 - t) / (1 + t) * (na + nb) n-grams. With more than d fragments at least one
  segment is the same in both, so sets meet on equal (fragment, segment) keys:
  a conjunction of several n-grams, which a passage shared by many unlike
  documents does not satisfy. How many fragments are needed follows from the
  size, so sizes are cut into levels; a set meets others at its own level and,
  where a larger partner may be there, at the next. ``spare`` fragments
  outweigh segments that are empty; sets with still more empty segments meet on
  those as well.
* Verification. The order is cut into ``FRAGMENTS`` equal parts; the partial
  overlaps of a pair are counted part by part and summed per pair. Parity
  bitmaps drop most unlike pairs, and no linked one, before sets are moved.

Equal sets are one class from the start. Within a bucket not all pairs are
verified: only links that join different components can matter. First every
class is verified with the member it shares most buckets with; components
follow; then, while components merge, whatever is outside a bucket's largest
component is verified with members drawn from it, and at last with all members
of other components that can reach the similarity. So a group of n alike documents costs about n
pairs, and no link between different components is missed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scour.llm.common import id_text, stage, text_blocks
from scour.llm.components import components

FRAGMENTS = 8                   # of the verification; a power of two
LEVEL_RATIO = 1.4
#: Rows of up to this many bytes (8 a column) are broadcast; more are shuffled. The
#: driver holds a broadcast table at several times that, and those of earlier turns
#: until its garbage is collected.
BROADCAST_BYTES = 8_000_000
#: 64-bit words of the parity bitmap that rules pairs out inside the join.
WORDS = 16
#: Keys of a class that are compared to make a pair in its first common bucket only.
EARLIER = 8


#: Characters of texts, and hashes of words, that a task holds at once.
BLOCK_CHARS, HASHES = 1_000_000, 100_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: spreads 64-bit values evenly."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def ngram_set(text: str, n: int, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of a text (A-Z lower-cased,
    words parted by ASCII white space); with fewer words the whole sequence is one."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(n, len(words))
    out = np.full(len(w) - size + 1, size, np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + w[k:len(w) - size + 1 + k]
        out ^= out >> np.uint64(29)
    return np.unique(mix(out))


def class_id(grams: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63)


def most_different(size: int, percent: int) -> int:
    """Most n-grams in which two linked sets of up to ``size`` can differ."""
    return 2 * size * (100 - percent) // (100 + percent)


@lru_cache(maxsize=4096)
def level(k: int, percent: int) -> tuple[int, int, int, int]:
    """(smallest size, first size beyond, fragments, spare) of level k."""
    lo = 1 if k == 0 else level(k - 1, percent)[1]
    hi = max(lo + 1, int(lo * max(LEVEL_RATIO, 100 / percent + 0.05)))
    d = most_different(hi - 1, percent)
    if d == 0:
        return lo, hi, 0, 0                               # linked sets of this size are equal
    spare = 0
    for _ in range(4):
        count = d + 1 + spare
        empty = count * math.exp(-lo * percent / 100 / count)
        spare = math.ceil(empty + 4 * math.sqrt(empty)) + 1
    return lo, hi, d + 1 + spare, spare


def levels_of(size: int, percent: int) -> list[int]:
    """The level of a set, and the next if a linked set may be there."""
    k = 0
    while level(k, percent)[1] <= size:
        k += 1
    return [k, k + 1] if size * 100 // percent >= level(k, percent)[1] else [k]


def segment_keys(grams: np.ndarray, percent: int) -> np.ndarray:
    """Keys of the segments of a set at its levels."""
    out = []
    high = (grams >> np.uint64(32)).astype(np.uint64)
    for k in levels_of(len(grams), percent):
        _, _, count, spare = level(k, percent)
        if not count:
            continue
        fragment = ((high * np.uint64(count)) >> np.uint64(32)).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, fragment[1:] != fragment[:-1]])
        used = fragment[starts]
        sums = np.add.reduceat(mix(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts)
        tag = mix(used.astype(np.uint64) + np.uint64((k + 1) << 32))
        out.append(mix(sums ^ tag))
        if count - len(used) > spare:                     # many empty segments: meet on them too
            empty = np.setdiff1d(np.arange(count), used)
            out.append(mix(empty.astype(np.uint64) + np.uint64((k + 1) << 40)))
    return np.concatenate([*out, np.zeros(0, np.uint64)])


def classes(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, cid (the class of equal sets; null without words)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for ids, texts in text_blocks(batches, BLOCK_CHARS):
            if len(hashes) > HASHES:
                hashes.clear()
            sets = [ngram_set(t, n, hashes) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([class_id(s) if len(s) else None for s in sets], pa.int64())],
                ["doc_id", "n_shingles", "cid"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, cid long")


def keyed(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """key, cid, n: a row per segment of every class; copies within a task once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = _Hashes(), set()
        for _, texts in text_blocks(batches, BLOCK_CHARS):
            if len(hashes) > HASHES:
                hashes.clear()
            keys, cids, sizes, counts = [], [], [], []
            for t in texts:
                s = ngram_set(t, n, hashes)
                if not len(s) or (c := class_id(s)) in seen:
                    continue
                seen.add(c)
                k = segment_keys(s, percent)
                keys.append(k)
                cids.append(c)
                sizes.append(len(s))
                counts.append(len(k))
            flat = np.concatenate([*keys, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat), pa.array(np.repeat(np.array(cids, np.int64), counts)),
                 pa.array(np.repeat(np.array(sizes, np.int32), counts))], ["key", "cid", "n"])

    return docs.mapInArrow(run, "key long, cid long, n int")


def parity(grams: np.ndarray, bits: int = 0) -> bytes:
    """Parity bitmap of a set: a power of two of at least two bits per n-gram, each
    flipped by the n-grams that fall on it. The bits in which two bitmaps differ
    are at most the n-grams in which the sets differ. A larger bitmap folds to a
    smaller one by XOR of its halves."""
    bits = bits or max(64, 1 << (2 * len(grams) - 1).bit_length())
    flips = np.bincount((mix(grams) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def bits_apart(a: bytes, b: bytes) -> int:
    """Bits in which two parity bitmaps differ, folded to one size."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) > len(y):
        x, y = y, x
    while len(y) > len(x):
        y = y[:len(y) // 2] ^ y[len(y) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


def segments(docs: DataFrame, n: int) -> DataFrame:
    """cid, n, fragment, grams: the sets of the given documents, cut into
    FRAGMENTS; and for each a row of fragment -1 with its parity bitmap, and one of
    fixed size in the columns w0, w1, ..."""
    shift = np.uint64(64 - FRAGMENTS.bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, none = _Hashes(), [None] * (1 + WORDS)
        for _, texts in text_blocks(batches, BLOCK_CHARS):
            if len(hashes) > HASHES:
                hashes.clear()
            rows = []
            for t in texts:
                s = ngram_set(t, n, hashes)
                cuts = np.searchsorted((s >> shift).astype(np.int64), np.arange(FRAGMENTS + 1))
                cid = class_id(s)
                fixed = np.frombuffer(parity(s, 64 * WORDS), np.int64).tolist()
                rows.append((cid, len(s), -1, None, parity(s), *fixed))
                rows += [(cid, len(s), f, s[cuts[f]:cuts[f + 1]].view(np.int64), *none)
                         for f in range(FRAGMENTS) if cuts[f] < cuts[f + 1]]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary(),
                     *[pa.int64()] * WORDS]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)],
                ["cid", "n", "fragment", "grams", "bits", *(f"w{i}" for i in range(WORDS))])

    return docs.mapInArrow(run, "cid long, n int, fragment int, grams array<long>, bits binary, "
                           + ", ".join(f"w{i} long" for i in range(WORDS)))


def segments_once(docs: DataFrame, sized: DataFrame, reps: DataFrame, n: int) -> DataFrame:
    """``segments`` of every class in ``reps`` (cid, doc_id), once each. A doc_id of
    several rows may bring its class repeatedly, and other classes besides."""
    def of(ids: DataFrame) -> DataFrame:
        return segments(docs.join(bounded(ids), "doc_id", "left_semi").select("doc_id", "text"), n)

    again = stage(sized.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
                  .join(reps, "doc_id").select("doc_id", "cid"), "jaccard-repeated")
    if again.isEmpty():
        return of(reps.select("doc_id"))
    once = stage(reps.join(bounded(again.select("doc_id").distinct()), "doc_id", "left_anti")
                 .select("doc_id"), "jaccard-single")
    repeated = (of(stage(again.select("doc_id").distinct(), "jaccard-repeated-ids"))
                .join(bounded(again.select("cid")), "cid", "left_semi"))
    return of(once).unionByName(repeated.dropDuplicates(["cid", "fragment"]))


def near_enough(pairs: DataFrame, cut: DataFrame, percent: int) -> DataFrame:
    """The pairs whose bitmaps differ in no more bits than linked sets can differ
    in n-grams. It drops no linked pair and most others, so that few sets move."""
    bits = cut.filter("fragment = -1")
    both = (pairs.join(bits.select("cid", F.col("n").alias("na"), F.col("bits").alias("ba")), "cid")
            .join(bits.select(F.col("cid").alias("other"), F.col("n").alias("nb"),
                              F.col("bits").alias("bb")), "other")
            .select("cid", "other", "na", "nb", "ba", "bb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb, ba, bb = (c.to_pylist() for c in batch.columns[2:])
            keep = [bits_apart(x, y) * (100 + percent) <= (i + j) * (100 - percent)
                    for i, j, x, y in zip(na, nb, ba, bb, strict=True)]
            yield batch.select(["cid", "other"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "cid long, other long")


def bounded(rows: DataFrame) -> DataFrame:
    """A written table of numbers, broadcast where it is small enough."""
    return F.broadcast(rows) if rows.count() * 8 * len(rows.columns) <= BROADCAST_BYTES else rows


def verify(pairs: DataFrame, cut: DataFrame, percent: int) -> DataFrame:
    """The pairs (cid, other) whose similarity reaches ``percent``: partial
    overlaps are counted in every fragment and summed per pair.

    Bitmaps rule most unlike pairs out first. The pairs go to the segments of
    ``cid`` where these lie; only the segments that are in a pair move, once, to
    those of ``other``."""
    pairs = stage(near_enough(stage(pairs, "jaccard-candidates"), cut, percent), "jaccard-pairs")
    cut = cut.filter("fragment >= 0").select("cid", "n", "fragment", "grams")
    others = stage(pairs.select(F.col("other").alias("cid")).distinct(), "jaccard-others")
    left = cut.join(bounded(pairs), "cid").select(
        "cid", "other", "fragment", F.col("n").alias("na"), F.col("grams").alias("ga"))
    right = cut.join(bounded(others), "cid", "left_semi").select(
        F.col("cid").alias("other"), "fragment", F.col("n").alias("nb"), F.col("grams").alias("gb"))
    return (left.join(right, ["other", "fragment"])
            .groupBy("cid", "other", "na", "nb")
            .agg(F.sum(F.size(F.array_intersect("ga", "gb"))).alias("same"))
            .filter(100 * F.col("same") >= percent * (F.col("na") + F.col("nb") - F.col("same")))
            .select(F.col("cid").alias("a"), F.col("other").alias("b")))


def outsiders(undecided: DataFrame) -> int:
    """Rows outside the largest component of their bucket."""
    many = undecided.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("many")).groupBy("key").agg(
        (F.sum("many") - F.max("many")).alias("out"))
    return many.agg(F.coalesce(F.sum("out"), F.lit(0))).first()[0]


def join_components(df: DataFrame, n: int = 4, percent: int = 85, settle: float = 0.8,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links).

    Documents link when 100 * |A & B| >= percent * |A | B|. A null, empty or
    blank text has an empty set and is linked with nothing; equal texts are
    linked; repeated rows of a doc_id come out repeated; columns besides the
    two named are not read; an empty table gives no rows. Hashes are of 64
    bits: two different n-grams or sets are taken for one with a chance of
    about 1 in 10^19 for each pair of them.

    Members are drawn while a turn leaves less than the share ``settle`` of the rows
    outside their bucket's largest component; what is left then is verified in full."""
    docs = id_text(df, id_col, text_col)
    sized = stage(classes(docs, n), "jaccard-classes")
    bucket = Window.partitionBy("key")
    members = stage(keyed(docs, n, percent)
                    .select("key", "cid", "n", F.min("cid").over(bucket).alias("lo"),
                            F.max("cid").over(bucket).alias("hi"))
                    .filter("lo < hi").select("key", "cid", "n", "lo"), "jaccard-buckets")
    if members.isEmpty():                                 # no two classes meet: there are no links
        alone = sized.filter("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("component_id"))
        return labelled_by(sized, alone)
    reps = stage(sized.join(members.select("cid").distinct(), "cid", "left_semi")
                 .groupBy("cid").agg(F.min("doc_id").alias("doc_id")), "jaccard-representatives")
    cut = stage(segments_once(docs, sized, reps, n), "jaccard-segments")

    marks = bounded(cut.filter("fragment = -1").select("cid", *[f"w{i}" for i in range(WORDS)]))
    links = stage(verify(nearest(members, "lo"), cut, percent), "jaccard-links")
    undecided, turn, last, before = members, 0, False, None
    while True:
        comps = stage(components(links, "jaccard-components"), "jaccard-components")
        if last:
            break
        placed = undecided.drop("comp").join(
            bounded(comps.select(F.col("node").alias("cid"), F.col("component").alias("comp"))),
            "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
        undecided = stage(
            placed.withColumns({"first": F.min("comp").over(bucket), "last": F.max("comp").over(bucket)})
            .filter("first < last").select("key", "cid", "n", "comp").distinct(), "jaccard-undecided")
        outside = outsiders(undecided)
        if not outside:                                   # every bucket's classes are of one component
            break
        last = before is not None and outside > before * settle
        before, turn = outside, turn + 1
        pairs = remaining(undecided, marks, percent) if last else drawn(undecided, marks, percent, turn)
        # a component is as well told by the links to its smallest class as by all of its links
        links = comps.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(
            stage(verify(pairs, cut, percent), "jaccard-links"))
    labelled = sized.select("cid", "doc_id").join(
        comps.withColumnRenamed("node", "cid"), "cid", "left").select(
        "doc_id", "cid", F.coalesce("component", "cid").alias("comp"))
    first = labelled.filter("cid is not null").groupBy("comp").agg(
        F.min("doc_id").alias("component_id"))
    by_class = (comps.select(F.col("node").alias("cid"), F.col("component").alias("comp"))
                .unionByName(sized.select("cid").filter("cid is not null").distinct()
                             .join(comps.select(F.col("node").alias("cid")), "cid", "left_anti")
                             .select("cid", F.col("cid").alias("comp")))
                .join(first, "comp").select("cid", "component_id"))
    return labelled_by(sized, by_class)


def labelled_by(sized: DataFrame, by_class: DataFrame) -> DataFrame:
    """The documents with the component of their class; one without words is its own."""
    return sized.join(by_class, "cid", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def sizes_allow(percent: int) -> Column:
    return 100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")


def alike(percent: int) -> Column:
    """Can two rows (n, w0, ... and n2, o0, ...) reach the similarity, by their sizes
    and by the bits in which their bitmaps of fixed size differ? Inside a join it
    keeps unlike pairs of a bucket from becoming rows."""
    apart = F.lit(0)
    for i in range(WORDS):
        apart = apart + F.bit_count(F.col(f"w{i}").bitwiseXOR(F.col(f"o{i}")))
    return (sizes_allow(percent)
            & (apart * (100 + percent) <= (F.col("n") + F.col("n2")) * (100 - percent)))


def as_other(marks: DataFrame) -> DataFrame:
    return marks.select(F.col("cid").alias("other"), *[F.col(f"w{i}").alias(f"o{i}") for i in range(WORDS)])


def nearest(rows: DataFrame, other: str) -> DataFrame:
    """(cid, other): for each class the one it shares most buckets with."""
    return most_shared(rows.filter(F.col("cid") != F.col(other)).groupBy("cid", F.col(other).alias("other"))
                       .agg(F.count(F.lit(1)).alias("shared")))


def most_shared(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("cid").agg(F.max_by("other", F.struct("shared", "other")).alias("other"))


def drawn(undecided: DataFrame, marks: DataFrame, percent: int, turn: int) -> DataFrame:
    """Each class outside its bucket's largest component with a member of that
    component and one of the bucket, drawn anew by hash in every turn: of those
    that can reach the similarity, the one it shares most buckets with."""
    one = F.struct(F.col("cid").alias("other"), F.col("comp").alias("comp2"), F.col("n").alias("n2"))
    by_hash = F.xxhash64("cid", F.lit(turn))
    each = stage(undecided.groupBy("key", "comp").agg(
        F.count(F.lit(1)).alias("many"), F.min(F.struct(by_hash.alias("h"), one.alias("one"))).alias("d")),
        "jaccard-drawn")
    draw = each.groupBy("key").agg(
        F.max_by("comp", F.struct("many", "comp")).alias("big"),
        F.max_by("d.one", F.struct("many", "comp")).alias("a"), F.min("d")["one"].alias("b"))
    small = undecided.join(draw.select("key", "big", F.explode(F.array("a", "b")).alias("one")), "key").filter(
        "comp != big").select("key", "cid", "n", "comp", "one.*").filter("comp != comp2")
    pairs = stage(small.filter(sizes_allow(percent)).groupBy("cid", "n", "other", "n2").agg(
        F.count(F.lit(1)).alias("shared")), "jaccard-draws")
    met = pairs.join(as_other(marks), "other").join(marks, "cid").filter(alike(percent))
    return most_shared(met)


def with_earlier(undecided: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows with the bitmap of their class and with ``earlier``, the EARLIER keys of
    the class before this one in the order of the keys. A class has a key per segment,
    so its keys fit in one row."""
    keys = undecided.groupBy("cid", "n", "comp").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    bits = [f"w{i}" for i in range(WORDS)]
    return keys.join(marks, "cid").select(
        "cid", "n", "comp", *bits, "keys", F.posexplode("keys").alias("at", "key")).select(
        "key", "cid", "n", "comp", *bits,
        F.slice("keys", F.greatest(F.col("at") - EARLIER + 1, F.lit(1)), F.least("at", F.lit(EARLIER)))
        .alias("earlier"))


def remaining(undecided: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """All pairs of classes that share a bucket, are of different components and
    can reach the similarity: one of the two is always outside the bucket's
    largest component. A pair that shares many buckets is made in the first, and
    in others only where the keys just before are not shared."""
    rows = stage(with_earlier(undecided, marks), "jaccard-remaining")
    big = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("many")).groupBy("key").agg(
        F.max_by("comp", F.struct("many", "comp")).alias("big"))
    other = rows.select("key", F.col("cid").alias("other"), F.col("n").alias("n2"), F.col("comp").alias("comp2"),
                        F.col("earlier").alias("earlier2"),
                        *[F.col(f"w{i}").alias(f"o{i}") for i in range(WORDS)])
    small = rows.join(big, "key").filter("comp != big")
    return small.join(other, (small["key"] == other["key"]) & (F.col("comp") != F.col("comp2"))
                      & alike(percent) & ~F.arrays_overlap("earlier", "earlier2")).select(
        F.least("cid", "other").alias("cid"), F.greatest("cid", "other").alias("other")).distinct()
