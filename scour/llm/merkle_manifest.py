"""Merkle manifest of a table, and inclusion proofs of its rows by an Octopus
multiproof.

Every row is a leaf. The leaves of one source, in the order of their ids, form a
tree in which every ``BRANCH`` consecutive nodes (the last run may be shorter)
become their digest until one node, the subroot, remains; the subroots, in the
order of their sources (null first, then by UTF-8 bytes), form the top tree, whose
last node is the root. A digest is the lowercase hex SHA-256 of the concatenated
inputs. A node is named by its coordinate (tree, level, idx); the top tree is
tree ``TOP``, and the leaf ``idx`` of it is the subroot of tree ``idx``.

* Building. Leaves are numbered by a range partitioning. Blocks of ``SPAN``
  consecutive leaves, a power of the branching, are whole subtrees: each is
  derived in one task, and the roots of the blocks are the leaves of the next
  round, so a tree over 10^12 rows takes four rounds. Small trees share a group.
* Proofs. The chosen leaves of a block are one leaf partition. It lists the
  coordinates that its proofs need and that it can't derive from its own leaves:
  level by level the missing children of the parents of what it knows (the
  Octopus rule), which is the minimal union over its leaves. All partitions'
  coordinates are fetched by one join with the nodes. Each partition then derives
  the interior nodes its leaves share, once, and expands the proof of every leaf
  from them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from scour.llm.common import stage

BRANCH = 3
LEVELS = 7
SPAN = BRANCH ** LEVELS         # leaves of a block
TOP = -1                        # number of the tree over the subroots
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Coordinates or trees up to this many are broadcast (about 100 bytes each).
BROADCAST_ROWS = 500_000
SALTS = 16
COORDINATE = ["tree", "level", "idx"]
NODE = "tree long, level int, idx long, digest string"


@dataclass
class Manifest:
    """``leaves``: a row per row of the table, with its columns and tree, idx (place in
    the tree), n (leaves of the tree), own, block (its leaf partition); ``nodes``:
    tree, level, idx, digest of every node; ``trees`` their number; ``root``: the
    digest over everything, None for an empty table."""
    leaves: DataFrame
    nodes: DataFrame
    trees: int
    root: str | None


def digest(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def encoded(value: Column) -> Column:
    """``-`` for null, else byte count, colon and value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def numbered(df: DataFrame, order: list[str], out: str, name: str) -> DataFrame:
    """``df`` with the 0-based place of each row in the order of the given columns
    (nulls first). Rows are dealt by ranges of the order, so that no value of one
    column is a task of its own; the places inside a partition are written once,
    and the partitions' counts (a row each) are added up."""
    ranged = (df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order])
              .sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
              .withColumn("_at", F.monotonically_increasing_id()))
    ranged = stage(ranged, name).withColumns(
        {"_part": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND((1 << 33) - 1)})
    counts = ranged.groupBy("_part").agg((F.max("_at") + 1).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return (ranged.join(F.broadcast(starts), "_part")
            .withColumn(out, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start"))


def spread_join(rows: DataFrame, small: DataFrame, keys: list[str], count: int) -> DataFrame:
    """``rows`` with the columns of ``small`` (one row a key, null equal to null):
    broadcast up to a bound, else by a shuffle that parts every key by salts."""
    small = small.select(*[F.col(k).alias(f"_{k}") for k in keys],
                         *[c for c in small.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & rows[k].eqNullSafe(small[f"_{k}"])
    gone = [f"_{k}" for k in keys]
    if count <= BROADCAST_ROWS:
        return rows.join(F.broadcast(small), on).drop(*gone)
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    small = small.withColumn("_salted", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    on = rows["_salt"] == small["_salted"]
    for k in keys:
        on = on & rows[k].eqNullSafe(small[f"_{k}"])
    return rows.join(small, on).drop("_salt", "_salted", *gone)


def above(digests: list[str], levels: int) -> list[list[str]]:
    """The nodes of ``levels`` levels over a run of nodes, level by level."""
    out = []
    for _ in range(levels):
        digests = [digest(digests[i:i + BRANCH]) for i in range(0, len(digests), BRANCH)]
        out.append(digests)
    return out


def height(n: int) -> int:
    """Levels of a tree above its n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // BRANCH), levels + 1
    return levels


def climb(rows: DataFrame) -> DataFrame:
    """The nodes over rows of (own, block, tree, level, idx, n, digest), n being the
    nodes of the tree on that level: to the root in trees of up to SPAN, else over
    LEVELS levels. Every group is a block or a few small trees."""
    def run(table: pa.Table) -> pa.Table:
        tree, level, idx, n = (table[c].to_numpy() for c in ("tree", "level", "idx", "n"))
        order = np.lexsort((idx, tree))
        digests = table["digest"].take(pa.array(order)).to_pylist()
        tree, level, idx, n = tree[order], level[order], idx[order], n[order]
        cut = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]])
        out: list[tuple] = []
        for a, b in zip(cut.tolist(), np.r_[cut[1:], len(tree)].tolist(), strict=True):
            first, base, number = int(idx[a]), int(level[a]), int(tree[a])
            for up, nodes in enumerate(above(digests[a:b], min(height(int(n[a])), LEVELS)), 1):
                first //= BRANCH
                out += [(number, base + up, first + i, d) for i, d in enumerate(nodes)]
        names = [*COORDINATE, "digest"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string()]
        return pa.table({c: pa.array([r[i] for r in out], k)
                         for i, (c, k) in enumerate(zip(names, kinds, strict=True))})

    return rows.select("own", "block", *COORDINATE, "n", "digest").groupBy(
        "own", "block").applyInArrow(run, NODE)


def all_levels(rows: DataFrame, most: int) -> list[DataFrame]:
    """``climb`` until the largest tree, of ``most`` leaves, has its root: the nodes of
    each round, written."""
    out, sizes = [], rows.select("tree", "n").distinct()
    while most > 1:
        out.append(stage(climb(rows), "merkle-nodes"))
        if most <= SPAN:
            break
        top = out[-1].groupBy("tree").agg(F.max("level").alias("level"),
                                          (F.max(F.struct("level", "idx"))["idx"] + 1).alias("n"))
        sizes = stage(top.filter("n > 1"), "merkle-trees")
        rows = spread_join(out[-1], sizes.withColumnRenamed("level", "_level"), ["tree"],
                           sizes.count()).filter("level = _level").withColumns(
            {"own": F.col("tree"), "block": F.floor(F.col("idx") / SPAN)})
        most = -(-most // SPAN)
    return out


def build(leaves: DataFrame, tree_col: str = "source", order_col: str = "doc_id",
          leaf_col: str = "leaf") -> Manifest:
    """The manifest of a table of leaf digests. Rows of one order value in a tree are
    ordered by their digests; null order values come first. More columns are carried."""
    placed = numbered(leaves, [tree_col, order_col, leaf_col], "_g", "merkle-ordinals")
    trees = stage(placed.groupBy(tree_col).agg(F.min("_g").alias("_first"),
                                               F.count(F.lit(1)).alias("n")), "merkle-trees")
    trees = stage(numbered(trees, [tree_col], "tree", "merkle-trees"), "merkle-trees")
    count, most = trees.agg(F.count(F.lit(1)), F.max("n")).first()
    placed = spread_join(placed, trees, [tree_col], count).withColumn("idx", F.col("_g") - F.col("_first"))
    alone = F.col("n") > SPAN
    placed = stage(placed.withColumns({
        "own": F.when(alone, F.col("tree")).otherwise(F.lit(TOP)),
        "block": F.floor(F.when(alone, F.col("idx")).otherwise(F.col("_first")) / SPAN),
    }).drop("_g", "_first"), "merkle-leaves")
    level = F.lit(0).alias("level")
    base = placed.select("own", "block", "tree", level, "idx", "n", F.col(leaf_col).alias("digest"))
    parts = [base.select(*COORDINATE, "digest"), *all_levels(base, most or 0)]
    nodes = parts[0]
    for part in parts[1:]:
        nodes = nodes.unionByName(part)
    subroots = stage(nodes.groupBy("tree").agg(F.max_by("digest", "level").alias("digest")),
                     "merkle-subroots")
    top = subroots.select(F.lit(TOP).cast("long").alias("own"), F.floor(F.col("tree") / SPAN).alias("block"),
                          F.lit(TOP).cast("long").alias("tree"), level, F.col("tree").alias("idx"),
                          F.lit(count).cast("long").alias("n"), "digest")
    crown = top.select(*COORDINATE, "digest")
    for part in all_levels(top, count):
        crown = crown.unionByName(part)
    root = crown.agg(F.max_by("digest", "level").alias("digest")).first()[0]
    return Manifest(placed, nodes.unionByName(crown), count, root)


def octopus(known: np.ndarray, n: int) -> list[tuple[int, int]]:
    """The coordinates (level, idx) that are needed to derive the root of a tree of n
    leaves from the known leaves, none of them derivable from those."""
    out, level = [], 0
    known = np.unique(known)
    while n > 1:
        parents = np.unique(known // BRANCH)
        children = (parents[:, None] * BRANCH + np.arange(BRANCH)).ravel()
        missing = np.setdiff1d(children[children < n], known, assume_unique=True)
        out += [(level, i) for i in missing.tolist()]
        known, n, level = parents, -(-n // BRANCH), level + 1
    return out


def requests(chosen: DataFrame, trees: int) -> DataFrame:
    """own, block, tree, level, idx: what each leaf partition has to fetch."""
    def run(table: pa.Table) -> pa.Table:
        tree, idx, n = (table[c].to_numpy() for c in ("tree", "idx", "n"))
        here = np.unique(tree)
        out = [(TOP, level, i) for level, i in octopus(here, trees)]
        order = np.argsort(tree, kind="stable")
        cuts = np.searchsorted(tree[order], here)
        for t, rows in zip(here.tolist(), np.split(order, cuts[1:]), strict=True):
            out += [(t, level, i) for level, i in octopus(idx[rows], int(n[rows[0]]))]
        own, block = table["own"][0].as_py(), table["block"][0].as_py()
        kinds = [pa.int64(), pa.int32(), pa.int64()]
        return pa.table({"own": pa.array([own] * len(out), pa.int64()),
                         "block": pa.array([block] * len(out), pa.int64()),
                         **{c: pa.array([r[i] for r in out], k)
                            for i, (c, k) in enumerate(zip(COORDINATE, kinds, strict=True))}})

    return chosen.select("own", "block", "tree", "idx", "n").groupBy("own", "block").applyInArrow(
        run, "own long, block long, tree long, level int, idx long")


def fetched(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """The wanted coordinates with their digests. A few of them are broadcast to the
    nodes; many are joined by salts, as all partitions want the nodes near the root."""
    wanted = stage(wanted, "merkle-requests")
    count = wanted.count()
    if count <= BROADCAST_ROWS:
        return nodes.join(F.broadcast(wanted), COORDINATE)
    once = nodes.join(wanted.select(*COORDINATE).distinct(), COORDINATE)
    return spread_join(wanted, once, COORDINATE, count)


def paths(known: dict, n: int, after: list) -> dict[int, list]:
    """idx -> [(left siblings, right siblings), ...] of the known leaves of a tree: up
    to its root, and ``after`` behind. ``known``: level -> {idx: digest}; the interior
    nodes over own leaves are derived into it, each once."""
    own, level = sorted(known["own"]), 0
    levels = []
    while n > 1:
        here, up = known[level], known.setdefault(level + 1, {})
        levels.append((own, n))
        own = sorted({i // BRANCH for i in own})
        for p in own:
            up[p] = digest(here[i] for i in range(p * BRANCH, min(n, (p + 1) * BRANCH)))
        n, level = -(-n // BRANCH), level + 1
    found = {i: after for i in own}
    for level, (own, n) in reversed(list(enumerate(levels))):
        here, below = known[level], {}
        for i in own:
            p = i // BRANCH
            run = range(p * BRANCH, min(n, (p + 1) * BRANCH))
            below[i] = [("".join(here[j] for j in run if j < i),
                         "".join(here[j] for j in run if j > i)), *found[p]]
        found = below
    return found


def expanded(leaves: pa.Table, nodes: pa.Table, trees: int, leaf_col: str) -> tuple[list, list]:
    """(subroot, proof) of every leaf of a partition, from its own leaves and the
    fetched nodes alone."""
    known: dict[int, dict] = {}
    for t, level, i, d in zip(*(nodes[c].to_pylist() for c in (*COORDINATE, "digest")), strict=True):
        known.setdefault(t, {}).setdefault(level, {})[i] = d
    tree, idx, n, leaf = (leaves[c].to_pylist() for c in ("tree", "idx", "n", leaf_col))
    sizes = {}
    for t, i, size, d in zip(tree, idx, n, leaf, strict=True):
        here = known.setdefault(t, {})
        here.setdefault(0, {})[i] = d
        here.setdefault("own", []).append(i)
        sizes[t] = size
    crown = known.setdefault(TOP, {})
    crown["own"] = list(sizes)
    within = {}
    for t, size in sizes.items():
        within[t] = paths(known[t], size, [])
        crown.setdefault(0, {})[t] = known[t][height(size)][0]
    over = paths(crown, trees, [])
    return ([crown[0][t] for t in tree],
            [within[t][i] + over[t] for t, i in zip(tree, idx, strict=True)])


def proofs(manifest: Manifest, chosen: DataFrame | None = None, leaf_col: str = "leaf") -> DataFrame:
    """The chosen rows of ``manifest.leaves`` (all by default; whole rows of it, in any
    number) with subroot and proof: array of struct<left, right>, the siblings before
    and after the path's node on every level, from the leaf to the root."""
    chosen = manifest.leaves if chosen is None else chosen
    trees = manifest.trees
    found = stage(fetched(requests(chosen, trees), manifest.nodes).select(
        "own", "block", *COORDINATE, "digest"), "merkle-fetched")
    step = T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())])
    shape = T.StructType([*chosen.schema.fields, T.StructField("subroot", T.StringType()),
                          T.StructField("proof", T.ArrayType(step))])

    def run(leaves: pa.Table, nodes: pa.Table) -> pa.Table:
        subroot, path = expanded(leaves, nodes, trees, leaf_col)
        flat = [step for p in path for step in p]
        steps = pa.StructArray.from_arrays(
            [pa.array([s[0] for s in flat], pa.string()), pa.array([s[1] for s in flat], pa.string())],
            names=["left", "right"])
        offsets = np.r_[0, np.cumsum([len(p) for p in path])].astype(np.int32)
        out = leaves.append_column("subroot", pa.array(subroot, pa.string()))
        return out.append_column("proof", pa.ListArray.from_arrays(pa.array(offsets), steps))

    return chosen.groupBy("own", "block").cogroup(found.groupBy("own", "block")).applyInArrow(run, shape)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof give."""
    return F.aggregate(proof, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def siblings_digest(proof: Column) -> Column:
    """SHA-256 of the siblings of a proof, level by level, left to right."""
    return F.sha2(F.concat_ws("", F.transform(proof, lambda s: F.concat(s["left"], s["right"]))), 256)


def verify(df: DataFrame, claimed: DataFrame | None = None, fields: tuple[str, ...] = FIELDS,
           id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    ``claimed`` is the table whose rows are checked against the manifest of ``df``:
    its column ``claim`` holds the leaf digest claimed for a row (null: the row as it
    is); without it, ``df`` itself is checked. It needs all columns of ``df``.

    A null in a field is ``-``; a null source is a tree of its own, before the others; a
    null id comes first in its tree. Rows of one id are a leaf each, in the order of
    their digests; equal rows have equal leaves and differ by their places. Texts of any
    length and empty ones are hashed whole. Other columns are not read; an empty table
    gives no rows. The root is one string on the driver, and nothing else is."""
    rows = claimed if claimed is not None else df.withColumn("claim", F.lit(None).cast("string"))
    leaves = stage(rows.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        leaf_digest(*[F.col(f) for f in fields]).alias("leaf"), F.col("claim").alias("claim")),
        "merkle-leaves")
    manifest = build(leaves)
    folded = fold(F.coalesce("claim", "leaf"), F.col("proof"))
    return proofs(manifest).select(
        "doc_id", "leaf", "subroot", F.lit(manifest.root).cast("string").alias("root"),
        siblings_digest(F.col("proof")).alias("proof_sha256"), folded.alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


def tampered(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """``docs`` with column claim: where 2 divides the CRC-32 of the id, the leaf digest
    of the row whose text has lost its line feeds; null elsewhere."""
    text = F.regexp_replace(F.col(text_col), "\n", "")
    claim = leaf_digest(*[text if f == text_col else F.col(f) for f in fields])
    return docs.withColumn("claim", F.when(F.crc32(F.col(id_col).cast("string").cast("binary")) % 2 == 0, claim))
