"""Passage removal, periodic runs and the Merkle manifest against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scour.llm import merkle_manifest, periodic_runs, seed_extend
from tests.llm.test_text_operators import empty, frame


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


# ------------------------------------------------------------- seed and extend

def without_repeats(rows, length):
    """Expected (n_words, n_removed, kept) per row: windows that a smaller id has too go."""
    first = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        if d is not None:
            for i in range(len(w) - length + 1):
                key = tuple(w[i:i + length])
                first[key] = min(first.get(key, d), d)
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if d is not None and first[tuple(w[i:i + length])] < d:
                gone[i:i + length] = [True] * length
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()
        out.append((d, len(w), sum(gone), kept))
    return sorted(out, key=str)


def passages(seed=4):
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randint(0, 4000)}"
    text = lambda n: [word() for _ in range(n)]
    shared = [text(n) for n in (49, 50, 51, 60, 120, 400)]
    rows = []
    for d in rnd.sample(range(1000), 120):
        parts = text(rnd.randint(0, 30))
        for s in rnd.sample(shared, rnd.randint(0, 3)):
            a = rnd.randint(0, max(0, len(s) - 55))
            parts += s[a:] + text(rnd.randint(0, 40))
        if parts and rnd.random() < 0.3:                  # an edit inside
            parts[rnd.randrange(len(parts))] = "edited"
        rows.append((d, " ".join(parts)))
    rows += [(2000 + i, rows[i % 7][1]) for i in range(40)]                # copies
    rows += [(3000, "a b " * 200), (3001, "b a " * 150), (3002, "x " * 70), (3003, "x " * 55)]   # ties
    rows += [(None, rows[3][1]), (-5, None), (-6, ""), (-7, " \t\n"), (3004, "  ".join(text(80)))]
    return rows


def test_passages_equal_brute_force(spark):
    rows = passages()
    rows += [rows[5], rows[5], (rows[5][0], rows[9][1]), (rows[9][0], rows[5][1])]   # repeated ids
    got = seed_extend.remove_repeats(frame(spark, rows)).collect()
    expected = without_repeats(rows, 50)
    assert sorted([tuple(r) for r in got], key=str) == expected
    assert sum(r[2] > 0 for r in expected) > 60


def test_passages_without_broadcasts_are_the_same(spark, monkeypatch):
    monkeypatch.setattr(seed_extend, "BROADCAST_ROWS", -1)
    rows = passages(8)
    got = seed_extend.remove_repeats(frame(spark, rows), length=40, seed=20).collect()
    assert sorted([tuple(r) for r in got], key=str) == without_repeats(rows, 40)


def test_one_passage_among_many_documents_makes_no_pairs(spark):
    rnd = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(70))
    rows = [(d, " ".join(f"{d}x{rnd.randint(0, 9 ** 9)}" for _ in range(20)) + " " + passage
             + f" {d}y " + " ".join(f"{d}z{k}" for k in range(10))) for d in range(600)]
    got = {r["doc_id"]: r["n_removed"] for r in seed_extend.remove_repeats(frame(spark, rows)).collect()}
    assert got == {d: 70 if d else 0 for d in range(600)}


def test_long_text_and_no_text(spark):
    base = " ".join(str(i) for i in range(60_000))
    got = {r["doc_id"]: r for r in seed_extend.remove_repeats(
        frame(spark, [(1, base), (2, "new " + base + " end")])).collect()}
    assert got[1]["n_removed"] == 0 and (got[2]["n_removed"], got[2]["kept"]) == (60_000, "new end")
    assert seed_extend.remove_repeats(empty(spark)).count() == 0


def test_equal_windows_have_equal_anchors():
    rnd = np.random.default_rng(2)
    words = [b"%d" % x for x in rnd.integers(0, 3, 400)]
    known = seed_extend._Names()
    here = seed_extend.anchors(seed_extend.names(words, [25], known)[25], 26)
    there = seed_extend.anchors(seed_extend.names(words[37:], [25], known)[25], 26)
    assert (here[37:] - 37 == there).all()


# --------------------------------------------------------------- periodic runs

def brute_runs(w, least=6):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 4 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def test_runs_equal_brute_force():
    rnd = random.Random(1)
    for _ in range(150):
        texts = []
        for _ in range(rnd.randint(1, 10)):
            n, kinds = rnd.choice([0, 1, 5, 6, 7, 12, 30, 60, 200]), rnd.choice([1, 2, 3, 10])
            w = [str(rnd.randrange(kinds)) for _ in range(n)]
            if n and rnd.random() < 0.6:
                a, p = rnd.randrange(n), rnd.randint(1, max(1, n // 4))
                w = [w[i if i < a else a + (i - a) % p] for i in range(n)]
            texts.append(w)
        assert [[tuple(r) for r in found.tolist()] for found in periodic_runs.runs_of(texts)] == \
            [brute_runs(w) for w in texts]


def test_range_successor_equals_sorting():
    rng = np.random.default_rng(7)
    values = rng.permutation(300)
    tree = periodic_runs.Wavelet(values, 9)
    lo = rng.integers(0, 250, 200)
    hi = lo + rng.integers(1, 50, 200)
    x = rng.integers(0, 300, 200)
    below = tree.below(lo, hi, x)
    k = rng.integers(0, 1000, 200) % (hi - lo)
    smallest = tree.smallest(lo, hi, k)
    for i in range(200):
        part = np.sort(values[lo[i]:hi[i]])
        assert below[i] == (part < x[i]).sum() and smallest[i] == part[k[i]]


def test_run_digests(spark):
    rows = [(d, " ".join(f"{d}w{i % 17}" if i % 5 else "the" for i in range(n)))
            for d, n in enumerate([0, 1, 3, 10, 40, 200, 700, 90, 55, 31] * 6)]
    rows += [(900, "x " * 5), (901, "x " * 6), (902, "a b " * 4 + "c " * 8), (903, None), (None, "y " * 9),
             (904, "ab " * 30_000), (901, "x " * 6), (905, " \t\n")]
    got = periodic_runs.digest(frame(spark, rows)).collect()
    expected = []
    for d, t in rows:
        w = periodic_runs.planted(d, (t or "").encode().split())
        runs = brute_runs(w) if len(w) < 10_000 else [(0, len(w), 1)]
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
        gone = set()
        for s, n, q in runs:
            gone.update(range(s + q, s + n))
        expected.append((d, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2],
                         sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
                         sha(b" ".join(x for i, x in enumerate(w) if i not in gone))))
    assert sorted([tuple(r) for r in got], key=str) == sorted(expected, key=str)
    assert sum(e[1] > 1 for e in expected) >= 1
    assert periodic_runs.digest(empty(spark)).count() == 0


# ------------------------------------------------------------- Merkle manifest

def brute_tree(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([sha("".join(now[i:i + 3])) for i in range(0, len(now), 3)])
    return levels


def brute_path(levels, i):
    out = []
    for level in levels[:-1]:
        p = i // 3 * 3
        out.append(("".join(level[p:i]), "".join(level[i + 1:p + 3])))
        i //= 3
    return out


def manifest_rows():
    rnd = random.Random(6)
    rows = [(d, rnd.choice(["web", "news", "ä", "Z", None, "books"]), rnd.choice(["en", None]),
             rnd.choice([None, d]), rnd.choice([None, "", "line\nline\n", f"text {d}\n", "x" * 5000]))
            for d in rnd.sample(range(5000), 400)]
    rows += [(7001, "alone", "en", 1, "only\nleaf"), rows[0], rows[0], (rows[1][0], *rows[0][1:]),
             (None, "web", None, None, "no id\n")]
    return rows


def expected_manifest(rows):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha("".join(map(enc, r)))
    trees = {}
    for r in rows:
        trees.setdefault(r[1], []).append(r)
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        trees[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    built = {s: brute_tree([leaf(r) for r in trees[s]]) for s in order}
    top = brute_tree([built[s][-1][0] for s in order])
    out = []
    for at, s in enumerate(order):
        for i, r in enumerate(trees[s]):
            path = brute_path(built[s], i) + brute_path(top, at)
            h = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                h = leaf((*r[:4], r[4].replace("\n", "") if r[4] is not None else None))
            for left, right in path:
                h = sha(left + h + right)
            root = top[-1][0]
            out.append((r[0], leaf(r), built[s][-1][0], root, sha("".join(a + b for a, b in path)), h, h == root))
    return sorted(out, key=str)


def manifest_frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string") \
        .withColumns({"tree": F.lit("clash"), "idx": F.lit(1), "level": F.lit(2), "n": F.lit("n"), "own": F.lit(0)})


@pytest.mark.parametrize("levels,bound", [(7, 500_000), (2, 500_000), (1, -1)])   # one block a tree; many; salted
def test_manifest_equals_brute_force(spark, monkeypatch, levels, bound):
    monkeypatch.setattr(merkle_manifest, "LEVELS", levels)
    monkeypatch.setattr(merkle_manifest, "SPAN", 3 ** levels)
    monkeypatch.setattr(merkle_manifest, "BROADCAST_ROWS", bound)
    rows = manifest_rows()
    docs = manifest_frame(spark, rows)
    got = merkle_manifest.verify(docs, merkle_manifest.tampered(docs)).collect()
    expected = expected_manifest(rows)
    assert sorted([tuple(r) for r in got], key=str) == expected
    assert 20 < sum(not e[-1] for e in expected) < 380


def test_proofs_of_some_leaves_fetch_the_fewest_nodes(spark):
    rows = manifest_rows()
    docs = manifest_frame(spark, rows)
    leaves = docs.select("doc_id", "source", merkle_manifest.leaf_digest(
        *[F.col(f) for f in merkle_manifest.FIELDS]).alias("leaf"))
    manifest = merkle_manifest.build(leaves)
    chosen = manifest.leaves.filter("doc_id % 5 = 0")
    got = merkle_manifest.proofs(manifest, chosen).withColumn(
        "root", merkle_manifest.fold(F.col("leaf"), F.col("proof"))).collect()
    assert len(got) == chosen.count() > 50 and {r["root"] for r in got} == {manifest.root}
    fetched = merkle_manifest.requests(chosen, manifest.trees).count()
    assert fetched < sum(len(s[0]) // 64 + len(s[1]) // 64 for r in got for s in r["proof"]) / 3


def test_octopus_is_minimal():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 4, 9, 10, 100, 500):
        for _ in range(10):
            own = np.unique(rng.integers(0, n, rng.integers(1, n + 1)))
            asked = set(merkle_manifest.octopus(own, n))
            have, size, level = set(own.tolist()), n, 0
            while size > 1:                               # siblings of derived nodes, none of them derived
                parents = {i // 3 for i in have}
                siblings = {i for p in parents for i in range(3 * p, min(size, 3 * p + 3))} - have
                assert {i for k, i in asked if k == level} == siblings
                have, size, level = parents, -(-size // 3), level + 1


def test_manifest_of_nothing(spark):
    docs = manifest_frame(spark, [])
    assert merkle_manifest.verify(docs, merkle_manifest.tampered(docs)).count() == 0
