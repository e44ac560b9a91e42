"""Operators on documents against brute force, on small made-up tables: nulls,
empty, blank and very long texts, ties, repeated rows, clashing extra columns."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from scour.llm import (bpe, decontaminate, jaccard_join, pii, quality_classifier, quality_rules,
                       secret_scan, substring_dedup)

CLASHING = ["cid", "key", "n", "comp", "k", "h", "start", "copies", "spans", "todo", "late",
            "features", "score", "stratum", "n_words", "item_id", "members", "value", "_email"]


def words(rnd, n):
    return [rnd.choice(["the", "of", "stone", "river", "Éa", "mond", "käse", "two", "x1", "and"])
            + str(rnd.randint(0, 40)) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    """(doc_id, text) rows: families of near copies, shared passages, odd texts."""
    rnd = random.Random(5)
    passage = " ".join(words(rnd, 60))
    rows = [(1, None), (2, ""), (3, "  \n\t "), (4, "Two words"), (5, "two WORDS"), (6, "lone")]
    at = 10
    for size in (1, 2, 5, 30):
        base = words(rnd, rnd.randint(40, 120))
        for _ in range(size):
            w = list(base)
            for _ in range(rnd.randint(0, 3)):
                w[rnd.randrange(len(w))] = f"edit{rnd.randint(0, 9)}"
            rows.append((at, " ".join(w)))
            at += 1
    for _ in range(25):                                   # unlike documents around one passage
        rows.append((at, " ".join(words(rnd, rnd.randint(5, 90))) + "\n" + passage + " "
                     + " ".join(words(rnd, rnd.randint(0, 40)))))
        at += 1
    rows += [(at, "spam " * 5000), (at + 1, "a" * 3000), (at + 2, "ab" * 700 + "c" * 130)]
    rows += [(at + 3, rows[-5][1]), (10, rows[6][1]), (10, rows[6][1])]   # a copy; repeated rows
    return rows


def frame(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    for c in CLASHING:
        df = df.withColumn(c, F.lit("clash"))
    return df.withColumn("lang", F.lit("en"))


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


# ------------------------------------------------------------------ n-gram join

def shingles(text, n=4):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


@pytest.mark.parametrize("settle", [0.0, 0.8])         # after one drawn turn; after several
def test_jaccard_components_equal_brute_force(spark, corpus, settle):
    rows = corpus + [(None, "no id here")]
    sets = {d: shingles(t) for d, t in rows if d is not None}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sorted(sets):
        for b in sorted(sets):
            same = len(sets[a] & sets[b])
            if a < b and sets[a] and 100 * same >= 85 * len(sets[a] | sets[b]):
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    got = jaccard_join.join_components(frame(spark, rows), settle=settle).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), find(r["doc_id"]))
    assert len({find(d) for d in sets}) < len(sets)


def test_jaccard_segments_always_meet():
    # any two sets that reach the similarity share a key, whatever their sizes
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2 ** 64, n, dtype=np.uint64))
        room = int(len(a) * 0.17)
        b = np.unique(np.concatenate([a[rng.integers(0, max(1, room)):],
                                      rng.integers(0, 2 ** 64, int(rng.integers(0, room + 1)), dtype=np.uint64)]))
        same = len(np.intersect1d(a, b))
        if 100 * same >= 85 * (len(a) + len(b) - same) and len(a) != same:
            assert set(jaccard_join.segment_keys(a, 85).tolist()) & set(jaccard_join.segment_keys(b, 85).tolist())


def test_repeated_rows_link_no_pair_under_the_threshold(spark):
    rnd = random.Random(14)
    rows, sets = [], {}
    for d in range(0, 80, 2):                             # 12 or 13 words of 150 further: 0.84 to 0.87
        w = [f"w{d}x{k}" for k in range(150)]
        more = [f"m{d}x{k}" for k in range(rnd.randint(23, 30))]
        rows += [(d, " ".join(w)), (d + 1, " ".join(w + more))]
    rows += [(200, "a clean text of its own"), (0, "a clean text of its own")]
    sets = [shingles(t) for _, t in rows]
    near = {a for a in range(0, 80, 2) if 100 * len(sets[a] & sets[a + 1]) >= 85 * len(sets[a] | sets[a + 1])}
    assert 0 < len(near) < 40
    got = jaccard_join.join_components(frame(spark, rows + rows[:80] + rows[:80])).collect()
    assert len(got) == len(rows) + 160
    for r in got:
        if 1 < r["doc_id"] < 200:
            a = r["doc_id"] // 2 * 2
            assert r["component_id"] == (a if a in near else r["doc_id"])
    # a document is cut once, whichever rows bring it
    docs = frame(spark, rows + rows[:80]).select("doc_id", "text")
    sized = jaccard_join.classes(docs, 4).cache()
    reps = sized.groupBy("cid").agg(F.min("doc_id").alias("doc_id")).cache()
    cut = jaccard_join.segments_once(docs, sized, reps, 4)
    assert cut.groupBy("cid", "fragment").count().filter("count > 1").isEmpty()
    assert cut.filter("fragment = -1").count() == len(set(sets))


def test_jaccard_of_nothing(spark):
    assert jaccard_join.join_components(empty(spark)).count() == 0


def test_jaccard_without_pairs_compares_nothing(spark, monkeypatch):
    written, stage = [], jaccard_join.stage
    monkeypatch.setattr(jaccard_join, "stage", lambda df, name: written.append(name) or stage(df, name))
    rows = [(7, "one two three four five"), (3, "one two three four five"), (3, "ONE two three four five"),
            (5, "six seven eight nine ten"), (2, None), (2, " "), (None, "six seven eight nine ten"), (None, "")]
    got = sorted(jaccard_join.join_components(frame(spark, rows)).collect(), key=str)
    want = [(7, 2, 3), (3, 2, 3), (3, 2, 3), (5, 2, 5), (2, 0, 2), (2, 0, 2), (None, 2, 5), (None, 0, None)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert written == ["jaccard-classes", "jaccard-buckets"]


def test_jaccard_turns_start_from_the_components_before(spark, monkeypatch):
    """The links found so far go into the next turn as one to each class's smallest."""
    seen, found = [], jaccard_join.components

    def spied(links, name):
        out = found(links, name)
        seen.append(links.filter("a = b").count())        # a smallest class, linked to itself
        return out

    monkeypatch.setattr(jaccard_join, "components", spied)
    rnd = random.Random(31)
    rows, w = [], words(rnd, 150)
    for d in range(40):                                   # a chain: each like the few before it only
        rows.append((d, " ".join(w)))
        w = list(w)
        w[rnd.randrange(150)] = f"new{d}"
    sets = {d: {tuple(t.lower().split()[i:i + 4]) for i in range(147)} for d, t in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.join_components(frame(spark, rows)).collect()}
    assert got == {d: root(d) for d in sets}
    assert len(seen) > 1 and seen[0] == 0 and all(seen[1:])


# ----------------------------------------------------------------- quality rules

def base_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    twice = [False] * len(w)
    for i in range(len(w) - 7):
        if windows[tuple(w[i:i + 8])] > 1:
            twice[i:i + 8] = [True] * 8
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, sum(twice))


def test_rule_counts_equal_brute_force(spark, corpus):
    rows = corpus + [(900, "line\nline\n\n \nline two # <b>\n" * 7), (901, "a b c d e f g h " * 3)]
    want = {d: base_counts(t) for d, t in rows}
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality_rules.apply_rules(frame(spark, rows), none).collect()
    assert len(got) == len(rows)
    for r in got:
        counts = tuple(r[c] for c in quality_rules.COUNTS[:5])
        assert counts == want[r["doc_id"]]
        failed = counts[0] < 20 or 100 * counts[4] > 30 * counts[0]
        assert r["base_failed"] == failed and r["kept"] == (not failed)     # no labels: base only
    assert quality_rules.apply_rules(empty(spark), none).count() == 0


def test_cutoffs_hold_the_risk_and_find_junk(spark):
    rnd = random.Random(1)
    good = [(i, " ".join(words(rnd, 60)), "en") for i in range(3000)]
    junk = [(5000 + i, " ".join(w + "###" for w in words(rnd, 60)), "en") for i in range(200)]
    rare = [(9000 + i, " ".join(w + "&&&" for w in words(rnd, 60)), "xx") for i in range(20)]
    docs = spark.createDataFrame(good + junk + rare, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(d, 1) for d, _, _ in good] + [(d, 0) for d, _, _ in junk],
                                   "doc_id long, quality int")
    kept = {r["doc_id"] for r in quality_rules.apply_rules(docs, labels).filter("kept").collect()}
    assert sum(d not in kept for d, _, _ in good) <= 0.01 * len(good)
    assert not any(d in kept for d, _, _ in junk)
    assert all(d in kept for d, _, _ in rare)             # a stratum without labels rejects nothing


def test_binomial_tail_is_exact():
    from fractions import Fraction
    from math import comb

    p = Fraction(3, 100)
    for n, k in [(10, 0), (50, 2), (200, 9), (7, 7)]:
        exact = sum(comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1))
        assert quality_rules.binomial_tail(k, n, 0.03) == pytest.approx(float(exact), rel=1e-9)
    assert quality_rules.binomial_tail(0, 0, 0.03) == 1.0
    # the ladder stops before the first level that fails, even if a later one would pass
    assert quality_rules.certified_level([0, 0, 500, 0], 1000, 0.01, 0.05) == 1
    assert quality_rules.certified_level([0], 10, 0.01, 0.05) == -1


# --------------------------------------------------------------- decontamination

def test_windows_equal_brute_force(spark, corpus):
    rnd = random.Random(9)
    items = [(i, " ".join(words(rnd, rnd.randint(12, 50)))) for i in range(12)]
    items += [(50, "three little words"), (51, None), (52, ""), (3, items[3][1]), (53, "wow " * 30)]
    rows = list(corpus)
    for j, (_, t) in enumerate(items[:12]):
        w = t.split()
        if j % 3 == 0:
            w[len(w) // 2:len(w) // 2] = ["inserted"]
        if j % 4 == 1:
            w[-1] = "changed"
        rows.append((1000 + j, " ".join(words(rnd, 20) + w + words(rnd, 15)).upper()))
        rows.append((2000 + j, " ".join(w)))
    rows += [(3000, "so three little WORDS, here"), (3001, "wow " * 33)]
    split = re.compile(r"\w+").findall

    def grams(w, n):
        return Counter(tuple(w[k:k + n]) for k in range(len(w) - n + 1))

    want = {}
    for d, t in rows:
        doc = split((t or "").lower())
        for i, x in items:
            item = split((x or "").lower())
            if not item:
                continue
            n = min(5, len(item))
            g = grams(item, n)
            best = 0.0
            for s in range(max(1, len(doc) - len(item) + 1)):
                h = grams(doc[s:s + len(item)], n)
                if h & g:
                    best = max(best, sum((h & g).values()) / sum((h | g).values()))
            if best >= 0.8:
                want[d, i] = best
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("n_words", F.lit("clash"))
    got = decontaminate.contaminated(frame(spark, rows), bench).collect()
    assert {(r["doc_id"], r["item_id"]): pytest.approx(r["similarity"]) for r in got} == want
    assert len(got) == len(want) >= 15


def test_multi_index_finds_all_pairs_within_the_radius():
    rnd = np.random.default_rng(4)
    items = rnd.integers(0, 2 ** 63, 300, dtype=np.int64).view(np.uint64)
    flips = np.array([sum(1 << int(b) for b in rnd.choice(64, k, replace=False))
                      for k in rnd.integers(0, 40, 900)], np.uint64)
    windows = np.tile(items, 3) ^ flips
    apart = np.bitwise_count(windows[:, None] ^ items[None, :])
    at, item = decontaminate.PrintIndex(items).within(windows)
    assert sorted(zip(at.tolist(), item.tolist(), strict=True)) == [
        tuple(x) for x in np.argwhere(apart <= decontaminate.RADIUS).tolist()]
    assert not len(decontaminate.PrintIndex(items[:0]).within(windows)[0])


def test_window_fingerprints_equal_those_of_the_windows_alone(monkeypatch):
    monkeypatch.setattr(decontaminate, "STRETCH", 7)
    grams = np.random.default_rng(2).integers(0, 2 ** 63, 90, dtype=np.int64).view(np.uint64)
    starts = np.array([0, 1, 5, 6, 7, 8, 30, 31, 60])
    got = decontaminate.window_prints(grams, starts, 30)
    assert got.view(np.int64).tolist() == [decontaminate.simhash(grams[s:s + 30]) for s in starts]


def test_only_what_the_fingerprints_propose_is_a_match(spark, monkeypatch):
    rnd = random.Random(3)
    a, b, c = (" ".join(words(rnd, 40)) for _ in range(3))
    bench = spark.createDataFrame([(3, a), (3, b), (5, a), (6, c)], "item_id long, text string")
    docs = frame(spark, [(1, a), (2, "so " + b), (3, c + " end")])
    pairs = lambda: sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect())
    assert pairs() == [(1, 3), (1, 5), (2, 3), (3, 6)]      # an id with two texts, a text with two ids
    monkeypatch.setattr(decontaminate.PrintIndex, "within",
                        lambda self, prints: (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    w = decontaminate.words_of(a, decontaminate._Hashes())
    g = np.unique(decontaminate.grams_of(w, 5))
    index = {len(w): (np.zeros(1, np.int64), decontaminate.PrintIndex(np.zeros(1, np.uint64)))}
    assert decontaminate.similar_windows(w, g, np.zeros(len(g), np.int64), np.ones(len(g), np.int64),
                                         np.array([len(w)]), index, 0.8) == []


def test_windows_of_moved_parts_equal_brute_force(spark):
    rnd = random.Random(31)
    own = lambda tag, n: [f"{tag}{k}" for k in range(n)]
    q, a, h = own("q", 50), own("a", 10), own("h", 60)
    items = [(1, " ".join(q + a)), (2, " ".join(h)), (3, "la la la li lo " * 8), (4, "one two three")]
    rows = [(1, " ".join(words(rnd, 100) + a + q + words(rnd, 100))),      # answer before question
            (2, " ".join(words(rnd, 70) + h[30:] + h[:30] + words(rnd, 40))),        # swapped halves
            (3, " ".join(a + q)), (4, " ".join(h[48:] + words(rnd, 2) + h[:48])),
            (5, " ".join(words(rnd, 9) + h[25:] + words(rnd, 30) + h[:25])),         # too far apart
            (6, "li lo la la la " * 30), (7, "so two three one two three"),
            (8, " ".join(words(rnd, 5) + q[40:] + a + q[:40] + words(rnd, 5) + a + q))]

    def grams(w, n):
        return Counter(tuple(w[k:k + n]) for k in range(len(w) - n + 1))

    want = {}
    for d, t in rows:
        for i, x in items:
            doc, item = t.lower().split(), x.split()
            n = min(5, len(item))
            g = grams(item, n)
            for s in range(max(1, len(doc) - len(item) + 1)):
                v = grams(doc[s:s + len(item)], n)
                like = sum((v & g).values()) / sum((v | g).values())
                if like >= 0.8 and like > want.get((d, i), (0, 0))[0]:
                    want[d, i] = like, s
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(frame(spark, rows), bench).collect()
    assert {(r["doc_id"], r["item_id"]): (pytest.approx(r["similarity"]), r["start"]) for r in got} == want
    assert {(1, 1), (2, 2), (3, 1), (6, 3), (7, 4), (8, 1)} <= set(want) and (5, 2) not in want


def test_decontaminate_nothing(spark, corpus):
    bench = spark.createDataFrame([(1, "some item text of six words")], "item_id long, text string")
    assert decontaminate.contaminated(empty(spark), bench).count() == 0
    assert decontaminate.contaminated(frame(spark, corpus), bench.limit(0)).count() == 0


# --------------------------------------------------------------------------- BPE

def test_bpe_equals_the_library(spark, corpus):
    from tokenizers import Tokenizer

    path = bpe.default_vocabulary()
    library = Tokenizer.from_file(path)
    rnd = random.Random(2)
    parts = ["a", " ", "  ", "\n", " \n", "\t", "<|endoftext|>", "'s", "½", "²", "the", "日本", "\x1c",
             "　", "\x85", "12", "!!", "é", "_", "​", "x" * 90, "=" * 70]
    rows = corpus + [(5000 + i, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))))
                     for i in range(400)]
    got = bpe.digests(frame(spark, rows), path).collect()
    assert len(got) == len(rows)
    want = {}
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want[d] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                   hashlib.sha256(text.encode()).hexdigest())
    for r in got:
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == want[r["doc_id"]]
    assert bpe.digests(empty(spark), path).count() == 0


def test_bpe_long_tree_equals_short_tree():
    v = bpe.load_vocabulary(bpe.default_vocabulary())
    rnd = random.Random(4)
    for _ in range(200):
        word = "".join(rnd.choice("ethraonis ") for _ in range(rnd.randint(1, 60))).encode()
        tokens = v.byte_id[np.frombuffer(word, np.uint8)]
        ids, _ = bpe.merge_words(v, [word])
        assert bpe.merge_long(v, tokens.tolist()) == ids.tolist()


# -------------------------------------------------------------- repeated substrings

def remove_repeats(rows, length):
    """The contract, literally: rows in document order, all starts of all windows."""
    by_id = defaultdict(list)
    for d, t in rows:
        by_id[d].append((t or "").encode())
    first = {}
    for d in sorted(by_id):
        for i in range(len(by_id[d][0]) - length + 1):
            first.setdefault(by_id[d][0][i:i + length], (d, i))
    out = {}
    for d in by_id:
        raw = by_id[d][0]
        gone = [False] * len(raw)
        for i in range(len(raw) - length + 1):
            if first[raw[i:i + length]] < (d, i):
                gone[i:i + length] = [True] * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(raw), sum(gone), spans,
                  hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest())
    return out


def test_substring_dedup_equals_brute_force(spark, corpus):
    rnd = random.Random(8)
    block = "".join(rnd.choice("abcdefgh ") for _ in range(400))
    rows = corpus + [(7000 + i, "".join(rnd.choice("xyz ") for _ in range(rnd.randint(0, 90)))
                      + block[rnd.randint(0, 250):rnd.randint(251, 400)]
                      + "é" * rnd.randint(0, 80)) for i in range(40)]
    rows += [(8000, "é" * 99), (8001, "é" * 99), (8002, block * 3)]
    want = remove_repeats(rows, 100)
    got = substring_dedup.digest(frame(spark, rows, 5)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]], r
    assert sum(w[1] for w in want.values()) > 10_000
    assert substring_dedup.digest(empty(spark)).count() == 0


# ---------------------------------------------------------------------------- PII

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
            "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    return sum((2 * int(c) - 9 * (int(c) > 4)) if i % 2 else int(c)
               for i, c in enumerate(reversed(s))) % 10 == 0


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in value.split(".")),
            "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]


def test_pii_base_spans_equal_re(spark, corpus):
    rnd = random.Random(6)
    bits = ["a@b.c", "x_y", "@", ".", "1.2.3.4", "256.1.1.1", "0001.2.3.004", "4111 1111 1111 1111",
            "4111-1111-1111-1112", " ", "-", "+1 (415) 555-2671", "+12", "日本𝒳", "é", "9", "12345678901234567890",
            "mail.me@x-y.example.org", "+", "\n", "%", "1.2.3.4.5.6.7.8"]
    rows = corpus + [(6000 + i, "".join(rnd.choice(bits) for _ in range(rnd.randint(1, 14))))
                     for i in range(600)] + [(6999, "7 " * 4000 + "a." * 3000 + "x" * 20000)]
    want = {}
    for d, t in rows:
        s = [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items()
             for m in re.finditer(p, t or "") if passes(k, m.group(0))]
        want[d] = (*[sum(x.startswith(k + ":") for x in s) for k in PATTERNS],
                   hashlib.sha256(",".join(s).encode()).hexdigest(), set(s))
    got = pii.digest(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) == want[r["doc_id"]][:5]
        assert want[r["doc_id"]][5] <= set(r["spans"].split(","))
    assert pii.digest(empty(spark)).count() == 0


def test_pii_learns_further_spans_and_redacts(spark):
    rows = [(i, f"please call (415) 555-{1000 + i} today, account DE89 3704 0044 0532 0130 00 here")
            for i in range(40)]
    rows += [(100 + i, f"see version {i + 1000}.{i} and page 12 34 of it") for i in range(40)]
    rows += [(200, "write to a@b.org from 1.2.3.4"), (201, None), (202, "nothing 𝒳 here")]
    df = frame(spark, rows).withColumn("n_chars", F.length("text"))
    other = {r["doc_id"]: r["n_other"] for r in pii.digest(df).collect()}
    assert all(other[i] == 2 for i in range(40)) and all(other[100 + i] == 0 for i in range(40))
    out = pii.redact(df)
    assert out.columns == df.columns
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[3] == "please call [id] today, account [id] here"
    assert texts[200] == "write to [email] from [ip]" and texts[201] is None
    assert texts[202] == "nothing 𝒳 here" and texts[105] == rows[45][1]


def test_pii_many_matches_in_one_text(spark):
    rnd = random.Random(15)
    bits = ["a@b.c, ", "1.2.3.4 x ", "4111 1111 1111 1111, ", "+1 (415) 555-2671; ", "𝒳é ", "call 12 34 56, "]
    text = "".join(rnd.choice(bits) for _ in range(200_000))
    want = {k: [(m.start(), m.end()) for m in re.finditer(p, text) if passes(k, m.group(0))]
            for k, p in PATTERNS.items()}
    begun = time.time()
    found = pii.find(frame(spark, [(1, text)]), threshold=2.0).drop("text").first()
    masked = pii.redact(frame(spark, [(1, text)]), threshold=2.0).first()["text"]
    assert time.time() - begun < 120
    for k in PATTERNS:
        assert [(s["start"], s["end"]) for s in found[f"__{k}"]] == want[k]     # a column _email is there
    out, at = [], 0
    for start, end, kind in sorted((*s, k) for k in want for s in want[k]):
        if start >= at:
            out.append(text[at:start] + f"[{kind}]")
        at = max(at, end)
    assert masked == "".join(out) + text[at:]


def test_pii_texts_are_searched_once(spark, monkeypatch):
    annotated, annotate = [], pii.annotate
    monkeypatch.setattr(pii, "annotate", lambda *a: annotated.append(1) or annotate(*a))
    rows = [(1, "call +1 555 010 2030 or a@b.example"), (2, None), (2, ""), (None, "id 555-1000-2000")]
    df = frame(spark, rows).withColumn("nothing", F.lit(None))
    for given in (df.drop("nothing"), df):                # a void column can't be written
        out = pii.redact(given)
        assert out.columns == given.columns and out.dtypes == given.dtypes
        texts = sorted((str(r["doc_id"]), r["text"]) for r in out.collect() if r["text"])
        assert texts[0][1] == "call [phone] or [email]" and len(texts) == 2 and out.count() == 4
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert ("regexp_extract_all" in plan.replace(f"{{1,{pii.PIECE}}}), 0)", "") and pii.EMAIL in plan) == (
            "nothing" in given.columns)
    assert len(annotated) == 2


def test_pii_context_of_candidates(spark):
    text = "".join(f"𝒳 phone {'é' * (i % 40)} (415) 555-{1000 + i} or" for i in range(400))
    got = pii.annotate(frame(spark, [(1, text), (2, "555 1000 2000"), (3, "a@b.c 555-1000 1.2.3.4")]))
    rows = {r["doc_id"]: r["_candidates"] for r in got.collect()}
    assert len(rows[1]) == 400
    for c in rows[1]:
        assert text[c["start"]:c["end"]] == c["value"]
        assert c["before"] == text[max(0, c["start"] - pii.BEFORE):c["start"]].lower()
    assert [(c["value"], c["before"]) for c in rows[2]] == [("555 1000 2000", "")]
    assert [(c["value"], c["before"]) for c in rows[3]] == [("555-1000", "a@b.c ")]


def test_pii_keeps_columns_of_its_own_names(spark):
    df = frame(spark, [(1, "write to a@b.org"), (2, None)])
    for c in ("_email", "_Candidates", "__other"):
        df = df.withColumn(c, F.lit("mine"))
    out = pii.redact(df)
    assert out.columns == df.columns
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[1]["text"] == "write to [email]" and rows[2]["text"] is None
    assert all(r["_email"] == r["_Candidates"] == r["__other"] == "mine" for r in rows.values())
    found = pii.find(df).filter("doc_id = 1").first()
    assert found["_email"] == "mine" and [s["value"] for s in found["___email"]] == ["a@b.org"]


def test_em_finds_the_unreliable_labeler():
    # two labelers agree with the truth, one votes at random
    rnd = random.Random(3)
    seen = Counter()
    for _ in range(4000):
        truth = rnd.random() < 0.3
        good = [int(truth) if rnd.random() < 0.95 else int(not truth) for _ in range(2)]
        seen[(good[0], good[1], rnd.randint(0, 1), -1, -1)] += 1
    share, table = pii.reliabilities(sorted(seen.items()))
    assert share == pytest.approx(0.3, abs=0.05)
    assert table[1][0][2] > 0.85 and abs(table[1][2][2] - table[0][2][2]) < 0.15


# ------------------------------------------------------------------------ secrets

def test_secret_scan_removes_false_positives(spark):
    rnd = random.Random(12)
    key = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    rows, planted = [], set()
    for i in range(120):
        text = " ".join(rnd.choice(["internationalization", "responsibilities", "the", "characteristic",
                                    "notwithstandingly", "of"]) for _ in range(30))
        if i % 4 == 0:
            text += f' token = "{key(40)}" end'
            planted.add(i)
        if i % 4 == 1:
            text += f" commit {key(40)} end"
        if i % 4 == 2:
            text += f" AKIA{''.join(rnd.choice('ABCDEFGHJKLMNPQRSTUVWXYZ234567') for _ in range(16))} end"
            planted.add(i)
        rows.append((i, text))
    rows += [(500, None), (501, ""), (502, "A1" * 30_000), (0, rows[0][1])]
    df = frame(spark, rows)
    out = secret_scan.scan(df).collect()
    found = {r["doc_id"] for r in out if r["is_secret"] and r["doc_id"] < 500}
    assert found == planted
    assert any(not r["is_secret"] for r in out) and all(0 <= r["score"] <= 1 for r in out)
    assert sum(r["doc_id"] == 0 and r["is_secret"] for r in out) == 2     # the repeated row
    assert secret_scan.scan(empty(spark)).count() == 0
    # labelled findings replace the rules
    given = spark.createDataFrame([(r["doc_id"], r["start"], int(not r["is_secret"])) for r in out],
                                  "doc_id long, start int, label int")
    turned = {r["doc_id"] for r in secret_scan.scan(df, given).collect() if r["is_secret"]}
    assert not (turned & planted - {r["doc_id"] for r in out if not r["is_secret"]})


@pytest.mark.parametrize("text, want", [
    ('password = "hunter2"', ["hunter2"]), ('{"password": "p@ss!w0rd#99", "user": "x"}', ["p@ss!w0rd#99"]),
    ("é DB_PASSWORD=a$b%c^d end", ["a$b%c^d"]), ("passwd:   'two words, one \\' mark'", ["two words, one \\' mark"]),
    ("The password: hunter2.", ["hunter2"]), ("secret: password: x!1", ["x!1"]), ("token => `q1`;", ["q1"]),
    ("see postgres://me:pw!1@db.host:5432/x", ["pw!1"]), ("redis://:p@ss@h/0 http://h:80/a?m=me@x.org", ["p@ss"]),
    ("amqp://u:a/b?c#d@[::1]/", ["a/b?c#d"]), ('password = ""; auth: , the author: me', []),
    ('api_key = "AbcDef123456789"', ["AbcDef123456789"]), ('token="unclosed-1', ["unclosed-1"]),
    ('\\"secret\\": \\"s3\\"}', ["s3"]),
])
def test_secret_candidates_by_place(spark, text, want):
    got = secret_scan.candidates(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert sorted(r["value"] for r in got) == sorted(want)
    assert all(text[r["start"]:r["end"]] == r["value"] for r in got)


def test_short_and_broken_secrets_reach_the_forest(spark):
    rows = [(i, f'the path /usr/share/internationalization{i} has password = "p@ss!{i}" end') for i in range(40)]
    rows += [(100 + i, f"of scheme://user:pw!{i}@host.org and commit 0123abcdef{i:030d} end") for i in range(40)]
    out = secret_scan.scan(frame(spark, rows)).filter("is_secret").collect()
    sha = lambda v: hashlib.sha256(v.encode()).hexdigest()
    assert {(r["doc_id"], r["value_sha256"]) for r in out} >= {
        (i, sha(f"p@ss!{i}")) for i in range(40)} | {(100 + i, sha(f"pw!{i}")) for i in range(40)}


def test_secret_candidates_deep_in_a_long_text(spark):
    text = "".join(f"𝒳 key{i:05d}{'a' * (i % 7)}{i:04d}Zz, é" for i in range(20_000))
    got = secret_scan.candidates(frame(spark, [(1, text)])).collect()
    want = [(m.start(), m.end()) for m in re.finditer(r"key\w+", text)]
    assert sorted((r["start"], r["end"]) for r in got) == want
    for r in got:
        assert r["value"] == text[r["start"]:r["end"]]
        assert r["before"] == text[max(0, r["start"] - secret_scan.NEAR):r["start"]]
        assert r["after"] == text[r["end"]:r["end"] + secret_scan.NEAR]


def test_rare_secrets_are_drawn_for_training(spark):
    rows = [(i, f"see /usr/share/internationalization{i}/characteristic{i} and of the") for i in range(1500)]
    rows += [(5000 + i, f'here is token = "{i}f3a9c{i}d07b{i}e51c8842{i}b6" end') for i in range(3)]
    df = frame(spark, rows)
    found = {r["doc_id"] for r in secret_scan.scan(df, max_rows=40).filter("is_secret").collect()}
    assert found == {5000, 5001, 5002}
    labelled = spark.range(20_000).selectExpr("id as doc_id", "0 as start", "int(id < 5) as label")
    for most in (2, 8, 1000):
        drawn = secret_scan.draw(labelled, {0: 19_995, 1: 5}, most).groupBy("label").agg(
            F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w")).collect()
        n, w = {r["label"]: r["n"] for r in drawn}, {r["label"]: r["w"] for r in drawn}
        assert set(n) == {0, 1} and w[0] == pytest.approx(w[1])
        assert n[1] == 5 or most < 10
        assert n[0] < 2 * most + 8


# -------------------------------------------------------------- quality classifier

def test_classifier_learns_from_labels_alone(spark):
    rnd = random.Random(21)
    rows, marks = [], {}
    for i in range(700):
        w = words(rnd, rnd.randint(5, 60))
        bad = i % 4 == 0
        rows.append((i, " ".join((x + "!!").upper() if bad else x for x in w)))
        marks[i] = 0 if bad else 1
    rows += [(2000, None), (2001, ""), (2002, "word " * 20_000), (None, "no id"), (0, rows[0][1])]
    labels = spark.createDataFrame([(i, m) for i, m in marks.items()] + [(1, 0), (1, 1)],
                                   "doc_id long, quality int").withColumn("text", F.lit("clash"))
    out = quality_classifier.classify(frame(spark, rows), labels).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    import zlib
    held = [r for r in out if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert all(r["held_out"] for r in held)
    assert sum(r["held_out"] for r in out) == len(held) + 1               # and the null id
    known = [r for r in held if r["doc_id"] in marks and r["doc_id"] != 1]
    right = sum(r["predicted"] == marks[r["doc_id"]] for r in known)
    assert right >= 0.95 * len(known) and len(known) > 80
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in out)


def test_classifier_without_labels_or_documents(spark, corpus):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality_classifier.classify(frame(spark, corpus), none).collect()} == {0.5}
    assert quality_classifier.classify(empty(spark), none).count() == 0


def test_parity_bitmaps_bound_the_difference():
    rng = np.random.default_rng(6)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2 ** 64, int(rng.integers(1, 300)), dtype=np.uint64))
        b = np.unique(np.concatenate([a[:int(rng.integers(0, len(a) + 1))],
                                      rng.integers(0, 2 ** 64, int(rng.integers(0, 400)), dtype=np.uint64)]))
        if len(b):
            apart = len(np.setxor1d(a, b))
            got = jaccard_join.bits_apart(jaccard_join.parity(a), jaccard_join.parity(b))
            assert got <= apart and (apart > 0 or got == 0) and got % 2 == apart % 2


def test_jaccard_tasks_hold_small_blocks():
    """A task of many texts gives its rows a block at a time."""
    import pyarrow as pa

    from scour.llm.jaccard_join import classes, keyed

    class Docs:
        def mapInArrow(self, run, schema):
            return run

    texts = [" ".join(f"w{i}x{j % 400}" for j in range(1_000)) for i in range(400)]      # 2.8 million characters
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(texts)], names=["doc_id", "text"])
    for of in (lambda d: classes(d, 4), lambda d: keyed(d, 4, 85)):
        assert len(list(of(Docs())(iter([batch])))) > 2


@pytest.mark.parametrize("settle", [0.0, 0.8])
def test_jaccard_ends_when_nothing_is_open(spark, monkeypatch, settle):
    """No bucket with classes of two components is left, at once or after a turn."""
    turns = []

    def few(undecided, count=jaccard_join.outsiders):
        turns.append(count(undecided))
        assert len(turns) < 12, turns
        return turns[-1]

    monkeypatch.setattr(jaccard_join, "outsiders", few)
    base = [f"w{i}" for i in range(60)]
    rows = [(d, " ".join(base + [f"x{d}"])) for d in range(1, 4)] + [(9, "a text of its own here")]
    got = jaccard_join.join_components(frame(spark, rows), settle=settle).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 1, 3: 1, 9: 9}
    assert turns[-1] == 0


def test_jaccard_broadcasts_are_bounded_by_bytes(spark, monkeypatch, corpus):
    """Wide rows are not broadcast where as many ids are; results don't depend on it."""
    def hinted(rows):
        return "ResolvedHint" in rows._jdf.queryExecution().analyzed().toString()

    ids = spark.range(60_000)
    assert hinted(jaccard_join.bounded(ids))
    assert not hinted(jaccard_join.bounded(ids.select("id", *[F.col("id").alias(f"w{i}") for i in range(16)])))

    def found():
        return sorted(map(str, jaccard_join.join_components(frame(spark, corpus), settle=0.0).collect()))

    before = found()
    monkeypatch.setattr(jaccard_join, "BROADCAST_BYTES", -1)
    assert found() == before
