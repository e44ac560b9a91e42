"""Ingest control against a plain sequential loop (the original semantics)."""

import random
import re

from pyspark.sql import functions as F

from scour.operators.ingest import batch_plan, prefix_sum, row_ordinals


def sequential(rows, stored, fails, n, b, offset):
    """The paged loop: stop tested between batches, end of input stops too."""
    stored = set(stored)
    total, out, pages = 0, [], []
    while total < n and offset < len(rows):
        pages.append((b, offset))
        buf = []
        for key in rows[offset:offset + b]:
            if key in stored:
                continue
            if key in fails:
                continue
            buf.append(key)
            total += 1
        stored.update(buf)
        out.extend(buf)
        offset += b
    return total, out, pages


def _embed_failing(fails):
    def embed(df, text):
        bad = F.col("doc_id").isin(list(fails)) if fails else F.lit(False)
        return (df.withColumn("embedding", F.when(~bad, F.array(F.lit(1.0).cast("float"))))
                  .withColumn("error", F.when(bad, F.lit("ClientError"))))
    return embed


def _run(spark, keys, stored, fails, n, b, offset):
    src = spark.createDataFrame([(i, k, f"text-{k}") for i, k in enumerate(keys)],
                                "ord long, doc_id string, text string")
    st = spark.createDataFrame([(k,) for k in stored] or [("__none__",)], "doc_id string")
    kept, rejects, batches = batch_plan(src, "ord", st, _embed_failing(fails),
                                        number_of_records=n, batch_size=b, offset=offset)
    return ([r["doc_id"] for r in kept.orderBy("rn").collect()],
            batches.orderBy("batch_no").collect())


def test_original_happy_case(spark):
    # N=10, batch=2, offset=4, even titles already stored: 10 indexed over 10 pages
    keys = [f"Title{i}" for i in range(1, 41)]
    stored = [k for k in keys if int(re.search(r"\d+", k).group()) % 2 == 0]
    got, batches = _run(spark, keys, stored, set(), 10, 2, 4)
    assert got == [f"Title{2 * i + 5}" for i in range(10)]
    assert [r["page_offset"] for r in batches] == list(range(4, 24, 2))
    assert batches[-1]["total_after"] == 10


def test_original_failures_case(spark):
    # every second document fails: 10 indexed over two pages of 10
    keys = [f"Title{i}" for i in range(1, 41)]
    fails = {k for i, k in enumerate(keys) if i % 2 == 1}
    got, batches = _run(spark, keys, [], fails, 10, 10, 0)
    assert len(got) == 10
    assert [(r["page_offset"], r["fetched"]) for r in batches] == [(0, 10), (10, 10)]


def test_random_cases_match_sequential_loop(spark):
    rnd = random.Random(11)
    for _ in range(5):
        n_rows = rnd.randint(5, 60)
        vocab = [f"d{j}" for j in range(rnd.randint(3, 40))]
        keys = [rnd.choice(vocab) for _ in range(n_rows)]          # repeats on purpose
        stored = rnd.sample(vocab, rnd.randint(0, len(vocab) // 2))
        fails = set(rnd.sample(vocab, rnd.randint(0, len(vocab) // 4)))
        n, b, off = rnd.randint(1, 30), rnd.randint(1, 7), rnd.randint(0, 8)
        total, out, pages = sequential(keys, stored, fails, n, b, off)
        got, batches = _run(spark, keys, stored, fails, n, b, off)
        assert got == out
        assert [(b, r["page_offset"]) for r in batches] == pages
        assert sum(r["indexed"] for r in batches) == total


def test_row_ordinals_are_global(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).alias("k")).repartition(13)
    got = row_ordinals(df, "k", partitions=6).orderBy("k").collect()
    assert [r["rn"] for r in got] == list(range(5000))


def _wide(spark, n, parts=8):
    """Rows with payload columns, in no order, over several partitions."""
    return spark.range(n).select(
        ((F.col("id") * 7919) % n).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("doc_id"),
        F.concat(F.lit("text "), F.col("id").cast("string")).alias("text")).repartition(parts)


def test_row_ordinals_with_payload_equal_positions(spark):
    n = 200_000
    got = row_ordinals(_wide(spark, n), "k", partitions=8)
    assert got.filter("rn != k").count() == 0
    assert got.select("rn").distinct().count() == n and "text" in got.columns


def test_plan_near_the_row_count_matches_sequential_loop(spark):
    n, want, batch = 200_000, 150_000, 100
    src = _wide(spark, n)
    stored = src.filter("k % 7 = 3").select("doc_id")

    def embed(df, text):
        return (df.withColumn("embedding", F.array(F.lit(1.0).cast("float")))
                .withColumn("error", F.lit(None).cast("string")))

    kept, _, batches = batch_plan(src, "k", stored, embed, number_of_records=want, batch_size=batch)
    total = pages = at = 0
    while total < want and at < n:                      # the loop, by arithmetic
        total += sum(1 for k in range(at, min(n, at + batch)) if k % 7 != 3)
        at, pages = at + batch, pages + 1
    assert kept.count() == total and batches.count() == pages
    assert kept.filter("rn != k or k % 7 = 3").count() == 0


def test_exact_trims_rows_and_totals(spark):
    keys = [f"d{i}" for i in range(40)]
    src = spark.createDataFrame([(i, k, k) for i, k in enumerate(keys)],
                                "ord long, doc_id string, text string")
    none = spark.createDataFrame([], "doc_id string")
    kept, _, batches = batch_plan(src, "ord", none, _embed_failing(set()), number_of_records=11,
                                  batch_size=4, exact=True)
    rows = batches.orderBy("batch_no").collect()
    assert kept.count() == 11
    assert [r["indexed"] for r in rows] == [4, 4, 3] and rows[-1]["total_after"] == 11


def test_every_new_id_is_embedded_once(spark):
    # copies within and across batches and rounds; a failing id is not offered again
    keys = [f"d{i % 9}" for i in range(60)]
    calls = spark.sparkContext.accumulator(0)

    def embed(df, text):
        @F.udf("boolean")
        def bad(t):
            calls.add(1)
            return t == "text-d4"

        out = df.withColumn("_bad", bad.asNondeterministic()(text))
        return (out.withColumn("embedding", F.when(~F.col("_bad"), F.array(F.lit(1.0).cast("float"))))
                .withColumn("error", F.when(F.col("_bad"), F.lit("ClientError"))).drop("_bad"))

    src = spark.createDataFrame([(i, k, f"text-{k}") for i, k in enumerate(keys)],
                                "ord long, doc_id string, text string")
    none = spark.createDataFrame([("d7",)], "doc_id string")
    kept, rejects, _ = batch_plan(src, "ord", none, embed, number_of_records=1000, batch_size=4)
    kept.collect()
    # d4 is a reject of every batch that offers it, the others of none
    assert sorted(r["ord"] for r in rejects.collect()) == list(range(4, 60, 9))
    assert calls.value == 8


def test_prefix_sum_two_levels(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(50)], "b long, v long")
    got = prefix_sum(df, "b", "v", "before", block=7).orderBy("b").collect()
    run = 0
    for r in got:
        assert r["before"] == run
        run += r["v"]


def test_rounds_stop_early(spark):
    # 400 rows, N=12 with batches of 3 and a third of the ids stored: the
    # rounds embed a prefix only
    keys = [f"k{i % 300}" for i in range(400)]          # repeats after 300
    stored = [f"k{i}" for i in range(0, 300, 3)]
    fails = {f"k{i}" for i in range(1, 300, 7)}
    total, out, pages = sequential(keys, stored, fails, 12, 3, 5)
    got, batches = _run(spark, keys, stored, fails, 12, 3, 5)
    assert got == out
    assert [(3, r["page_offset"]) for r in batches] == pages
    assert sum(r["indexed"] for r in batches) == total


def test_rounds_embed_a_prefix_only(spark):
    seen = []

    def embed(df, text):
        from scour.session import materialize
        out = materialize(df.withColumn("embedding", F.array(F.lit(1.0).cast("float")))
                          .withColumn("error", F.lit(None).cast("string")), "probe")
        seen.append(out.count())
        return out

    src = spark.createDataFrame([(i, f"id{i}", f"t{i}") for i in range(2000)],
                                "ord long, doc_id string, text string")
    st = spark.createDataFrame([("__none__",)], "doc_id string")
    kept, _, batches = batch_plan(src, "ord", st, embed, number_of_records=20,
                                  batch_size=10)
    assert kept.count() == 20
    assert sum(seen) == 20          # one round of two pages, not 2,000 rows


def test_skip_stored_bounded_equals_anti_join(spark):
    from scour.operators.ingest import skip_stored

    docs = spark.createDataFrame([(i, f"k{i % 17}") for i in range(120)], "ord long, doc_id string")
    stored = spark.createDataFrame([(f"k{i}",) for i in range(0, 30, 4)] * 3, "doc_id string")
    want = sorted(r["ord"] for r in skip_stored(docs, stored).collect())
    got = sorted(r["ord"] for r in skip_stored(docs, stored, rows_bound=120).collect())
    assert got == want and len(want) > 0


def test_rounds_with_a_hot_key_match_sequential_loop(spark):
    # one content id holds a third of all rows, spread over every page
    keys = [("hot" if i % 3 == 0 else f"d{i}") for i in range(150)]
    stored = [f"d{i}" for i in range(0, 150, 5)]
    fails = {f"d{i}" for i in range(1, 150, 11)}
    for n, b, off in [(25, 4, 3), (200, 6, 0)]:
        total, out, pages = sequential(keys, stored, fails, n, b, off)
        got, batches = _run(spark, keys, stored, fails, n, b, off)
        assert got == out
        assert [(b, r["page_offset"]) for r in batches] == pages
        assert sum(r["indexed"] for r in batches) == total
