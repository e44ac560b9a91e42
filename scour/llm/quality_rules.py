"""Quality rules with risk-controlled thresholds.

Every document gets counts (words, symbols, repeated lines, ...) and from them
seven one-sided rules, each a share that junk drives up. The cutoffs are not
chosen by hand. Per stratum (language), labelled good documents are dealt into
two halves:

* the first half gives, for a ladder of levels from careful to strict, the
  cutoff of every rule as that level's quantile;
* the second half counts, level by level, how many good documents the rules
  together would reject. The ladder is walked from the careful end
  (fixed-sequence testing) and stops before the first level at which an exact
  binomial test cannot exclude a false-rejection rate above ``risk``.

The tests share one error budget: ``delta`` is divided by the number of strata
(Bonferroni), and walking a fixed sequence needs no further correction. So with
probability 1 - ``delta`` no stratum loses more than ``risk`` of its good
documents to the rules. A stratum with too few labels to certify any level
rejects nothing beyond the base rules.

Features are computed once, in a map without a shuffle, and written to the
shared folder; learning reads only the labelled rows of that table and
aggregates them to strata x levels rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scour.llm.common import stage

WINDOW = 8
SPACE = b"\x20\t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
#: The ladder from careful to strict: first cutoffs beyond all good documents of
#: the first half (median + MARGINS x distance from median to maximum), then quantiles.
MARGINS = (3.0, 2.0, 1.5, 1.25, 1.1, 1.0)
QUANTILES = (0.9995, 0.999, 0.998, 0.997, 0.996, 0.995, 0.9925, 0.99)
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
          "n_upper", "n_marks", "n_top_word"]
RULES = ["symbols", "marks", "dup_lines", "repeats", "upper", "top_word", "word_length"]


def repeated_words(codes: np.ndarray, window: int = WINDOW) -> int:
    """Words covered by windows of ``window`` words (a power of two) that occur
    at least twice. Windows are named exactly, by doubling."""
    n = len(codes)
    if n <= window:
        return 0
    name, width = codes.astype(np.int64), 1
    while width < window:
        pair = (name[:len(name) - width] << 32) | name[width:]
        _, name = np.unique(pair, return_inverse=True)
        width *= 2
    twice = np.bincount(name)[name] > 1
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    edge[at] += 1
    np.subtract.at(edge, at + window, 1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def count_text(text: str) -> tuple[int, ...]:
    """COUNTS of one text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return (0,) * len(COUNTS)
    less = lambda drop: len(raw) - len(raw.translate(None, drop))
    seen: set[str] = set()
    lines = dup = 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            lines += 1
            dup += line in seen
            seen.add(line)
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    top, repeats = 1, 0
    if len(number) < len(words):
        codes = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        top = int(np.bincount(codes).max())
        repeats = repeated_words(codes)
    return (len(words), len(text) - less(SPACE), less(SYMBOLS), dup, repeats, lines,
            less(UPPER), less(MARKS), top)


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            stratum_col: str = "lang") -> DataFrame:
    """doc_id, stratum and COUNTS of every whole text (null: no words)."""
    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [count_text(t.as_py() or "") for t in batch.column(1)]
            columns = list(zip(*rows, strict=True)) or [()] * len(COUNTS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), *(pa.array(c, pa.int64()) for c in columns)],
                ["doc_id", "stratum", *COUNTS])

    return source.mapInArrow(run, "doc_id long, stratum string, "
                             + ", ".join(f"{c} long" for c in COUNTS))


def rule_values() -> dict[str, Column]:
    """The rules over COUNTS; higher is worse. No words: zero."""
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return {"symbols": share("n_symbols", "word_chars"), "marks": share("n_marks", "word_chars"),
            "dup_lines": share("n_dup_lines", "n_lines"),
            "repeats": share("n_repeat_words", "n_words"), "upper": share("n_upper", "word_chars"),
            "top_word": share("n_top_word", "n_words"),
            "word_length": share("word_chars", "n_words")}


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p): the exact p-value of "rate >= p"."""
    if n <= 0:
        return 1.0
    lp, lq = math.log(p), math.log1p(-p)
    top = math.lgamma(n + 1)
    terms = [top - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * lp + (n - i) * lq
             for i in range(min(k, n) + 1)]
    most = max(terms)
    return min(1.0, math.exp(most) * sum(math.exp(t - most) for t in terms))


def certified_level(fired: list[int], n: int, risk: float, alpha: float) -> int:
    """Last level of the ladder whose test passes, before the first that fails; -1: none."""
    best = -1
    for i, k in enumerate(fired):
        if binomial_tail(int(k), int(n), risk) > alpha:
            break
        best = i
    return best


def learn(measured: DataFrame, labels: DataFrame, risk: float, delta: float,
          label_id: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """stratum, cut_<rule>: the certified cutoffs (no row: none certified)."""
    good = (labels.groupBy(F.col(label_id).cast("long").alias("doc_id"))
            .agg(F.min(label_col).alias("_label")).filter("_label = 1").select("doc_id"))
    rows = (measured.filter(~base_failed()).join(good, "doc_id")
            .select("stratum", (F.xxhash64("doc_id") % 2 == 0).alias("_first"),
                    *[v.alias(k) for k, v in rule_values().items()]))
    cuts = rows.filter("_first").groupBy("stratum").agg(
        *[F.percentile_approx(k, [0.5, 1.0, *QUANTILES], 100_000).alias(k) for k in RULES])
    cuts = cuts.select("stratum", *[F.concat(
        F.array(*[F.col(k)[0] + m * (F.col(k)[1] - F.col(k)[0]) for m in MARGINS]),
        F.slice(k, 3, len(QUANTILES))).alias(f"q_{k}") for k in RULES])
    levels = range(len(MARGINS) + len(QUANTILES))
    fires = [F.array(*[F.col(k) > F.col(f"q_{k}")[i] for k in RULES]) for i in levels]
    tests = (rows.filter(~F.col("_first")).join(cuts, "stratum").groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(F.when(F.exists(fires[i], lambda x: x), 1)).alias(f"k{i}") for i in levels]))
    strata = tests.agg(F.count(F.lit(1)).alias("strata"))

    @F.pandas_udf("int")
    def level(n: pd.Series, strata: pd.Series, fired: pd.Series) -> pd.Series:
        return pd.Series([certified_level(list(f), a, risk, delta / max(1, s))
                          for a, s, f in zip(n, strata, fired, strict=True)], dtype="int32")

    chosen = (tests.join(F.broadcast(strata))                 # one row: the number of tests
              .select("stratum", level("n", "strata", F.array(*[f"k{i}" for i in levels]))
                      .alias("level")).filter("level >= 0"))
    return cuts.join(chosen, "stratum").select(
        "stratum", "level", *[F.col(f"q_{k}")[F.col("level")].alias(f"cut_{k}") for k in RULES])


def apply_rules(df: DataFrame, labels: DataFrame, risk: float = 0.01,
                delta: float = 0.05, max_broadcast_strata: int = 10_000) -> DataFrame:
    """doc_id, counts, base_failed, kept, stratum and the rules that fired.

    Null, empty and blank texts have zero counts and fail the base rule; a null
    language is a stratum of its own; repeated rows come out repeated; several
    labels of one document count as its worst; no labels: base rules only;
    columns besides the three named are not read."""
    measured = stage(measure(df), "quality-rules")
    cuts = stage(learn(measured, labels, risk, delta), "quality-cuts")
    if cuts.count() <= max_broadcast_strata:
        cuts = F.broadcast(cuts)
    values = rule_values()
    fired = F.filter(F.array(*[F.when(values[k] > F.col(f"cut_{k}"), F.lit(k)) for k in RULES]),
                     lambda x: x.isNotNull())
    return (measured.join(cuts, "stratum", "left")
            .withColumn("base_failed", base_failed()).withColumn("fired", fired)
            .select("doc_id", *COUNTS[:5], "base_failed",
                    (~F.col("base_failed") & (F.size("fired") == 0)).alias("kept"),
                    "stratum", "fired"))
