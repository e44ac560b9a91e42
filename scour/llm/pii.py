"""Personal data by weak supervision, in DataFrame functions only.

Base spans (mail, address, card, phone) are fixed patterns with checks. Spans
beyond them are learned. Candidates are numbers in groups, long numbers,
account numbers and spelled-out mail addresses that no base span covers.
Labelers vote on each, or abstain: patterns (shape, digit count), gazetteers
(country codes of accounts, words that announce versions, pages or laws) and
context (words that announce personal data). Expectation-maximisation over the
vote patterns estimates how reliable each labeler is and how likely each
pattern means personal data; with these as weights a logistic regression learns
the final span classifier from the spans' own features.

Votes and features take few values, so both models learn from counts per
pattern: a table of bounded size, whatever the corpus. Texts are scanned row by
row without a shuffle. Positions are code points: the pieces between matches
and the matches themselves add up to them.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scour.llm.common import stage

# The fixed base patterns, written so that Java needs no backtracking: a run can
# only begin at its first character (or where the last match ended).
EMAIL = (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ["email", "ip", "card", "phone"]
OTHER = "id"

CANDIDATE = (r"(?<![A-Za-z0-9.+@-])(?:"
             r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+(?:\x20?[A-Z0-9]{1,3})?+"
             r"|[A-Za-z0-9._%-]{1,64}+\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,64}+"
             r"(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]{1,64}+)++"
             r"|\(?[0-9]{2,5}\)?(?:[\x20.-][0-9]{2,5}){1,5}+"
             r"|[0-9]{7,20}+)(?![A-Za-z0-9])")
BEFORE = 32
#: Words that announce personal data, in the corpus' languages.
CUES = ("phone tel telephone call fax mobile cell contact ssn social passport account iban card "
        "mail email e-mail address birth licence id téléphone appelez portable courriel compte "
        "carte teléfono llame móvil correo cuenta tarjeta telefon ruf handy konto karte ausweis")
#: Words that announce other numbers.
NOT_CUES = ("version release licence license isbn issn doi page pages chapter section article figure "
            "table line build rfc iso year version. seite kapitel abschnitt página capítulo artículo "
            "chapitre § no. nr. vol")
#: Country codes that open account numbers (fixed values).
ACCOUNT_CODES = ("AD AE AL AT AZ BA BE BG BH BR CH CR CY CZ DE DK DO EE ES FI FR GB GE GI GR HR HU IE "
                 "IL IS IT JO KW KZ LB LI LT LU LV MC MD ME MK MT NL NO PK PL PT QA RO RS SA SE SI SK "
                 "SM TN TR UA VG XK")
VOTES = ["shape", "digits", "account_code", "not_cue", "cue"]


SPANS = "array<struct<start:int,end:int,value:string>>"
#: Characters of a piece of a text; a place in it is reached without a walk from its start.
PIECE = 1024


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def running(numbers: Column, op: Callable[[Column, Column], Column]) -> Column:
    """array<int>: 0 and the first, the first two, … of ``numbers`` under ``op``
    (associative, 0 neutral), one entry more than numbers.

    An array grows by being copied, so the totals of blocks are run first and
    then those inside each block: n numbers cost about n ** (4 / 3) steps."""
    def grown(part: Column, first: Column) -> Column:
        return F.aggregate(part, F.array(first), lambda acc, x: F.concat(
            acc, F.array(op(F.element_at(acc, -1), x))))

    def within(w: Column) -> Column:
        size = F.greatest(F.lit(32), F.ceil(F.cbrt(F.size(w))).cast("int"))
        starts = F.sequence(F.lit(1), F.size(w), size)
        totals = F.transform(starts, lambda i: F.aggregate(F.slice(w, i, size), F.lit(0), op))
        each = let(grown(totals, F.lit(0)), lambda heads: F.flatten(F.transform(
            starts, lambda i, k: F.slice(grown(F.slice(w, i, size), heads[k]), F.lit(2), size))))
        return F.when(F.size(w) > 0, F.concat(F.array(F.lit(0)), each)).otherwise(F.array(F.lit(0)))

    return let(numbers, within)


def pieces(text: Column) -> Column:
    """The text in pieces of PIECE characters, for ``cut``."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def cut(parts: Column, start: Column, length: Column) -> Column:
    """``length`` characters from ``start`` (counted from 0) of a text in ``pieces``."""
    first = F.floor(start / PIECE).cast("int")
    some = F.array_join(F.slice(parts, first + 1, F.floor(length / PIECE).cast("int") + 2), "")
    return F.substring(some, start - first * PIECE + 1, length)


def matches(text: Column, pattern: str, near: Column) -> Column:
    """array<struct<start, end, value>> of all matches; ``near`` is a cheap test
    without which there can be none."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)

    def walked(found: Column) -> Column:
        steps = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)),
                           lambda v, g: F.length(v) + g)
        return let(running(steps, lambda a, b: a + b), lambda ends: F.transform(
            found, lambda v, i: F.struct((ends[i + 1] - F.length(v)).alias("start"),
                                         ends[i + 1].alias("end"), v.alias("value"))))

    none = F.array().cast(SPANS)
    return F.when(near, let(found, lambda v: F.when(F.size(v) > 0, walked(v)).otherwise(none))
                  ).otherwise(none)


def covered_by(spans: Column, c: Column) -> Column:
    """Does one of ``spans`` (sorted, apart from each other) share a character with
    ``c``? The last one that starts before the end of ``c`` tells; it is found by
    halving."""
    bits = F.sequence(F.floor(F.log2(F.size(spans))).cast("int"), F.lit(0), F.lit(-1))
    before = F.aggregate(F.transform(bits, lambda k: F.call_function("shiftleft", F.lit(1), k)), F.lit(0),
                         lambda n, step: F.when((n + step <= F.size(spans)) & (
                             F.get(spans, n + step - 1)["start"] < c["end"]), n + step).otherwise(n))
    return F.when(F.size(spans) > 0, let(before, lambda n: F.when(
        n > 0, F.get(spans, n - 1)["end"] > c["start"]).otherwise(False))).otherwise(False)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Does a string of digits pass the Luhn check?"""
    places = F.transform(F.split(F.reverse(number), "(?<=.)(?=.)"), lambda c: c.cast("int"))
    total = F.aggregate(F.transform(places, lambda d, i: F.when(i % 2 == 0, d).otherwise(
        F.when(d > 4, 2 * d - 9).otherwise(2 * d))), F.lit(0), lambda a, d: a + d)
    return total % 10 == 0


def small_parts(value: Column) -> Column:
    """Are all dotted parts at most 255?"""
    return F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3)
                    & (F.right(p, F.lit(3)).cast("int") <= 255))


def free_prefix(df: DataFrame) -> str:
    """Underscores that keep the names of the found columns apart from those of ``df``."""
    taken, prefix = {c.lower() for c in df.columns}, "_"
    while taken & {prefix + k for k in [*KINDS, "other", "candidates"]}:
        prefix += "_"
    return prefix


def annotate(df: DataFrame, text_col: str = "text", prefix: str = "_") -> DataFrame:
    """``df`` with _email, _ip, _card, _phone (base spans) and _candidates."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    has_digit = text.rlike("[0-9]")
    email, ip, card, phone, candidates = (prefix + k for k in [*KINDS, "candidates"])
    out = df.withColumns({
        email: matches(text, EMAIL, F.contains(text, F.lit("@"))),
        ip: matches(text, IP, has_digit),
        card: matches(text, CARD, has_digit),
        phone: matches(text, PHONE, F.contains(text, F.lit("+"))),
        candidates: matches(text, CANDIDATE, has_digit | text.rlike(r"[\[(]at[\])]"))})
    size = lambda x: F.length(digits(x["value"]))
    out = out.withColumns({
        ip: F.filter(ip, lambda x: small_parts(x["value"])),
        card: F.filter(card, lambda x: F.when(size(x).between(16, 19),
                                              luhn(digits(x["value"]))).otherwise(False)),
        phone: F.filter(phone, lambda x: size(x).between(8, 15))})
    # bound by let: where a filter is pushed down, an expression in a lambda is run per element
    free = let(F.array(email, ip, card, phone), lambda base: F.filter(
        candidates, lambda c: ~F.exists(base, lambda spans: covered_by(spans, c))))
    around = let(pieces(text), lambda parts: F.transform(free, lambda c: F.struct(
        c["start"].alias("start"), c["end"].alias("end"), c["value"].alias("value"),
        F.lower(cut(parts, F.greatest(c["start"] - BEFORE, F.lit(0)),
                    F.least(c["start"], F.lit(BEFORE)))).alias("before"))))
    none = F.array().cast("array<struct<start:int,end:int,value:string,before:string>>")
    return out.withColumn(candidates, F.when(F.size(candidates) > 0, around).otherwise(none))


def votes(c: Column) -> dict[str, Column]:
    """1 personal, 0 not, -1 abstain, by labeler."""
    value, n = c["value"], F.length(digits(c["value"]))
    last = F.split(F.trim(c["before"]), r"[\s,;:=]+")
    word = lambda names: F.exists(F.slice(F.reverse(last), 1, 3), lambda w: w.isin(names.split()))
    shape = value.rlike(r"^\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$|^[0-9]{3}-[0-9]{2}-[0-9]{4}$"
                        r"|at[\])]|^[A-Z]{2}[0-9]{2}")
    return {"shape": F.when(shape, 1).when(value.rlike(r"^[0-9]{1,5}[.][0-9]{1,5}$"), 0).otherwise(-1),
            "digits": F.when(n.between(9, 15), 1).when(n < 7, 0).otherwise(-1),
            "account_code": F.when(F.substring(value, 1, 2).isin(ACCOUNT_CODES.split()), 1)
            .when(value.rlike("^[A-Z]{2}"), 0).otherwise(-1),
            "not_cue": F.when(word(NOT_CUES), 0).otherwise(-1),
            "cue": F.when(word(CUES), 1).otherwise(-1)}


def features(c: Column) -> dict[str, Column]:
    """What the final classifier sees of a span; few values each."""
    value, n = c["value"], F.length(digits(c["value"]))
    vote = votes(c)
    flag = lambda x: x.cast("double")
    return {"few_digits": flag(n < 7), "many_digits": flag(n.between(9, 15)),
            "very_many_digits": flag(n > 15), "grouped": flag(value.rlike("[0-9)][ -][0-9(]")),
            "dotted": flag(value.rlike("[0-9][.][0-9]")), "letters": flag(value.rlike("[A-Za-z]")),
            "shaped": flag(vote["shape"] == 1), "cued": flag(vote["cue"] == 1),
            "counted": flag(vote["not_cue"] == 0)}


FEATURES = ["few_digits", "many_digits", "very_many_digits", "grouped", "dotted", "letters",
            "shaped", "cued", "counted"]


def reliabilities(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50,
                  ) -> tuple[float, list[list[list[float]]]]:
    """EM over (votes, count): the share of personal data, and the chance
    [class][labeler][abstain, 0, 1] of every vote. Starts at the majority."""
    k = len(VOTES)
    total = sum(n for _, n in patterns)

    def posterior(v, share, table):
        a, b = math.log(share), math.log(1 - share)
        for j, x in enumerate(v):
            a += math.log(table[1][j][x + 1])
            b += math.log(table[0][j][x + 1])
        return 1 / (1 + math.exp(min(60.0, max(-60.0, b - a))))

    lean = [sum(1 if x == 1 else -1 if x == 0 else 0 for x in v) for v, _ in patterns]
    belief = [1 / (1 + math.exp(-1.5 * s + 0.75)) for s in lean]
    share, table = 0.5, []
    for _ in range(rounds):
        share = min(0.95, max(0.001, sum(p * n for p, (_, n) in zip(belief, patterns, strict=True))
                              / max(1, total)))
        table = [[[0.5] * 3 for _ in range(k)] for _ in range(2)]
        # a labeler is taken to be better than chance: pseudo-counts on its own side
        for j in range(k):
            table[1][j][2] += 2.0
            table[0][j][1] += 2.0
        for p, (v, n) in zip(belief, patterns, strict=True):
            for j, x in enumerate(v):
                table[1][j][x + 1] += p * n
                table[0][j][x + 1] += (1 - p) * n
        table = [[[c / sum(row) for c in row] for row in side] for side in table]
        belief = [posterior(v, share, table) for v, _ in patterns]
    return share, table


def belief_column(vote: dict[str, Column], share: float, table: list) -> Column:
    """Posterior of personal data as an expression over the votes."""
    odds = F.lit(math.log(share / (1 - share)))
    for j, name in enumerate(VOTES):
        ratio = [math.log(table[1][j][x] / table[0][j][x]) for x in range(3)]
        odds = odds + F.when(vote[name] == 1, ratio[2]).when(vote[name] == 0, ratio[1]).otherwise(ratio[0])
    return 1 / (1 + F.exp(-odds))


def learn(annotated: DataFrame, prefix: str = "_") -> list[float] | None:
    """Intercept and coefficients of the span classifier; None without candidates."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    # outer: for a plain explode all patterns would run again in an inferred filter
    spans = annotated.select(F.explode_outer(prefix + "candidates").alias("c")).filter("c is not null")
    counts = stage(spans.select(*[v.cast("int").alias(f"v_{k}") for k, v in votes(F.col("c")).items()],
                                *[v.alias(k) for k, v in features(F.col("c")).items()])
                   .groupBy(*[f"v_{k}" for k in VOTES], *FEATURES)
                   .agg(F.count(F.lit(1)).alias("n")), "pii-patterns")
    rows = counts.groupBy(*[f"v_{k}" for k in VOTES]).agg(F.sum("n").alias("n")).collect()
    if not rows:                                          # at most 3 ** len(VOTES) rows
        return None
    share, table = reliabilities(sorted((tuple(r)[:-1], r.n) for r in rows))
    belief = belief_column({k: F.col(f"v_{k}") for k in VOTES}, share, table)
    soft = counts.withColumn("p", belief).withColumn("side", F.explode(F.array(F.lit(1.0), F.lit(0.0))))
    soft = soft.withColumn("w", F.col("n") * F.when(F.col("side") == 1, F.col("p"))
                           .otherwise(1 - F.col("p"))).filter("w > 0")
    model = LogisticRegression(featuresCol="x", labelCol="side", weightCol="w", maxIter=100,
                               regParam=1e-3, standardization=False).fit(
        VectorAssembler(inputCols=FEATURES, outputCol="x").transform(soft))
    return [float(model.intercept), *map(float, model.coefficients)]


def accepted(model: list[float] | None, threshold: float, prefix: str = "_") -> Column:
    """Candidates whose probability reaches ``threshold``."""
    if model is None:
        return F.filter(prefix + "candidates", lambda c: F.lit(False))

    def probability(c: Column) -> Column:
        own = features(c)
        z = F.lit(model[0])
        for weight, name in zip(model[1:], FEATURES, strict=True):
            z = z + weight * own[name]
        return 1 / (1 + F.exp(-z))

    return F.filter(prefix + "candidates", lambda c: probability(c) >= threshold)


def span_text(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat(F.lit(kind + ":"), s["start"].cast("string"),
                                                 F.lit(":"), s["end"].cast("string")))


def can_be_written(df: DataFrame) -> bool:
    """Can Parquet hold the columns? It has no void and no interval, and a name once only."""
    kinds = df.schema.simpleString()
    return (not ("void" in kinds or "interval" in kinds)
            and len({c.lower() for c in df.columns}) == len(df.columns))


def find(df: DataFrame, threshold: float = 0.9, text_col: str = "text") -> DataFrame:
    """``df`` with _email, _ip, _card, _phone and _other: arrays of
    struct<start, end, value>, code points, end exclusive. If ``df`` has a column
    of one of these names (or _candidates), all five get more underscores.

    Null and empty texts have no spans; rows stay as they are, repeated ones
    repeated; without candidates nothing is learned and _other is empty. The texts are
    searched once: the rows with their base spans and candidates are written, and learning
    and the result read them, so that the plans of later steps hold no patterns."""
    prefix = free_prefix(df)
    annotated = annotate(df, text_col, prefix)
    if can_be_written(annotated):
        annotated = stage(annotated, "pii-spans")
    model = learn(annotated, prefix)
    return annotated.withColumn(prefix + "other", accepted(model, threshold, prefix)).drop(
        prefix + "candidates")


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           threshold: float = 0.9) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_other."""
    slim = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    annotated = stage(annotate(slim).drop("text"), "pii-spans")
    found = annotated.withColumn("_other", accepted(learn(annotated), threshold))
    base = F.array_join(F.concat(*[span_text(k, F.col(f"_{k}")) for k in KINDS]), ",")
    everything = F.array_join(F.concat(*[span_text(k, F.col(f"_{k}")) for k in KINDS],
                                       span_text(OTHER, F.col("_other"))), ",")
    return found.select("doc_id", *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
                        F.sha2(base, 256).alias("base_sha256"), everything.alias("spans"),
                        F.size("_other").cast("long").alias("n_other"))


def redact(df: DataFrame, threshold: float = 0.9, text_col: str = "text") -> DataFrame:
    """``df`` with every span in ``text_col`` replaced by its kind in brackets;
    overlapping spans become one, of the kind that starts first."""
    prefix = free_prefix(df)
    found = find(df, threshold, text_col)

    def named(name: str, kind: str) -> Column:
        return F.transform(prefix + name, lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    text = F.col(text_col)
    spans = F.array_sort(F.concat(*[named(k, k) for k in KINDS], named("other", OTHER)))

    def written(spans: Column) -> Column:
        """Pieces between the spans and kinds; ``ends`` is how far the spans before reach."""
        ends = running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
        return let(pieces(text), lambda parts: let(ends, lambda ends: F.concat(
            F.array_join(F.transform(spans, lambda s, i: F.when(s["start"] >= ends[i], F.concat(
                cut(parts, ends[i], s["start"] - ends[i]), F.lit("["), s["kind"], F.lit("]")))
                .otherwise("")), ""),
            cut(parts, F.element_at(ends, -1), F.length(text)))))

    masked = let(spans, lambda s: F.when(F.size(s) > 0, written(s)).otherwise(text))
    return found.withColumn(text_col, masked).select(*df.columns)
