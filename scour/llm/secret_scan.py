"""Secret scan with a random forest, in DataFrame functions and Spark ML only.

Candidates are long runs of key characters, long words among them, and by their
place, of any length and with any marks, the whole value assigned to a secret's
name and the password in an address. The forest removes false positives. It sees the length, how often the kind of character
changes, how much of the run the dictionary covers (the letter triples of the
corpus' own words, counted over all documents), whether the run is part of a
path, address or mail, and what the words next to it announce.

It learns from labelled findings: given ones, or where none are given those that
rules can settle, which are the formats of well-known providers and values
assigned to a secret's name (secrets), and checksums, commits, placeholders,
paths and plain words (no secrets). Texts are scanned row by row; only
candidates, which are few, are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scour.llm.common import stage
from scour.llm.pii import cut, let, matches, pieces

RUN = r"(?<![\p{L}\p{N}+/_-])[A-Za-z0-9+/_-]{12,}+(?!\p{L})"
WORD_LENGTH = 16                # letters only: this long at least
NEAR = 32
#: Formats of well-known providers.
PROVIDERS = (r"^(?:AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{36,}$|^xox[abpr]-[A-Za-z0-9-]{10,}$"
             r"|^sk_(?:live|test)_[A-Za-z0-9]{16,}$|^AIza[A-Za-z0-9_-]{35}$|^glpat-[A-Za-z0-9_-]{20}$")
SECRET_NAMES = r"(?:pass(?:word|wd|phrase)?|secret|token|api[_-]?key|access[_-]?key|auth|credential|private[_-]?key)"
OTHER_NAMES = r"(?:commit|sha-?\d*|md5|checksum|digest|hash|uuid|guid|revision|version|build|isbn|etag|id)"
#: A secret's name and the sign of assignment.
ASSIGN = r"(?i)" + SECRET_NAMES + r"(?:\\?[\"'`\])]){0,3}[ \t]*+(?::=|=>|={1,3}|:)[ \t]*+"
QUOTED = r"(?:\"(?:[^\"\\\r\n]|\\.)++\"|'(?:[^'\\\r\n]|\\.)++'|`(?:[^`\\\r\n]|\\.)++`)"
#: The whole value: quoted, or up to white space; not a further name and sign.
ASSIGNED = (ASSIGN + r"(?!(?:[A-Za-z]{1,20}[_.-])?" + ASSIGN + ")(?:" + QUOTED
            + r"|[^\s\"'`<=]\S*+|[\"'`]\S++)")
#: Marks around an unquoted value that belong to the text.
LEAD, TAIL = r"^\\?[\"'`]?", r"[,;:.)}\]>\"'`\\]+$"
#: scheme://user:password@host, from the first colon; a port is no password.
USER = r"://[^\s/?#@:\"<>]*+:"
LOGIN = (r"(?<=[A-Za-z0-9+.-])" + USER + r"(?:[^\s/?#\"<>]+(?=@[\w\[])"
         r"|(?!\d{1,5}[/?#])[^\s\"<>]+?(?=@[\w\[]))")
#: What a candidate was found by, and the factor by which its start is put before its end.
RUN_KIND, ASSIGNED_KIND, LOGIN_KIND = 0, 1, 2
SPAN = 1 << 31
PLACEHOLDER = r"(?i)example|sample|dummy|placeholder|change-?me|your[_-]|x{6,}|(.)\1{5,}|0123456|abcdef0"
#: A letter triple is in the dictionary if so many words in a million hold it.
TRIPLE_SHARE = 5
FEATURES = ["length", "changes", "change_rate", "digit_share", "upper_share", "distinct_share",
            "coverage", "hex", "path", "mail", "assigned", "quoted", "secret_name", "other_name"]


def candidates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, end, value, before, after, kind of every candidate; a span
    found by its place and as a run is one."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    spans = F.filter(matches(F.col("text"), RUN, F.col("text").rlike("[A-Za-z0-9+/_-]{12}")),
                     lambda s: s["value"].rlike("[A-Za-z]") & (
                         s["value"].rlike("[0-9]") | (F.length(s["value"]) >= WORD_LENGTH)))
    runs = F.transform(spans, lambda s: packed(s["start"], s["end"]))
    logins = F.transform(matches(F.col("text"), LOGIN, F.col("text").rlike(USER)), lambda s: packed(
        s["start"] + F.length(F.regexp_extract(s["value"], "^" + USER, 0)), s["end"]))
    values = F.filter(F.transform(matches(F.col("text"), ASSIGNED, F.col("text").rlike(ASSIGN)),
                                  assigned_value), lambda s: s % SPAN > F.floor(s / SPAN))
    rows = rows.select("*", runs.alias("runs"), logins.alias("logins"), values.alias("values"))
    each = lambda spans, kind: F.transform(spans, lambda s: F.struct(
        F.shiftright(s, 31).cast("int").alias("start"), (s % SPAN).cast("int").alias("end"),
        F.lit(kind).alias("kind")))
    kinds = F.concat(each(F.array_distinct("logins"), LOGIN_KIND),
                     each(F.array_except("values", "logins"), ASSIGNED_KIND),
                     each(F.array_except("runs", F.concat("values", "logins")), RUN_KIND))
    around = let(pieces(F.col("text")), lambda parts: F.transform(kinds, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"),
        cut(parts, s["start"], s["end"] - s["start"]).alias("value"),
        cut(parts, F.greatest(s["start"] - NEAR, F.lit(0)),
            F.least(s["start"], F.lit(NEAR))).alias("before"),
        cut(parts, s["end"], F.lit(NEAR)).alias("after"),
        s["kind"].alias("kind"))))
    # outer: for a plain explode all patterns would run again in an inferred filter
    return rows.select("doc_id", F.explode_outer(around).alias("s")).filter(
        "s is not null").select("doc_id", "s.*")


def packed(start: Column, end: Column) -> Column:
    """A span as one number, by which spans are compared."""
    return start.cast("long") * SPAN + end


def assigned_value(found: Column) -> Column:
    """The span of the value in a match of ASSIGNED; empty if only marks are left."""
    sign = F.length(F.regexp_extract(found["value"], "^" + ASSIGN, 0))
    raw = F.substring(found["value"], sign + 1, F.length(found["value"]))
    lead = F.length(F.regexp_extract(raw, LEAD, 0))
    bare = F.length(F.regexp_replace(raw, TAIL, ""))
    start = found["start"] + sign
    return F.when(raw.rlike("^" + QUOTED + "$"), packed(start + 1, found["end"] - 1)).otherwise(
        packed(start + lead, start + F.greatest(lead, bare)))


def triples(word: Column) -> Column:
    """Letter triples of a string, lower-cased, with repetitions."""
    runs = F.regexp_extract_all(F.lower(word), F.lit("[a-z]{3,}+"), F.lit(0))
    return F.flatten(F.transform(runs, lambda r: F.transform(
        F.sequence(F.lit(1), F.length(r) - 2), lambda i: F.substring(r, i, 3))))


def dictionary(df: DataFrame, text_col: str) -> DataFrame:
    """Letter triples (at most 26 ** 3) common in the words of all documents.

    Words are cut out at white space and marks and must be letters only, so
    that keys do not count themselves."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = df.select(F.explode(F.split(F.lower(text), r"[\s.,;:!?|()\"']+")).alias("word"))
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(
        F.col("word").rlike(r"^\p{L}{3,}$"))
    rows = counted.select("n", F.explode(triples(F.col("word"))).alias("triple")).groupBy(
        "triple").agg(F.sum("n").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return rows.join(F.broadcast(total)).filter(                # one row
        F.col("n") * 1_000_000 >= F.col("total") * TRIPLE_SHARE).select("triple")


def covered(found: DataFrame, df: DataFrame, text_col: str) -> DataFrame:
    """``found`` with coverage: the share of its characters that, as part of a
    letter triple, are in the dictionary."""
    known = F.broadcast(stage(dictionary(df, text_col), "secret-dictionary"))  # at most 26 ** 3 rows
    share = (found.select("value").distinct()
             .select("value", F.explode(triples(F.col("value"))).alias("triple"))
             .join(known, "triple").groupBy("value").agg(F.count(F.lit(1)).alias("hits")))
    return found.join(share, "value", "left").withColumn("coverage", F.least(F.lit(1.0), F.coalesce(
        "hits", F.lit(0)) / F.greatest(F.length("value") - 2, F.lit(1)))).drop("hits")


def with_features(found: DataFrame) -> DataFrame:
    v, before, after = F.col("value"), F.lower("before"), F.lower("after")
    n = F.length(v)
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(
        v, "[a-z]+", "\u0001"), "[A-Z]+", "\u0002"), "[0-9]+", "\u0003"), "[+/_-]+", "\u0004")
    left = lambda pattern: n - F.length(F.regexp_replace(v, pattern, ""))
    flag = lambda c: c.cast("double")
    placed, login = F.col("kind") != RUN_KIND, F.col("kind") == LOGIN_KIND
    changes = F.length(kinds) - 1
    return found.withColumns({
        "length": n.cast("double"), "changes": changes.cast("double"), "change_rate": changes / n,
        "digit_share": left("[0-9]") / n, "upper_share": left("[A-Z]") / n,
        "distinct_share": F.size(F.array_distinct(F.split(v, ""))) / n,
        "hex": flag(v.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "path": flag(~login & (before.rlike(r"[/.\\]$|://\S*$") | after.rlike(r"^[.][a-z]")
                                | v.rlike("/.*/"))),
        "mail": flag(~login & (before.rlike(r"@\S*$") | after.rlike(r"^\S*@"))),
        "assigned": flag(placed | before.rlike(r"[=:]\s*[\"']?$")),
        "quoted": flag(before.rlike("[\"'`]$") & after.rlike("^=*[\"'`]")),
        "secret_name": flag(placed | before.rlike(SECRET_NAMES + r"\W{0,8}$")),
        "other_name": flag(before.rlike(r"\b" + OTHER_NAMES + r"\W{0,8}$"))})


def rule_labels() -> Column:
    """1 secret, 0 none, null where rules can't tell."""
    f = F.col
    return (F.when(f("value").rlike(PLACEHOLDER) | (f("mail") == 1) | (f("other_name") == 1)
                   | (f("value").rlike("^[A-Z]?[a-z]+$") & (f("coverage") >= 0.8))
                   | ((f("path") == 1) & (f("secret_name") == 0)), 0)
            .when(f("value").rlike(PROVIDERS), 1)
            .when((f("secret_name") == 1) & (f("assigned") == 1), 1))


def draw(rows: DataFrame, by_label: dict[int, int], max_rows: int) -> DataFrame:
    """Labelled ``rows`` to learn from, drawn by hash, and their weight: all of the
    rarer label up to half of about ``max_rows``, the rest of the other. Either
    label has a row at least, and both the same weight in sum."""
    rare, other = sorted(by_label, key=by_label.get)
    few = min(by_label[rare], max(1, max_rows // 2))
    share = {rare: few / by_label[rare], other: min(1.0, max(1, max_rows - few) / by_label[other])}
    place = F.pmod(F.xxhash64("doc_id", "start"), F.lit(1 << 30))
    while True:
        sample = rows.filter(F.when(F.col("label") == rare, place < int(share[rare] * (1 << 30)))
                             .when(F.col("label") == other, place < int(share[other] * (1 << 30))))
        drawn = {r.label: r.n for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        missing = [x for x in share if not drawn.get(x)]
        if not missing:
            break
        for x in missing:                                 # at a share of 1 all rows are drawn
            share[x] = min(1.0, share[x] * 2)
    return sample.withColumn("weight", F.when(F.col("label") == 1, 1 / drawn[1]).otherwise(
        1 / drawn[0]) * sum(drawn.values()))


def scan(df: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id",
         text_col: str = "text", threshold: float = 0.5,
         max_rows: int = 50_000, trees: int = 40) -> DataFrame:
    """doc_id, start, end, value_sha256, label, score, is_secret of every candidate.

    ``findings`` (doc_id, start, label 0 or 1): labels that replace the rules'.
    The forest learns from about ``max_rows`` labelled candidates drawn by hash,
    the rarer label first. With one label or none, the score is that label, or 0.5.
    Null and empty texts have no candidates; repeated rows repeat theirs;
    columns besides the two named are not read."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    found = stage(candidates(df, id_col, text_col), "secret-candidates")
    rows = with_features(covered(found, df, text_col))
    if findings is None:
        rows = rows.withColumn("label", rule_labels())
    else:
        given = findings.groupBy("doc_id", "start").agg(F.max("label").cast("int").alias("label"))
        rows = rows.join(given, ["doc_id", "start"], "left")
    rows = stage(rows.select("doc_id", "start", "end", "value", "label", *FEATURES), "secret-features")
    by_label = {r.label: r.n for r in rows.filter("label is not null").groupBy("label")
                .agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(by_label) < 2:
        only = float(next(iter(by_label), 0.5))
        scored = rows.withColumn("score", F.lit(only))
    else:
        # about max_rows rows in one order, so that the forest is the same every time
        sample = draw(rows, by_label, max_rows).coalesce(1).sortWithinPartitions(
            "doc_id", "start", "value")
        assemble = VectorAssembler(inputCols=FEATURES, outputCol="x")
        model = RandomForestClassifier(featuresCol="x", labelCol="label", weightCol="weight",
                                       numTrees=trees, maxDepth=6, seed=7).fit(assemble.transform(sample))
        scored = model.transform(assemble.transform(rows)).withColumn(
            "score", vector_to_array("probability")[1])
    return scored.select("doc_id", "start", "end", F.sha2("value", 256).alias("value_sha256"),
                         "label", F.round("score", 6).alias("score"),
                         (F.col("score") >= threshold).alias("is_secret"))
