"""Question / accepted-answer source.

``qa_pairs`` is the left outer join of questions to their accepted answers
(questions without an accepted answer id are left out; a dangling id keeps the
question with a NULL answer body). ``source_page`` is one page of it in
question id order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scour.operators.ingest import key_ordinals

#: A page within so many first rows is taken as a top-k.
SHALLOW_ROWS = 10_000


def questions_from_conversations(conv: DataFrame) -> DataFrame:
    """Driver-table binding: user and system turns are posts; a user turn
    claims the next turn as its accepted answer, a system turn has none."""
    pid = F.col("conv_id") * 1000 + F.col("turn")
    return (conv.filter(F.col("role").isin("user", "system"))
            .select(pid.alias("id"),
                    F.substring_index("text", "\n", 1).alias("title"),
                    F.col("text").alias("body"),
                    F.when(F.col("role") == "user", pid + 1).alias("accepted_answer_id")))


def answers_from_conversations(conv: DataFrame) -> DataFrame:
    """Driver-table binding: assistant turns are the answer posts."""
    return (conv.filter(F.col("role") == "assistant")
            .select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
                    F.col("text").alias("body")))


def qa_pairs(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Left join questions with an accepted answer id to the answer bodies."""
    q = (questions.filter(F.col("accepted_answer_id").isNotNull())
         .select(F.col("id").alias("question_id"),
                 F.col("title").alias("question_title"),
                 F.col("body").alias("question_body"),
                 F.col("accepted_answer_id")))
    a = answers.select(F.col("id").alias("_aid"), F.col("body").alias("accepted_answer_body"))
    return (q.join(a, q["accepted_answer_id"] == a["_aid"], "left")
            .select("question_id", "question_title", "question_body",
                    "accepted_answer_id", "accepted_answer_body"))


def source_page(questions: DataFrame, answers: DataFrame, number_of_records: int = 100,
                offset: int | None = None, shallow: int = SHALLOW_ROWS) -> DataFrame:
    """One page of accepted pairs, in question id order (ids are unique).

    A page that ends within the first ``shallow`` rows is a top-k: every task keeps
    that many ids, and no id is shuffled for a sort. For deeper ones the ids alone
    are range-partitioned and numbered (``key_ordinals``), so a deep page is no more
    work for one task; the page's id range is then pushed into the scan of the
    questions. Only the page's rows are joined to the answers."""
    first, many = int(offset or 0), int(number_of_records)
    asked = questions.filter(F.col("accepted_answer_id").isNotNull())
    if first + many <= shallow:
        return qa_pairs(asked.orderBy("id").offset(first).limit(many), answers)
    page = key_ordinals(asked.select(F.col("id").alias("question_id")), "question_id").filter(
        (F.col("rn") >= first) & (F.col("rn") < first + many))
    ends = page.agg(F.min("question_id").alias("lo"), F.max("question_id").alias("hi")).first()
    inside = F.col("id").between(ends["lo"], ends["hi"])
    return qa_pairs(asked.filter(F.coalesce(inside, F.lit(False))), answers)


def page_after(questions: DataFrame, answers: DataFrame, number_of_records: int = 100,
               after: int | None = None) -> tuple[DataFrame, int | None]:
    """(the pairs that follow question id ``after``, the cursor for the next page). The
    cursor is the page's last id, None behind the last page. The filter on the id is
    pushed into the scan and the page is a top-k, so no page costs more for being
    deep, and rows that come in between pages move no other row to a different page."""
    asked = questions.filter(F.col("accepted_answer_id").isNotNull())
    if after is not None:
        asked = asked.filter(F.col("id") > after)
    page = asked.orderBy("id").limit(int(number_of_records))
    last = page.agg(F.max("id")).first()[0]
    return qa_pairs(page, answers), last
