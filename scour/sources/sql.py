"""A source given as SQL text with named parameters."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession


def parametrised(spark: SparkSession, text: str, tables: dict[str, DataFrame],
                 args: dict[str, Any] | None = None) -> DataFrame:
    """The result of ``text`` in Spark SQL.

    ``{name}`` stands for a table of ``tables``: a view that Spark makes for this call
    alone and drops after it, so calls at the same time don't see each other's.
    ``:name`` stands for a value of ``args``, which is bound as a literal and never
    becomes part of the text."""
    return spark.sql(text, args or {}, **tables)


#: A page of accepted pairs, in question id order.
PAIRS_PAGE = """
SELECT page.id AS question_id, page.title AS question_title, page.body AS question_body,
       page.accepted_answer_id, reply.body AS accepted_answer_body
FROM (FROM {questions} SELECT id, title, body, accepted_answer_id WHERE accepted_answer_id IS NOT NULL
      ORDER BY id LIMIT :page_rows OFFSET :skipped) page
LEFT JOIN {answers} reply ON reply.id = page.accepted_answer_id
"""


def pairs_page(questions: DataFrame, answers: DataFrame, number_of_records: int = 100,
               offset: int | None = None) -> DataFrame:
    """``sources.qa.source_page`` as parametrised SQL."""
    return parametrised(questions.sparkSession, PAIRS_PAGE, {"questions": questions, "answers": answers},
                        {"page_rows": int(number_of_records), "skipped": int(offset or 0)})
