"""Text expressions: document assembly, content ids, prompts, answer extraction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of the document text and the answer-model tags.
TITLE_LABEL = "Title: "
BODY_LABEL = "\nBody: "
ANSWER_LABEL = "\nAccepted Answer: "
NULL_TEXT = "None"
MARKDOWN_OPEN = "<markdown>"
MARKDOWN_CLOSE = "</markdown>"

# Fixed value: the answer model's system prompt (kept byte for byte).
SYSTEM_PROMPT = (
    "\n        You're helping a developer to be more productive. You're given the developer query and a list of answers "
    "\n        found for the question on the internet. Given the most relevant matches, you need to provide a useful answer"
    "\n        to the user. You're answer MUST be a valid markdown. Put the valid markdown inside <markdown> XML tag and keep anything"
    "\n        else, including your thought outside of the XML tag. You're answer should not be very long. Keep it short and consise. "
    "\n        "
)
TEMPERATURE = 0.5


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def document_text(title, body, answer) -> Column:
    """Three labelled fields on three lines; a NULL field prints as None."""
    return F.concat(F.lit(TITLE_LABEL), F.coalesce(_c(title), F.lit(NULL_TEXT)),
                    F.lit(BODY_LABEL), F.coalesce(_c(body), F.lit(NULL_TEXT)),
                    F.lit(ANSWER_LABEL), F.coalesce(_c(answer), F.lit(NULL_TEXT)))


def content_id(text) -> Column:
    """SHA-256 hex of the UTF-8 text."""
    return F.sha2(_c(text), 256)


def match_blocks(texts) -> Column:
    """array<string> in rank order -> newline, <match_i>, text, </match_i>, newline."""
    return F.transform(_c(texts), lambda t, i: F.concat(
        F.lit("\n<match_"), i.cast("string"), F.lit(">\n"), t,
        F.lit("\n</match_"), i.cast("string"), F.lit(">\n")))


def prompt_text(query, texts) -> Column:
    """User-query block, a blank line, then the match blocks joined by newline."""
    return F.concat(F.lit("<user_query>\n"), _c(query), F.lit("\n</user_query>\n\n"),
                    F.array_join(match_blocks(texts), "\n"), F.lit("\n"))


def extract_tagged(result, open_tag: str = MARKDOWN_OPEN, close_tag: str = MARKDOWN_CLOSE) -> Column:
    """Text between the first open tag and the last close tag when both occur,
    else the text unchanged (a close tag before the open tag gives '')."""
    r = _c(result)
    pattern = "(?s)" + _re_escape(open_tag) + "(.*)" + _re_escape(close_tag)
    both = F.instr(r, open_tag) > 0
    both = both & (F.instr(r, close_tag) > 0)
    return F.when(both, F.regexp_extract(r, pattern, 1)).otherwise(r)


def _re_escape(s: str) -> str:
    import re

    return re.escape(s)


def join_parts(content) -> Column:
    """array<struct<text>> response parts joined with newline."""
    return F.array_join(F.transform(_c(content), lambda p: p["text"]), "\n")
