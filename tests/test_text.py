"""Scalar text functions: document text, content id, prompt, answer extraction."""

import hashlib

import pytest
from pyspark.sql import functions as F

from scour.functions.text import document_text, content_id, extract_tagged, prompt_text


def test_document_text_and_null_fields(spark):
    df = spark.createDataFrame([("Title5", "Body5", "Answer5"), ("T", None, None)],
                               "t string, b string, a string")
    out = [r[0] for r in df.select(document_text("t", "b", "a")).collect()]
    assert out[0] == "Title: Title5\nBody: Body5\nAccepted Answer: Answer5"
    assert out[1] == "Title: T\nBody: None\nAccepted Answer: None"


def test_content_id_matches_hashlib(spark):
    texts = ["Title: é ü ß ✓", "plain", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(content_id("t")).collect()]
    assert got == [hashlib.sha256(t.encode()).hexdigest() for t in texts]


def test_prompt_golden_five_matches(spark):
    df = spark.createDataFrame([("Sample query text", [f"Sample text{i}" for i in range(5)])],
                               "q string, m array<string>")
    got = df.select(prompt_text(F.col("q"), F.col("m"))).first()[0]
    expected = ("<user_query>\nSample query text\n</user_query>\n\n"
                + "\n".join(f"\n<match_{i}>\nSample text{i}\n</match_{i}>\n" for i in range(5)) + "\n")
    assert got == expected


@pytest.mark.parametrize("reply, want", [
    ("<markdown>here's the result: `print('foo-bar')`</markdown>", "here's the result: `print('foo-bar')`"),
    ("no tags at all", "no tags at all"),
    ("pre <markdown>a</markdown> mid <markdown>b</markdown> post", "a</markdown> mid <markdown>b"),
    ("</markdown> reversed <markdown>", ""),
    ("<markdown>only open", "<markdown>only open"),
    ("only close</markdown>", "only close</markdown>"),
    ("<markdown>\nmulti\nline\n</markdown>", "\nmulti\nline\n"),
    ("<markdown></markdown>", ""),
    ("x</markdown>y<markdown>z</markdown>w", "z"),
])
def test_extract_between_first_open_and_last_close_tag(spark, reply, want):
    df = spark.createDataFrame([(reply,)], "r string")
    assert df.select(extract_tagged(F.col("r"))).first()[0] == want
