import random
import re

import pytest

from cloakframe.operators import redact as red


def _expected(text, terms, patterns, fill):
    out = []
    for line in text.split("\n"):
        covered = set()
        for t in terms:
            for m in re.finditer(re.escape(t), line, re.IGNORECASE):
                covered.update(range(*m.span()))
        for p in patterns:
            for m in re.finditer(p, line):
                covered.update(range(*m.span()))
        out.append("".join(fill if i in covered else c for i, c in enumerate(line)))
    return "\n".join(out)


@pytest.mark.parametrize("fill", ["█", ""])
def test_overlaps_equal_brute_force(spark, fill):
    rng = random.Random(2)
    texts = ["".join(rng.choices(list("abAB c1é\n"), k=60)) for _ in range(300)]
    terms, patterns = ["ab", "bA", "c1"], [r"[ab]{2,}", r"\d", r"\bé"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(4)
    for row in red.redact(df, "text", terms, patterns, fill=fill).collect():
        assert row.text == _expected(texts[row.id], terms, patterns, fill)


def test_very_many_hits(spark):
    text = "ab " * 2000
    df = spark.createDataFrame([(text,)], "text string")
    assert red.redact(df, "text", ["ab"]).first().text == "██ " * 2000


def test_pages_counts_and_preview(spark):
    rows = [(1, 1, "say hello hello"), (1, 2, "HELLO\nx"), (2, 1, "none"), (2, 7, "hello")]
    df = spark.createDataFrame(rows, "id int, page int, text string")
    kept = red.redact(df, "text", ["hello"], page="page", pages=[1, 2, 99]).collect()
    assert [r.text for r in kept] == ["say █████ █████", "█████\nx", "none", "hello"]
    stats = red.redact_stats(df, "text", ["hello"], [r"h\w+"], "page", [1, 2, 99]).first()
    assert tuple(stats) == (3, 2, 5)
    long = "x" * 50
    df = spark.createDataFrame([(1, f"a {long} b")], "id int, text string")
    row = red.redact_preview(df, "text", patterns=["x+"], keep=["id"]).first()
    assert tuple(row) == (1, 1, "x+", 3, "x" * 40 + "...")


def test_whole_lines(spark):
    df = spark.createDataFrame([("a1\nbb\nc2",)], "text string")
    assert red.redact(df, "text", patterns=[r"\d"], granularity="line").first().text == "██\nbb\n██"


def test_bad_arguments(spark):
    df = spark.createDataFrame([("a",)], "text string")
    for kwargs in ({}, {"terms": [""]}, {"terms": ["a\nb"]}, {"patterns": ["x*"]},
                   {"terms": ["a"], "fill": "ab"}, {"terms": ["a"], "granularity": "word"}):
        with pytest.raises(ValueError):
            red.redact(df, "text", **kwargs)
    with pytest.raises(re.error):
        red.redact(df, "text", patterns=["("])
