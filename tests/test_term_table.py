"""Redaction by a table of terms equals redaction term by term."""

import random

import pytest
from pyspark.sql import functions as F

from cloakframe.operators import redact as red, term_table


def test_equal_to_single_terms(spark):
    rng = random.Random(3)
    terms = ["ab", "aba", "b c", "É", "漢字", "aaa", "xyz", "😀b", "Ab"]
    texts = ["".join(rng.choice(["a", "b", "A", "B", " ", "c", "é", "É", "漢", "字", "x", "y", "z", "\n", "😀"]) for _ in range(rng.randint(0, 60)))
             for _ in range(400)] + ["", None, "aaaaaaa"]
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(texts)], "id int, text string, start string, found int")
    table = spark.createDataFrame([(t,) for t in terms] + [(None,), ("ab",)], "term string")
    for fill in ("█", ""):
        got = {r.id: r.text for r in term_table.redact_by_table(df, ["id"], "text", table, "term", fill).collect()}
        assert got == {r.id: r.text for r in red.redact(df, "text", terms, fill=fill).collect()}
    hits = term_table.find_terms(df.select("id", "text"), ["id"], "text", table, "term")
    preview = red.redact_preview(df.fillna(""), "text", sorted({t.lower() for t in terms}), keep=["id"])
    assert hits.count() == preview.count()


def test_a_hundred_thousand_terms(spark, monkeypatch):
    terms = spark.range(100_000).select(F.concat(F.lit("t"), F.col("id") * 7).alias("w"))
    df = spark.createDataFrame([(1, "see T14 and t700007 and t3"), (2, "nothing"), (3, "t0" * 500)], "id int, text string")
    for most in (1 << 27, 1 << 12):  # a filter that lets nearly all windows pass changes nothing
        monkeypatch.setattr(term_table, "_MOST_BITS", most)
        monkeypatch.setattr(term_table, "_LEAST_BITS", 1 << 12)
        got = {r.id: r.text for r in term_table.redact_by_table(df, ["id"], "text", terms, "w").collect()}
        assert got[2] == "nothing" and got[3] == "█" * 1000
        assert got[1] == red.redact(df.filter("id = 1"), "text", ["t0", "t7", "t70", "t700", "t14", "t70000", "t7000"]).first().text


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None)], "id int, text string")
    none = spark.createDataFrame([], "term string")
    assert [tuple(r) for r in term_table.redact_by_table(df, ["id"], "text", none, "term").orderBy("id").collect()] == [(1, "abc"), (2, None)]
    one = spark.createDataFrame([("b",)], "term string")
    assert term_table.redact_by_table(df.limit(0), ["id"], "text", one, "term").count() == 0
    for bad in ("", "two\nlines"):
        with pytest.raises(Exception, match="one non-empty line"):
            term_table.redact_by_table(df, ["id"], "text", spark.createDataFrame([(bad,)], "term string"), "term")
