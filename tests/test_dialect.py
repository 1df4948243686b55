"""Expressions mean the same in Spark as in the dialect they are written in."""

import random
import re

from pyspark.sql import functions as F

from cloakframe.functions import fixed_values as fixed
from cloakframe.functions.dialect import java_pattern, quote
from cloakframe.functions.matching import hits, text

ALPHABET = list("ab1_ -.@:'\"[]&\\\t") + [
    "\x1c", "\x85", "\xa0", " ", " ", "é", "é", "ß", "٣", "५", "²", "½", "Ⅷ",
    "日", "𝟗", "ſ", "K", "ı", "İ", "‍", "_", "foo", "12", "::", "sid=", "\r",
]
PATTERNS = [
    r"\bfoo\b", r"\d+", r"\w+", r"\s+", r"\S+", r"[^\s'\"]{2,}", r"[\d.]+", r"\D+", r"\W+",
    r"\b\d", r"\d\b", r"\b[a-z]+\b", r"[[\]&]+", r"\Bo", r"[\w-]+", r"a.b", r"\b::\b", r"[^\w]",
    r"b$", r"'\d?",
]
SECRETS = [
    fixed.SSN, fixed.CREDIT_CARD, fixed.EMAIL, fixed.PHONE, fixed.IPV4, fixed.IPV6,
    fixed.HEX_TOKEN, fixed.SET_COOKIE,
]


def _strings(n, seed=7):
    rng = random.Random(seed)
    return ["".join(rng.choices(ALPHABET, k=rng.randint(0, 14))) for _ in range(n)]


def _all_hits(pattern, flags, value):
    return [m.group(0) for m in re.finditer(pattern, value, flags)]


def test_hits_equal_python(spark):
    strings = _strings(1500)
    df = spark.createDataFrame([(s,) for s in strings], "s string").coalesce(4)
    rows = df.select("s", *[
        F.expr(hits("s", java_pattern(p))).alias(f"p{i}") for i, p in enumerate(PATTERNS)
    ]).collect()
    for row in rows:
        for i, p in enumerate(PATTERNS):
            assert row[f"p{i}"] == _all_hits(p, 0, row.s), (p, row.s)


def test_ignoring_case_equals_python(spark):
    strings = _strings(800, seed=8) + ["ſession_id", "APİ_KEY", "apı-key", "SID", "Kk"]
    df = spark.createDataFrame([(s,) for s in strings], "s string").coalesce(4)
    patterns = [r"sid", r"api[_-]?key", r"[A-Za-z]+", r"k+", r"ss"]
    rows = df.select("s", *[
        F.expr(hits("s", java_pattern(p, ignore_case=True))).alias(f"p{i}")
        for i, p in enumerate(patterns)
    ]).collect()
    for row in rows:
        for i, p in enumerate(patterns):
            assert row[f"p{i}"] == _all_hits(p, re.IGNORECASE, row.s), (p, row.s)


def test_whole_text_finds_what_lines_hold(spark):
    rng = random.Random(3)
    parts = [
        "1.2.3.4", "123-45-6789", "+1 (743) 555-3824", "a@b.co", "4111 1111 1111 1111", "\n",
        "\n", " ", "-", "x", "12", "Set-Cookie: a", "f" * 32, "1::", "é",
    ]
    texts = ["".join(rng.choices(parts, k=12)) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(4)
    whole = [p for p in SECRETS if p is not fixed.SET_COOKIE]
    rows = df.select("t", *[
        F.expr(hits("t", java_pattern(p, within_lines=True))).alias(f"p{i}")
        for i, p in enumerate(whole)
    ]).collect()
    for row in rows:
        for i, p in enumerate(whole):
            expected = [h for line in row.t.split("\n") for h in _all_hits(p, 0, line)]
            assert row[f"p{i}"] == expected, (p, row.t)


def test_literals(spark):
    for value in ["a'b\\d", "\\\\", "it's", "x", "\\'", "é\U0010FFFF", ""]:
        assert spark.range(1).select(F.expr(text(value))).first()[0] == value


def test_quote():
    for term in ["a.b*c", "[x]{1}", "1+1=2?", "a|b^$", "back\\slash", "#& -~"]:
        assert re.fullmatch(quote(term), term)
