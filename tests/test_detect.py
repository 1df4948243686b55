import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from cloakframe.functions import fixed_values as fixed
from cloakframe.functions.patterns import DETECTORS, SECRETS, Pattern, choose, register_pattern
from cloakframe.operators import detect, sanitize

KINDS = {
    "SSN": fixed.SSN, "CREDIT_CARD": fixed.CREDIT_CARD, "EMAIL": fixed.EMAIL,
    "PHONE": fixed.PHONE, "IP_ADDRESS": fixed.IPV4,
}


def _luhn(number):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(number))]
    return sum(n - 9 * (n > 9) for n in doubled) % 10 == 0


def _valid(kind, value):
    numbers = "".join(str(unicodedata.digit(c)) for c in value if c.isdecimal())
    if kind == "CREDIT_CARD":
        return 13 <= len(numbers) <= 19 and _luhn(numbers)
    if kind == "SSN":
        return (
            len(value.replace("-", "").replace(" ", "")) == 9
            and numbers[:3] not in ("000", "666") and numbers[0] != "9"
            and numbers[3:5] != "00" and numbers[5:] != "0000"
        )
    if kind == "PHONE":
        return 10 <= len(numbers) <= 15
    if kind == "IP_ADDRESS":
        return all(int(part) <= 255 for part in value.split("."))
    return True


def _expected(key, body):
    rows = []
    for n, line in enumerate(body.split("\n"), 1):
        for kind, pattern in KINDS.items():
            for m in re.finditer(pattern, line):
                if _valid(kind, m.group(0)):
                    around = line[max(0, m.start() - 20) : m.end() + 20].strip()
                    rows.append((key, kind, m.group(0), n, m.start() + 1, around))
    return rows


def _found(spark, bodies):
    df = spark.createDataFrame(list(enumerate(bodies)), "id bigint, text string")
    rows = detect.scan_text(df, "text").collect()
    return sorted((r.id, r.type, r.value, r.line, r.column, r.context) for r in rows)


HAND_MADE = [
    "123-45-6789", "123 45 6789", "123456789", "000-12-3456", "666-12-3456", "900-12-3456",
    "123-00-4567", "123-45-0000", "123\t45\t6789", "4111 1111 1111 1111", "4111111111111111",
    "4111 1111 1111 1112", "3782 822463 10005", "999.1.1.1", "1.2.3.4", "+1 (743) 555-3824",
    "7435553824 7435553825", "743-555-3824-743-555-3825", "é123-45-6789", "é123-45-6789",
    "١٢٣-٤٥-٦٧٨٩", "١.٢.٣.٤", "a@b.co", "ab@c.de", "x@y@z.org", ".a@b.co", "", "\n\n", "a\x01b 1.2.3.4",
    "日本1.2.3.4日本", "𝟙𝟚𝟛.1.1.1 𐐷 9.9.9.9", "first 1.1.1.1\nsecond a@b.co 2.2.2.2\n",
    "tab  8.8.8.8  ",
]


def test_hand_made_lines(spark):
    expected = [row for i, b in enumerate(HAND_MADE) for row in _expected(i, b)]
    assert _found(spark, HAND_MADE) == sorted(expected)


def test_random_lines(spark):
    rng = random.Random(11)
    parts = ["123-45-6789", "4111 1111 1111 1111", "743-555-3824", "10.0.0.1", "a.b@c.org", " ",
             "-", ".", "x", "é", "1", "\n", "(", ")", "+1", " ", "ß"]
    bodies = ["".join(rng.choices(parts, k=rng.randint(1, 25))) for _ in range(800)]
    expected = [row for i, b in enumerate(bodies) for row in _expected(i, b)]
    assert _found(spark, bodies) == sorted(expected)


def test_line_with_very_many_hits(spark):
    body = "é " + " ".join(f"10.{i % 256}.0.{i % 7}" for i in range(3000)) + " end"
    assert _found(spark, [body]) == sorted(_expected(0, body))


def test_documents(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    docs = df.select("doc_id", "text").collect()
    expected = sorted(row for d in docs for row in _expected(d.doc_id, d.text))
    rows = detect.scan_text(df.select("doc_id", "text"), "text").collect()
    assert sorted((r.doc_id, r.type, r.value, r.line, r.column, r.context) for r in rows) == expected
    assert {r.description for r in rows if r.type == "EMAIL"} == {"Email Address"}


def test_golden_counts(spark, medium):
    df = spark.read.parquet(f"{medium}/documents.parquet")
    row = detect.scan_summary(df, "text").first()
    assert (row.rows_scanned, row.rows_with_hits, row.total_findings) == (1000, 50, 87)
    assert row.types_found == {"CREDIT_CARD": 23, "EMAIL": 12, "PHONE": 20, "IP_ADDRESS": 32}


def test_summary_equals_findings_on_odd_texts(spark):
    df = spark.createDataFrame(list(enumerate(HAND_MADE)), "id bigint, text string")
    by_type = {r.type: r.n for r in detect.count_by_type(detect.scan_text(df, "text")).collect()}
    assert detect.scan_summary(df, "text").first().types_found == by_type


@pytest.mark.parametrize("kind,value,masked", [
    ("SSN", "123-45-6789", "***-**-6789"), ("CREDIT_CARD", "4111 1111 1111 1234", "****-****-****-1234"),
    ("EMAIL", "a@b.co", "***@b.co"), ("EMAIL", "ab@c.de", "a***@c.de"), ("EMAIL", "x@y@z", "x@y@z"),
    ("PHONE", "+1 (743) 555-3824", "***-***-3824"), ("PHONE", "12", "12"),
    ("IP_ADDRESS", "1.2.3.4", "1.2.3.4"), ("OTHER", "keep", "keep"),
])
def test_masks(spark, kind, value, masked):
    df = spark.createDataFrame([(kind, value)], "type string, value string")
    assert detect.with_masks(df).first().value_masked == masked


def test_masked_findings_leak_nothing(spark):
    body = "card 4111 1111 1111 1111 mail jo.doe@corp.example tel 743-555-3824"
    df = spark.createDataFrame([(body,)], "text string")
    rows = detect.without_raw_values(detect.scan_text(df, "text")).collect()
    assert {r.type for r in rows} == {"CREDIT_CARD", "EMAIL", "PHONE"}
    for r in rows:
        assert "value" not in r.asDict()
        assert "jo.doe" not in r.context and "4111" not in r.context and "743" not in r.context
        assert r.value_masked in r.context


def test_report_counts_and_order(spark):
    bodies = ["1.1.1.1 a@b.co\n2.2.2.2", "nothing", "3.3.3.3"]
    df = spark.createDataFrame(list(enumerate(bodies)), "id bigint, text string")
    rows = detect.findings_report(detect.scan_text(df, "text"), "id").collect()
    assert [(r.id, r.type, r.instances, r.line, r.column) for r in rows] == [
        (0, "EMAIL", 1, 1, 9), (0, "IP_ADDRESS", 2, 1, 1), (0, "IP_ADDRESS", 2, 2, 1),
        (2, "IP_ADDRESS", 1, 1, 1),
    ]


def test_types_are_checked():
    assert [p.name for p in choose(DETECTORS, "email, SSN")] == ["SSN", "EMAIL"]
    with pytest.raises(ValueError, match="unknown types"):
        choose(DETECTORS, ["email", "passport"])


def test_new_pattern(spark):
    register_pattern(DETECTORS, Pattern(
        "BADGE", r"\bB-\d{4}\b", "Badge", mask=lambda v: F.lit("B-****"), hint_words=("B-",)
    ))
    try:
        df = spark.createDataFrame([("see B-1234, AB-1234",)], "text string")
        rows = detect.with_masks(detect.scan_text(df, "text")).collect()
        assert [(r.type, r.value, r.column, r.value_masked) for r in rows] == [
            ("BADGE", "B-1234", 5, "B-****")
        ]
        with pytest.raises(ValueError):
            register_pattern(DETECTORS, Pattern("BADGE", "x"))
    finally:
        DETECTORS.pop()


def test_new_pattern_bound_to_line_ends(spark):
    for i, (start, end) in enumerate((("^", "$"), (r"\A", r"\Z"))):
        register_pattern(DETECTORS, Pattern(f"PIN{i}", start + r"\d{6}" + end))
    register_pattern(SECRETS, Pattern("PIN", r"^pin \d{4}$", prefix="PIN"))
    try:
        df = spark.createDataFrame([("abc\n123456\nzz 123456\npin 1234\n654321",)], "text string")
        found = detect.scan_text(df, "text", "PIN0,PIN1").collect()
        assert sorted((r.type, r.value, r.line) for r in found) == [
            (t, v, n) for t in ("PIN0", "PIN1") for v, n in (("123456", 2), ("654321", 5))]
        assert tuple(detect.hit_counts(df, "text", "PIN0,PIN1").first()) == (2, 2)
        text = sanitize.sanitize(df, "text").first().text
        assert "pin 1234" not in text and text.count("[PIN_") == 1
        assert sanitize.sanitize_stats(df, "text").first().type_counts == {"PIN": 1}
    finally:
        SECRETS.pop()
        del DETECTORS[-2:]


def test_null_and_empty_texts(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "id bigint, text string")
    assert detect.scan_text(df, "text").count() == 0
    assert detect.scan_summary(df, "text").first().total_findings == 0


def test_report_leaves_no_address_in_scratch(spark, tmp_path, monkeypatch):
    from cloakframe.sources import scratch

    monkeypatch.setattr(scratch, "scratch_folder", lambda spark, purpose: str(tmp_path / purpose))
    df = spark.createDataFrame([("f", "host 10.11.12.13 up"), ("g", "mail jo@b.co")], "file string, text string")
    rows = detect.findings_report(detect.scan_text(df, "text"), "file").collect()
    assert [(r.file, r.value_masked) for r in rows] == [("f", "10.11.12.13"), ("g", "j***@b.co")]
    stored = spark.read.parquet(str(tmp_path / "findings"))
    assert stored.count() == 2 and not any(b"10.11.12" in bytes(r.value_masked) for r in stored.collect())
    assert not any(b"10.11.12" in p.read_bytes() for p in tmp_path.rglob("*") if p.is_file())
