import hashlib
import random
import re

import pytest

from cloakframe.functions import fixed_values as fixed
from cloakframe.functions.patterns import SECRETS, choose
from cloakframe.operators import sanitize as san

I = re.IGNORECASE  # noqa: E741
RULES = [
    ("JWT", fixed.JWT, 0, "JWT"), ("AWS_KEY", fixed.AWS_KEY, 0, "AWS_KEY"),
    ("BEARER_TOKEN", fixed.BEARER_TOKEN, 0, "BEARER"),
    ("BASIC_AUTH", fixed.BASIC_AUTH, 0, "BASIC_AUTH"), ("API_KEY", fixed.API_KEY, I, "API_KEY"),
    ("PRIVATE_KEY", fixed.PRIVATE_KEY, 0, "PRIVATE_KEY"),
    ("CONNECTION_STRING", fixed.CONNECTION_STRING, I, "CONNECTION_STRING"),
    ("IPV4", fixed.IPV4, 0, "IP"), ("IPV6", fixed.IPV6, 0, "IPV6"),
    ("EMAIL", fixed.PLAIN_EMAIL, 0, "EMAIL"), ("SESSION_ID", fixed.SESSION_ID, I, "SESSION"),
    ("SET_COOKIE", fixed.SET_COOKIE, 0, "COOKIE"), ("HEX_TOKEN", fixed.HEX_TOKEN, 0, "TOKEN"),
]


def _expected(line, optional=False):
    notes = []
    for name, pattern, flags, prefix in RULES:
        if not optional and name in fixed.OPTIONAL_SECRETS:
            continue

        def swap(m, name=name, prefix=prefix):
            mark = f"[{prefix}_{hashlib.md5(m.group(0).encode()).hexdigest()[:8]}]"
            notes.append((name, len(m.group(0)), mark))
            return mark

        line = re.sub(pattern, swap, line, flags=flags)
    return line, notes


FIXTURES = [
    ("GET / 10.0.0.1 a@b.co", "GET / [IP_190dafab] [EMAIL_b33a54a5]"),
    ("key AKIA" + "A1" * 8 + " AKIA" + "A1" * 8, "key [AWS_KEY_a0acb0d9] [AWS_KEY_a0acb0d9]"),
    ("Authorization: Bearer " + "x" * 24, "Authorization: [BEARER_6d3d001d]"),
    ("Authorization: Basic dXNlcjpwYXNz", "Authorization: [BASIC_AUTH_13f48871]"),
    ("basic authentication failed", "[BASIC_AUTH_8a714e7c] failed"),
    ("API_KEY = 'abcdefghijklmnop12'", "[API_KEY_8ac93ea9]"),
    ("postgres://u:p@10.1.2.3:5432/db x", "[CONNECTION_STRING_a77da9f6] x"),
    ("mysql+pymysql://root:pw@h/db?email=x@y.com", "[CONNECTION_STRING_bc9088bf]"),
    ("Set-Cookie: sid=abcdefghijklmnopqr; Path=/", "[COOKIE_f5e227d1]"),
    ("session_id=abcdefghijklmnopqr", "[SESSION_7058f835]"),
    ("-----BEGIN RSA PRIVATE KEY-----abc-----END RSA PRIVATE KEY-----", "[PRIVATE_KEY_748958bd]"),
    ("éa@b.co", "éa@b.co"), ("addr fe80:: ::1", "addr fe80:: ::1"), ("", ""),
    ("no match", "no match"),
]
PARTS = [
    "eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + "." + "c" * 12, "AKIA" + "Z9" * 8, "Bearer ", "x" * 24,
    "Basic ", "dXNlcjpwYXNz", "api_key", "APİ-KEY", "apı_key", "ſecret_key", "acceſſ_token", "=",
    ": ", "'", '"', "k" * 16, "session-id", "JSESSIONID", "redis://", "10.1.2.3:6379", "1.2.3.4",
    "2001:db8:0:0:0:0:0:1", "1::", "a@b.co", "Set-Cookie:", " ", "é", " ", "\x01", "f" * 32,
    "-----BEGIN PRIVATE KEY-----", "-----END PRIVATE KEY-----", "[IP_190dafab]", "\x1c", "٣.٣.٣.٣",
]


def _random_lines(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randint(1, 8))) for _ in range(n)]


def test_fixtures(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(FIXTURES)], "id int, line string")
    rows = san.sanitize(df, "line").orderBy("id").collect()
    assert [r.line for r in rows] == [b for _, b in FIXTURES]


@pytest.mark.parametrize("types", [None, "all"])
def test_random_lines_with_notes(spark, types):
    lines = _random_lines(1500, 5)
    df = spark.createDataFrame(list(enumerate(lines)), "id int, line string").coalesce(8)
    for row in san.sanitize_noted(df, "line", types).collect():
        new, notes = _expected(lines[row.id], types == "all")
        assert row.line == new, lines[row.id]
        assert [tuple(r) for r in row.replacements] == notes


def test_whole_texts_equal_their_lines(spark):
    lines = _random_lines(900, 6)
    texts = ["\n".join(lines[i : i + 6]) for i in range(0, 900, 6)] + ["", "\n", "a\n\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(4)
    for row in san.sanitize(df, "text", "all").collect():
        expected = [_expected(line, True)[0] for line in texts[row.id].split("\n")]
        assert row.text == "\n".join(expected)


def test_stats_and_preview(spark):
    lines = _random_lines(300, 9)
    texts = ["\n".join(lines[i : i + 5]) for i in range(0, 300, 5)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    notes = {
        (i, n): _expected(line, True)[1]
        for i, t in enumerate(texts) for n, line in enumerate(t.split("\n"), 1)
    }
    row = san.sanitize_stats(df, "text", "all").first()
    counts = {}
    for name, _, _ in (x for ns in notes.values() for x in ns):
        counts[name] = counts.get(name, 0) + 1
    assert row.total_lines == 300 and row.type_counts == counts
    assert row.lines_modified == sum(1 for ns in notes.values() if ns)
    assert row.total_replacements == sum(counts.values())
    seen = san.sanitize_preview(df, "text", ["id"], "all").collect()
    expected = [
        (*k, s, *x) for k, ns in notes.items() for s, x in enumerate(ns, 1)
    ]
    assert sorted(tuple(r) for r in seen) == sorted(expected)


def test_sanitizing_again_changes_nothing(spark):
    df = spark.createDataFrame([(a,) for a, _ in FIXTURES], "line string")
    once = san.sanitize(df, "line")
    assert san.sanitize(once, "line").collect() == once.collect()


def test_documents_golden(spark, medium):
    df = spark.read.parquet(f"{medium}/documents.parquet")
    row = san.sanitize_stats(df, "text").first()
    assert (row.total_lines, row.lines_modified) == (9344, 37)
    assert row.type_counts == {"IPV4": 32, "EMAIL": 12}
    row = san.sanitize_stats(df, "text", "all").first()
    assert row.lines_modified == 47 and row.type_counts["HEX_TOKEN"] == 13


def test_key_blocks_over_lines(spark):
    body = "x\n-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----\ny"
    df = spark.createDataFrame([(body,)], "text string")
    assert san.sanitize(df, "text").first().text == body
    clean = san.sanitize(df, "text", mode="document").first().text
    assert re.fullmatch(r"x\n\[PRIVATE_KEY_[0-9a-f]{8}\]\ny", clean)
    with pytest.raises(ValueError):
        san.sanitize(df, "text", mode="page")


def test_keyed_placeholders_differ(spark):
    df = spark.createDataFrame([("10.0.0.1",)], "line string")
    plain, keyed = (san.sanitize(df, "line", key=k).first().line for k in ("", "it's secret"))
    inner = hashlib.sha256("it's secret10.0.0.1".encode()).hexdigest()
    wanted = hashlib.sha256(f"it's secret{inner}".encode()).hexdigest()[:8]
    assert keyed == f"[IP_{wanted}]" != plain


def test_only_changed_rows_are_written(spark, tmp_path):
    from cloakframe.sources.tables import write_sanitized

    df = spark.createDataFrame([(1, "a@b.co"), (2, "clean")], "id int, text string")
    write_sanitized(df, "text", str(tmp_path / "out"))
    assert [r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [1]


def test_names_and_prefixes():
    assert [p.name for p in choose(SECRETS, "ip,cookie,bearer")] == [
        "BEARER_TOKEN", "IPV4", "SET_COOKIE"
    ]
    assert {p.name for p in choose(SECRETS, None)} == {
        p.name for p in SECRETS
    } - set(fixed.OPTIONAL_SECRETS)
