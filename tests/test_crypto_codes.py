import hashlib
import string

import pytest
from pyspark.sql import functions as F

from cloakframe.functions import fixed_values as fixed, strength
from cloakframe.operators import codes, crypto

ROUNDS = 1000


def test_layout_and_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "hello"), (2, ""), (3, None), (4, "é" * 1000)],
                               "id int, v string")
    path = str(tmp_path / "blobs")
    crypto.encrypt(df, "v", "pw", n_salts=3, rounds=ROUNDS).write.parquet(path)
    blobs = spark.read.parquet(path)
    assert {r.id: None if r.v is None else len(r.v) for r in blobs.collect()} == {
        1: 49, 2: 44, 3: None, 4: 2044
    }
    for few in (None, False):
        plain = crypto.decrypt(blobs, "v", "pw", rounds=ROUNDS, few_salts=few)
        got = {r.id: None if r.v is None else bytes(r.v).decode() for r in plain.collect()}
        assert got == {1: "hello", 2: "", 3: None, 4: "é" * 1000}
    wrong = crypto.decrypt(blobs, "v", "no", rounds=ROUNDS)
    assert tuple(crypto.encryption_stats(wrong, "v").first()) == (0, 4)


def test_changed_and_short_blobs_fail(spark, tmp_path):
    salt = bytes(range(16))
    df = spark.createDataFrame([(i, f"value {i}") for i in range(4)], "id int, v string")
    path = str(tmp_path / "blobs")
    crypto.encrypt(df, "v", "pw", salt=salt, rounds=ROUNDS).write.parquet(path)
    harmed = spark.read.parquet(path).withColumn("v", F.expr(
        "case id when 0 then substr(v, 1, 43) when 1 then concat(v, X'00') "
        "when 2 then concat(substr(v, 1, 20), X'ffff', substr(v, 23)) else v end"
    ))
    plain = crypto.decrypt(harmed, "v", "pw", salt=salt, rounds=ROUNDS)
    assert {r.id for r in plain.filter("v is not null").collect()} == {3}


def test_more_salts_than_before(spark):
    df = spark.range(20).select("id", F.col("id").cast("string").alias("v"))
    made = crypto.encrypt(df, "v", "pw", n_salts=1500, rounds=1)
    assert made.filter("length(v) > 44").count() == 20


def test_keys(spark):
    salts = [bytes([i] * 16) for i in range(3)]
    df = spark.createDataFrame([(bytearray(s),) for s in salts], "s binary")
    rows = crypto.derive_keys(df, "s", "päss", ROUNDS).collect()
    assert {bytes(r.salt): bytes(r.key) for r in rows} == {
        s: hashlib.pbkdf2_hmac("sha256", "päss".encode(), s, ROUNDS, 32) for s in salts
    }
    assert fixed.KDF_ROUNDS == 600_000


def test_plans_do_not_show_keys(spark):
    df = spark.createDataFrame([("x",)], "v string")
    salt = bytes(16)
    plan = crypto.encrypt(df, "v", "pw", salt=salt, rounds=ROUNDS)
    text = plan._jdf.queryExecution().toString().lower()
    assert crypto.derive_key("pw", salt, ROUNDS).hex() not in text
    with pytest.raises(ValueError):
        crypto.encrypt(df, "v", "pw", n_salts=0)
    with pytest.raises(ValueError):
        crypto.encrypt(df, "v", "pw", salt=b"short")


@pytest.mark.parametrize("sets,n", [
    ({}, 20), ({"use_symbols": False, "exclude_ambiguous": True}, 4), ({"use_upper": False}, 3),
])
def test_codes(spark, sets, n):
    made = codes.issue_codes(spark.range(200), length=n, **sets).collect()
    pools = codes.code_sets(**sets)
    for row in made:
        assert len(row.code) == n and set(row.code) <= set("".join(pools))
        if n >= 4:
            assert all(set(row.code) & set(p) for p in pools)
    assert len({r.code for r in made}) > 150


def test_other_codes(spark):
    words = spark.createDataFrame([("alpha",), ("beta",), ("gamma",)], "w string")
    rows = codes.issue_passphrases(spark.range(20), words, "w", 3, "_", True).collect()
    assert all(set(r.passphrase.split("_")) <= {"Alpha", "Beta", "Gamma"} for r in rows)
    assert all(len(r.passphrase.split("_")) == 3 for r in rows)
    pins = codes.issue_pins(spark.range(50), 5).collect()
    assert all(len(r.pin) == 5 and set(r.pin) <= set(string.digits) for r in pins)
    custom = codes.issue_codes(spark.range(9), length=6, custom="wxyz").collect()
    assert all(set(r.code) <= set("wxyz") for r in custom)
    for call in (lambda: codes.issue_passphrases(spark.range(1), words, "w", 1),
                 lambda: codes.issue_pins(spark.range(1), 0),
                 lambda: codes.issue_codes(spark.range(1), length=0),
                 lambda: codes.code_sets(False, False, False, False)):
        with pytest.raises(ValueError):
            call()


def test_entropy(spark):
    rows = [("passphrase", 0, 5, True, True, True, True, False),
            ("pin", 6, 0, True, True, True, True, False),
            ("random", 16, 0, True, True, True, True, False),
            ("random", 16, 0, True, True, True, True, True),
            ("random", 8, 0, False, False, False, False, True)]
    names = ["mode", "length", "words", "u", "l", "d", "s", "x"]
    df = spark.createDataFrame(rows, names)
    bits = strength.entropy_bits(*[F.col(c) for c in names])
    got = [(round(r[0], 1), r[1]) for r in
           df.select(bits, strength.strength_rating(bits)).collect()]
    assert got == [(47.5, "Fair"), (19.9, "Weak"), (103.4, "Excellent"), (100.9, "Excellent"),
                   (0.0, "Weak")]


def test_codes_are_even(spark):
    made = codes.issue_codes(spark.range(6000), length=4, use_upper=False, use_symbols=False)
    first = made.groupBy(F.substring("code", 1, 1).alias("c")).count().collect()
    digits = sum(r["count"] for r in first if r.c.isdigit())
    # One lower-case letter, one digit and two of 36 characters, in random order.
    assert abs(digits / 6000 - (1 + 2 * 10 / 36) / 4) < 0.03
    pins = codes.issue_pins(spark.range(5000), 1).groupBy("pin").count().collect()
    assert len(pins) == 10 and all(380 < r["count"] < 620 for r in pins)


def test_empty_input(spark):
    assert codes.issue_codes(spark.range(0)).count() == 0
    assert codes.issue_pins(spark.range(0)).collect() == []
