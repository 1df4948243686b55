"""Fakes without collisions, keys outside of plans, numbers without gaps, passphrases from large tables."""

import re

import pytest
from pyspark.sql import functions as F

from cloakframe.functions.keyed import under_key
from cloakframe.functions.pseudonyms import pseudonym
from cloakframe.operators import anonymize as anon, codes, sanitize as san, unique_fakes as unique
from cloakframe.operators.numbering import numbered


@pytest.mark.parametrize("size", [1, 2, 7, 50, 676, 5000])
def test_feistel_is_a_permutation(spark, size):
    n = unique.reach(size)
    assert 0 < n <= size and n >= size - 2 * size**0.5
    rows = spark.range(n).withColumn("k", F.lit("key one"))
    got = [r[0] for r in rows.select(F.expr(unique.feistel("id", size, "k"))).collect()]
    assert sorted(got) == list(range(n))
    if n > 40:
        other = [r[0] for r in rows.withColumn("k", F.lit("key two")).select(F.expr(unique.feistel("id", size, "k"))).collect()]
        assert got != list(range(n)) and got != other


KINDS = {"name": r"[A-Z][a-z]+ [A-Z][a-z]+(-[A-Z][a-z]+)?", "email": r"[a-z.]+\d+@example\.com", "phone": r"\(\d{3}\) \d{3}-\d{4}",
         "ssn": r"9\d\d-\d\d-\d{4}", "address": r"\d+ [A-Z].*", "city": r"[A-Z][a-z]+-[A-Z][a-z]+",
         "company": r"[A-Z][a-z]+ [A-Z][a-z]+ [A-Z][a-z]+", "zip": r"\d{5}", "date_of_birth": r"\d{4}-\d\d-\d\d",
         "ip_address": r"10(\.\d{1,3}){3}", "credit_card": r"4\d{15}"}


def test_distinct_in_distinct_out(spark):
    customers = spark.read.parquet("/root/testdata/sf0.1/customer.parquet").select("c_custkey", "c_name")
    rows = customers.select("c_custkey", *[F.col("c_name").alias(k) for k in KINDS])
    made = unique.anonymize_uniquely(rows, {k: k for k in KINDS}, "a key").collect()
    assert len(made) == 15000
    for kind, pattern in KINDS.items():
        values = [r[kind] for r in made]
        assert len(set(values)) == 15000, kind
        assert all(re.fullmatch(pattern, v) for v in values), (kind, values[0])


def test_equal_values_and_blanks(spark):
    rows = [(1, "Ann"), (2, " ann "), (3, "Bob"), (4, None), (5, "  "), *[(i, "Ann") for i in range(10, 400)]]
    df = spark.createDataFrame(rows, "id int, who string")
    once, again, other = ({r.id: r.who for r in unique.anonymize_uniquely(df, {"who": "name"}, k).collect()} for k in ("k", "k", "x"))
    assert once == again and once != other and len(once) == len(rows)
    assert once[1] == once[2] == once[10] != once[3] and once[4] is None and once[5] == "  "
    assert unique.anonymize_uniquely(df.limit(0), {"who": "name"}).count() == 0


def test_domains_end_or_grow(spark):
    with pytest.raises(ValueError, match="only 49 fakes"):
        unique.domain("state", 51)
    with pytest.raises(ValueError, match="no domain"):
        unique.domain("shoe", 1)
    for kind, count in (("name", 10**9), ("city", 10**9), ("email", 10**12), ("company", 10**8), ("address", 10**9), ("zip", 10**8),
                        ("phone", 10**9), ("credit_card", 10**13)):
        made = unique.domain(kind, count)
        assert unique.reach(made.size) >= count
        ends = spark.createDataFrame([(0,), (1,), (made.size - 1,), (made.size - 2,)], "x bigint")
        values = [r[0] for r in ends.select(F.expr(made.fake("x"))).collect()]
        assert len(set(values)) == 4 and None not in values, (kind, values)


def test_keys_are_in_no_plan(spark, tmp_path):
    key = "zq-unguessable-17"
    df = spark.createDataFrame([(1, "10.0.0.1 by jo@b.co", "Ann")], "id int, line string, who string")
    plans = [
        san.sanitize(df, "line", key=key), san.sanitize_changed(df, "line", key=key), san.sanitize_noted(df, "line", key=key),
        san.sanitize_pieces(df, "line", key=key), anon.anonymize(df, {"who": "name"}, key),
        anon.anonymize_preview(df, {"who": "name"}, ["id"], key=key), unique.anonymize_uniquely(df, {"who": "name"}, key),
        under_key(df, key, lambda rows, k: rows.withColumn("who", pseudonym("who", "email", k)))]
    for plan in plans:
        before = plan._jdf.queryExecution().toString()
        assert "_secret_key" not in plan.columns and plan.collect()
        assert key not in before and key not in plan._jdf.queryExecution().toString()
    stream = spark.readStream.schema(df.schema).parquet(_written(df, tmp_path / "in"))
    query = san.sanitize(stream, "line", key=key).writeStream.format("memory").queryName("keyed").trigger(
        availableNow=True).start()
    query.awaitTermination()
    assert spark.table("keyed").first().line == san.sanitize(df, "line", key=key).first().line


def _written(df, path):
    df.write.parquet(str(path))
    return str(path)


def test_numbers_have_no_gaps(spark):
    df = spark.range(10000).repartition(13).filter("id % 7 != 3")
    n = df.count()
    assert sorted(r.number for r in numbered(df).collect()) == list(range(n))
    ordered = numbered(df, "place", [F.desc("id")]).orderBy("place").collect()
    assert [r.place for r in ordered] == list(range(n)) and [r.id for r in ordered] == sorted((r.id for r in ordered), reverse=True)
    assert numbered(df.limit(0)).count() == 0


def test_passphrases_from_a_million_words(spark):
    words = spark.range(1_000_000).select(F.concat(F.lit("w"), F.col("id")).alias("w"))
    made = codes.issue_passphrases(spark.range(300).withColumn("extra", F.create_map(F.lit("a"), F.lit(1))), words, "w", 4, " ")
    rows = made.collect()
    assert made.columns == ["id", "extra", "passphrase"] and sorted(r.id for r in rows) == list(range(300))
    drawn = [w for r in rows for w in r.passphrase.split(" ")]
    assert len(drawn) == 1200 and all(re.fullmatch(r"w\d{1,6}", w) for w in drawn)
    assert len(set(drawn)) > 1150 and 350_000 < sum(int(w[1:]) for w in drawn) / 1200 < 650_000
    with pytest.raises(ValueError, match="empty"):
        codes.issue_passphrases(spark.range(1), words.limit(0), "w", 2)
