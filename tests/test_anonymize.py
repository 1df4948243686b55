import datetime
import hashlib

import pytest
from pyspark.sql import functions as F

from cloakframe.functions import validators
from cloakframe.functions.pseudonyms import GENERATORS, pseudonym, register_generator, seed
from cloakframe.operators import anonymize as anon

NAMES = {
    "c_name": "name", "n_regionkey": "state", "c_acctbal": "credit_card", "l_shipdate": "ip_address",
    "description": "ip_address", "email_address": "email", "zip_code": "zip", "account": "credit_card",
    "cc": "credit_card", "ip": "ip_address", "ip_address": "address", "client_ip": "name",
    "company_name": "name", "username": "name", "rating": "ssn", "tax_id": "ssn", "SSN": "ssn",
    "hotel": "phone", "cancelled": "phone", "dob": "date_of_birth", "birthplace": "date_of_birth",
    "status": None, "order_id": None, "  Full Name ": "name",
}


def test_types_by_name(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "n string")
    rows = df.select("n", anon.type_by_name(F.col("n")).alias("t")).collect()
    assert {r.n: r.t for r in rows} == NAMES
    assert {n: anon.type_of_name(n) for n in NAMES} == NAMES
    assert anon.type_of_name("rating", "token") is None
    assert anon.type_of_name("customer_name", "token") == "name"


@pytest.mark.parametrize("matching,kind", [(10, None), (11, "email")])
def test_content_needs_more_than_half(spark, matching, kind):
    rows = [(i, "c", "a@b.co" if i < matching else "x") for i in range(20)]
    rows += [(i, "c", "a@b.co") for i in range(20, 100)] + [(-1, "c", None)]
    df = spark.createDataFrame(rows, "id int, column string, value string")
    row = anon.types_by_content(df, "column", "value", ["id"]).first()
    assert (row.sampled, row.pii_type) == (20, kind)
    wide = df.select("id", F.col("value").alias("c"))
    assert anon.infer_column_plan(wide, order_by=["id"]).get("c") == kind


def test_content_sample_is_cut_before_the_shuffle(spark, medium):
    orders = spark.read.parquet(f"{medium}/orders.parquet")
    df = orders.unpivot(["o_orderkey"], ["o_orderstatus", "o_orderpriority"], "column", "value")
    plan = anon.types_by_content(df, "column", "value", ["o_orderkey"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.index("WindowGroupLimit") < text.rindex("WindowGroupLimit")


def test_plan_by_content_and_header(spark):
    df = spark.createDataFrame(
        [("1-2", "123-45-6789", "10.0.0.1", "743-555-3824", "Jo")],
        "a string, b string, d string, e string, c_name string",
    )
    assert anon.infer_column_plan(df) == {
        "b": "ssn", "d": "ip_address", "e": "phone", "c_name": "name"
    }


def test_parse_plan():
    columns = ["Full Name", "Contact", "x"]
    with pytest.warns(UserWarning):
        plan = anon.parse_column_plan("full name, Contact:email, x, y:bogus", columns)
    assert plan == {"full name": "name", "Contact": "email"}


def test_seed_is_of_the_normalized_value(spark):
    df = spark.createDataFrame([("John Smith",), ("  john SMITH\t",)], "v string")
    assert {r[0] for r in df.select(seed("v")).collect()} == {369897834}
    assert int(hashlib.md5(b"john smith").hexdigest(), 16) % 2**32 == 369897834


@pytest.fixture(scope="module")
def fakes(spark):
    df = spark.range(3000).select(F.concat(F.lit("Person "), F.col("id")).alias("v"))
    return df.select("v", *[pseudonym("v", k).alias(k) for k in GENERATORS],
                     pseudonym("v", "ssn", valid_ssn=True).alias("issued")).cache()


def test_fakes_are_valid(fakes):
    bad = fakes.filter(
        ~validators.is_card(F.col("credit_card")) | ~validators.is_phone(F.col("phone"))
        | ~validators.is_ipv4(F.col("ip_address")) | validators.is_ssn(F.col("ssn"))
        | ~validators.is_ssn(F.col("issued")) | ~F.col("email").rlike(r"^[a-z.]+\d+@example\.com$")
        | ~F.col("zip").rlike(r"^\d{5}$")
    )
    assert bad.count() == 0
    born = [datetime.date.fromisoformat(r[0]) for r in fakes.select("date_of_birth").collect()]
    days = [(datetime.date(2025, 1, 1) - b).days for b in born]
    assert 6574 <= min(days) and max(days) < 6574 + 26298
    assert fakes.select("email").distinct().count() > 2500


def test_equal_values_get_equal_fakes(spark):
    df = spark.createDataFrame([("Ann",), (" ann ",), ("ANN",), ("Bob",), ("",), (" ",), (None,)],
                               "v string")
    rows = [r[0] for r in df.select(pseudonym("v", "name")).collect()]
    assert rows[0] == rows[1] == rows[2] != rows[3] and rows[4:] == ["", " ", None]
    assert [r[0] for r in df.select(pseudonym("v", "unknown")).collect()][0] == "Ann"


def test_anonymize_keeps_other_columns(spark, small):
    df = spark.read.parquet(f"{small}/customer.parquet")
    with pytest.warns(UserWarning):
        out = anon.anonymize(df, {"c_name": "name", "nope": "email"})
    assert out.columns == df.columns
    assert out.drop("c_name").exceptAll(df.drop("c_name")).count() == 0
    assert out.join(df, "c_name", "left_semi").count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_preview_and_stats(spark):
    rows = [(i, None if i == 1 else f"n{i}", " " if i == 2 else f"u{i}@a.org") for i in range(9)]
    df = spark.createDataFrame(rows, "id int, name string, mail string")
    plan = {"name": "name", "mail": "email"}
    seen = anon.anonymize_preview(df, plan, ["id"]).collect()
    assert sorted((r.column, r.rank, r.original) for r in seen) == [
        ("mail", 1, "u0@a.org"), ("mail", 2, "u1@a.org"), ("mail", 3, " "),
        ("name", 1, "n0"), ("name", 2, "n2"), ("name", 3, "n3"),
    ]
    stats = anon.anonymize_stats(df, plan).first()
    assert tuple(stats) == (9, 2, 17)


def test_preview_sorts_no_whole_column(spark):
    df = spark.range(1000).selectExpr("cast(999 - id as int) AS id", "if(id % 2 = 0, null, concat('n', id)) AS name")
    plan = {"name": "name", "id": "company"}
    for key in ("", "secret"):
        seen = anon.anonymize_preview(df, plan, ["id"], 2, key)
        known = [(r.column, r.pii_type, r.rank, r.original) for r in seen.collect()]
        assert sorted(known) == [("id", "company", 1, "0"), ("id", "company", 2, "1"),
                                 ("name", "name", 1, "n999"), ("name", "name", 2, "n997")]
        assert {r.fake for r in seen.filter("column = 'name'").collect()} == {
            r.name for r in anon.anonymize(df.filter("id < 3 and name is not null"), {"name": "name"}, key).collect()}
        plan_text = seen._jdf.queryExecution().executedPlan().toString()
        assert "TakeOrderedAndProject" in plan_text and "WindowGroupLimit" not in plan_text


def test_new_generator(spark):
    register_generator("color", lambda s: f"array('red', 'blue')[cast({s[0]} % 2 as int)]")
    try:
        df = spark.createDataFrame([("x",)], "v string")
        assert df.select(pseudonym("v", "color")).first()[0] in ("red", "blue")
    finally:
        GENERATORS.pop("color")


def test_plan_takes_one_job_and_is_the_same_in_every_run(spark):
    rows = [(i, *[f"u{i}.{j}@a.org" if j % 2 else f"10.0.{j}.{i % 250}" for j in range(12)]) for i in range(400)]
    df = spark.createDataFrame(rows, ["k", *[f"x{j}" for j in range(12)]])
    wanted = {f"x{j}": "email" if j % 2 else "ip_address" for j in range(12)}

    def jobs(frame):
        group = f"plan-{len(frame.columns)}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            return anon.infer_column_plan(frame), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    one, few = jobs(df.select("x0"))
    every, many = jobs(df)
    assert one == {"x0": "ip_address"} and every == wanted and many == few
    mixed = spark.createDataFrame([(f"v{i}" if i % 2 else f"m{i}@b.co",) for i in range(2000)], "x string")
    assert len({str(anon.infer_column_plan(mixed.repartition(n))) for n in (1, 3, 8)}) == 1
    assert anon.infer_column_plan(mixed.limit(0)) == {}
