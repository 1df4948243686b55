"""Plans that must hold at any size."""

import pytest

import __spark_entry__ as entry

QUERIES = entry.queries()
NARROW = ("sanitize_documents", "sanitize_logs", "anonymize_people", "redact_terms", "explode_lines",
          "scan_documents", "digests", "valid_cards", "property_risk")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"sanitize_stream"}))
def test_no_join_without_keys(spark, small, name):
    plan = _plan(QUERIES[name](spark, small))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", NARROW)
def test_row_work_needs_no_shuffle(spark, small, name):
    plan = _plan(QUERIES[name](spark, small))
    for line in plan.splitlines():
        if "Exchange" in line:  # spreading small test files, or the join that derives rows
            assert "REPARTITION_BY_NUM" in line or name == "property_risk", line
    assert "Python" not in plan


def test_only_needed_columns_are_read(spark, small):
    plan = _plan(QUERIES["scan_documents"](spark, small))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    plan = _plan(QUERIES["digests"](spark, small))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    plan = _plan(QUERIES["anonymize_stats"](spark, small))
    assert "c_acctbal" not in plan.split("ReadSchema")[1]


def test_contents_are_not_shuffled(spark, small):
    from cloakframe.operators import fingerprint as prints

    docs = spark.read.parquet(f"{small}/documents.parquet")
    for df in (prints.compare(docs, docs, ["doc_id"], "text"),
               prints.identical_groups(docs, "doc_id", "text")):
        plan = _plan(df)
        assert plan.count("sha2(") >= 1
        for block in plan.split("Exchange")[:-1]:
            assert "text#" not in block.splitlines()[-1]


def test_counting_combines_before_the_shuffle(spark, small):
    plan = _plan(QUERIES["scan_counts"](spark, small))
    assert "partial_count" in plan
