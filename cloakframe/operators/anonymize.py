"""Classify columns and replace personal values by consistent fakes."""

from __future__ import annotations

import re
import warnings
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from cloakframe.functions import fixed_values as fixed
from cloakframe.functions.dialect import java_pattern
from cloakframe.functions.matching import strip
from cloakframe.functions.keyed import under_key
from cloakframe.functions.pseudonyms import GENERATORS, pseudonym

Plan = Mapping[str, str]


def _name_patterns(match: str) -> dict[str, str]:
    if match not in ("anywhere", "token"):
        raise ValueError(f"match must be 'anywhere' or 'token', not {match!r}")
    joined = {kind: "|".join(ps) for kind, ps in fixed.COLUMN_NAME_PATTERNS.items()}
    if match == "token":
        return {kind: f"(?:^|[^a-z])(?:{p})(?:$|[^a-z])" for kind, p in joined.items()}
    return joined


def type_by_name(column_name: Column, match: str = "anywhere") -> Column:
    """Kind of personal data a column name suggests, or null; for a table of names."""
    plain = strip(F.lower(column_name))
    return F.coalesce(
        *[F.when(plain.rlike(java_pattern(p)), kind) for kind, p in _name_patterns(match).items()]
    )


def type_of_name(column_name: str, match: str = "anywhere") -> str | None:
    """The same for one name on the driver."""
    plain = column_name.lower().strip()
    kinds = (kind for kind, p in _name_patterns(match).items() if re.search(p, plain))
    return next(kinds, None)


def _type_by_shares(value: Column) -> Column:
    """Aggregate: first kind that more than half of the values look like."""
    shares = [
        (kind, F.count_if(value.rlike(java_pattern(p))))
        for kind, p in fixed.COLUMN_VALUE_PATTERNS.items()
    ]
    return F.coalesce(*[F.when(n * 2 > F.count(value), kind) for kind, n in shares])


def types_by_content(
    values: DataFrame, column: str, value: str, order_by: Sequence[str],
    sample: int = fixed.CONTENT_SAMPLE,
) -> DataFrame:
    """Kind of each column from its first values: for a long table (column, value, order).

    The rank limit is applied in each partition before the shuffle, so at most
    ``sample`` rows per column and partition travel.
    """
    first = Window.partitionBy(column).orderBy(*order_by)
    sampled = (
        values.filter(F.col(value).isNotNull())
        .select(column, value, F.row_number().over(first).alias("rank"))
        .filter(F.col("rank") <= sample)
    )
    return sampled.groupBy(column).agg(
        F.count("*").alias("sampled"), _type_by_shares(F.col(value)).alias("pii_type")
    )


def infer_column_plan(df: DataFrame, order_by: Sequence[str] = (),
                      sample: int = fixed.CONTENT_SAMPLE, match: str = "anywhere") -> dict[str, str]:
    """Kind by name, else by content, of each column that holds personal data.

    One job for all undecided columns: each task keeps the first ``sample`` values of each
    column in ``order_by``, without one in the order of their hashes, so every run takes the same.  The
    driver gets one row per column.
    """
    plan = {c: type_of_name(c, match) for c in df.columns}
    undecided = [c for c, kind in plan.items() if kind is None]
    if undecided:
        keys = [F.col(c).alias(f"_order{i}") for i, c in enumerate(order_by)]
        values = df.select(*keys, F.inline(F.array(*[
            F.struct(F.lit(c).alias("_column"), F.col(c).cast("string").alias("_value")) for c in undecided])))
        order = [f"_order{i}" for i in range(len(keys))] or ["_order", "_value"]
        if not keys:
            values = values.withColumn("_order", F.xxhash64("_value"))
        found = types_by_content(values, "_column", "_value", order, sample).collect()
        plan.update({r["_column"]: r.pii_type for r in found})
    return {c: kind for c, kind in plan.items() if kind}


def parse_column_plan(spec: str, columns: Sequence[str]) -> dict[str, str]:
    """Plan from ``column`` or ``column:type`` items, separated by commas.

    Items without a usable type are left out with a warning.
    """
    plan: dict[str, str] = {}
    for item in (s.strip() for s in spec.split(",")):
        column, _, kind = (part.strip() for part in item.partition(":"))
        kind = kind.lower() if ":" in item else type_of_name(column)
        if kind is None:
            same = [c for c in columns if c.lower() == column.lower()]
            column, kind = (same[0], type_of_name(same[0])) if same else (column, None)
        if kind not in GENERATORS:
            warnings.warn(f"no usable type for {item!r}; known: {sorted(GENERATORS)}", stacklevel=2)
            continue
        plan[column] = kind
    return plan


def _present_columns(df: DataFrame, plan: Plan) -> dict[str, str]:
    missing = sorted(set(plan) - set(df.columns))
    if missing:
        warnings.warn(f"columns not found, skipped: {missing}", stacklevel=3)
    return {c: kind for c, kind in plan.items() if c in df.columns}


def anonymize(df: DataFrame, plan: Plan | None = None, key: str = "") -> DataFrame:
    """Replace the planned columns by fakes; others stay.  One narrow projection."""
    plan = _present_columns(df, infer_column_plan(df) if plan is None else plan)
    return under_key(df, key, lambda rows, k: rows.withColumns({c: pseudonym(c, kind, k) for c, kind in plan.items()}))


def anonymize_preview(df: DataFrame, plan: Plan, order_by: Sequence[str], n: int = 3,
                      key: str = "") -> DataFrame:
    """First ``n`` values per planned column and their fakes: column, pii_type, rank, ..."""
    plan = _present_columns(df, plan)
    order = [f"_order{i}" for i in range(len(order_by))]

    def first(rows: DataFrame, k: str, column: str, kind: str) -> DataFrame:
        """A task keeps ``n`` rows and sorts no others; fakes are made for these only."""
        top = rows.filter(F.col(column).isNotNull()).select(
            *[F.col(c).alias(at) for c, at in zip(order_by, order, strict=True)], column, *([k] if k else [])
        ).orderBy(*order).limit(n)
        return top.select(
            *order, *([k] if k else []), F.lit(column).alias("column"), F.lit(kind).alias("pii_type"),
            F.col(column).cast("string").alias("original"), pseudonym(column, kind, k).cast("string").alias("fake"))

    def pairs(rows: DataFrame, k: str) -> DataFrame:
        return reduce(DataFrame.unionByName, [first(rows, k, c, kind) for c, kind in plan.items()])

    return under_key(df, key, pairs).withColumn(
        "rank", F.row_number().over(Window.partitionBy("column").orderBy(*order))
    ).select("column", "pii_type", "rank", "original", "fake")


def anonymize_stats(df: DataFrame, plan: Plan) -> DataFrame:
    """One row: rows, columns changed, values that are not null in those columns."""
    plan = _present_columns(df, plan)
    values = sum((F.count(c) for c in plan), F.lit(0).cast("bigint"))
    return df.agg(
        F.count("*").alias("n_rows"),
        F.lit(len(plan)).cast("bigint").alias("columns_anonymized"),
        values.alias("values_replaced"),
    )
