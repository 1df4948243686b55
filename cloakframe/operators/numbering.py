"""Consecutive numbers for the rows of a table of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cloakframe.sources.scratch import materialized

_IN_PART = (1 << 33) - 1


def numbered(df: DataFrame, column: str = "number", order: list[Column] | None = None) -> DataFrame:
    """``df`` with numbers from 0 without gaps, in ``order`` or, without one, as the rows lie.

    Each task numbers its own rows; only the counts per task are added up.  The rows are written once,
    so numbers stay as they are when they are read again.
    """
    rows = df if order is None else df.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    kept = materialized(rows.select("*", F.shiftright(at, 33).cast("int").alias("_part"),
                                    at.bitwiseAND(F.lit(_IN_PART)).alias("_at")), "numbered")
    counts = kept.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = counts.select("_part", (F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).alias("_before"))
    return kept.join(F.broadcast(before), "_part").withColumn(column, F.col("_before") + F.col("_at")).drop(
        "_part", "_at", "_before")
