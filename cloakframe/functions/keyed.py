"""Digests under a secret key that stands in no plan.

The key is the only value of a one-row table and enters as a scalar subquery, so plans, logs and
query listings show where it is used, never what it is.  It works on streams too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from cloakframe.functions.matching import name

KEY = "_secret_key"


def under_key(df: DataFrame, key: str, change: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """``change(df, column)`` with the key in that column, which then goes; without a key ``change(df, '')``."""
    if not key:
        return change(df, "")
    table = df.sparkSession.createDataFrame([(key,)], "key string")
    return change(df.withColumn(KEY, table.scalar()), KEY).drop(KEY)


def digest_sql(value: str, key_column: str) -> str:
    """SQL text for a hex digest of ``value``: md5, or with a key the nested sha256 of key and value."""
    if not key_column:
        return f"md5({value})"
    key = name(key_column)
    return f"sha2(concat({key}, sha2(concat({key}, {value}), 256)), 256)"
