"""Issue random codes, one per row, from the operating system's secure source.

Spark's own random functions are seeded, hence predictable; these codes are not,
so they change when a plan runs again: write them once.
"""

from __future__ import annotations

import secrets
import string
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cloakframe.functions import fixed_values as fixed
from cloakframe.operators.numbering import numbered
from cloakframe.sources.scratch import materialized


def _issue(df: DataFrame, output: str, make: Callable[[int], list[str]]) -> DataFrame:
    @F.pandas_udf("string")
    def code(row: pd.Series) -> pd.Series:
        return pd.Series(make(len(row)), dtype=object)

    return df.withColumn(output, code.asNondeterministic()(F.spark_partition_id()))


def _uniform() -> Callable[[int, int], np.ndarray]:
    """Function (below, n): n secure random numbers, all equally likely.

    Made anew, so that it is shipped by value: workers need not have this package.
    """

    def draw(below: int, n: int) -> np.ndarray:
        limit = 2**32 - 2**32 % below  # numbers from here on would favor small results
        kept = np.empty(0, np.uint64)
        while len(kept) < n:
            raw = np.frombuffer(secrets.token_bytes(4 * (n - len(kept))), np.uint32)
            raw = raw.astype(np.uint64)
            kept = np.concatenate([kept, raw[raw < np.uint64(limit)]])
        return (kept % np.uint64(below)).astype(np.int64)

    return draw


def code_sets(use_upper: bool = True, use_lower: bool = True, use_digits: bool = True,
              use_symbols: bool = True, exclude_ambiguous: bool = False) -> list[str]:
    """The enabled character sets."""
    sets = [
        s for s, used in (
            (string.ascii_uppercase, use_upper), (string.ascii_lowercase, use_lower),
            (string.digits, use_digits), (fixed.SYMBOLS, use_symbols),
        ) if used
    ]
    if exclude_ambiguous:
        sets = ["".join(c for c in s if c not in fixed.AMBIGUOUS) for s in sets]
    if not any(sets):
        raise ValueError("enable at least one character set")
    return sets


def issue_codes(df: DataFrame, output: str = "code", length: int = 16,
                custom: str | None = None, **sets: bool) -> DataFrame:
    """Random code per row; from length 4 on it has a character of every enabled set."""
    if length < 1:
        raise ValueError("length must be at least 1")
    parts = [custom] if custom else code_sets(**sets)
    every = "".join(parts)
    required = parts if length >= 4 and not custom else []

    draw = _uniform()

    def make(n: int) -> list[str]:
        pools = [*required, *[every] * (length - len(required))]
        columns = [np.array(list(p))[draw(len(p), n)] for p in pools]
        chars = np.stack(columns, axis=1)
        order = np.frombuffer(secrets.token_bytes(8 * n * length), np.uint64).reshape(n, length)
        shuffled = np.take_along_axis(chars, order.argsort(axis=1), axis=1)
        return ["".join(row) for row in shuffled]

    return _issue(df, output, make)


def issue_passphrases(df: DataFrame, words_df: DataFrame, word: str, n: int = 5,
                      separator: str = "-", capitalize: bool = False,
                      output: str = "passphrase") -> DataFrame:
    """``n`` random words per row from a word table of any size.

    The different words are numbered on the executors, each row draws ``n`` numbers from the system's
    secure source, and the numbers are joined with the words.  Rows are told apart by where they lie, so
    ``df`` should give the same rows in the same places when a task runs again.
    """
    if n < 2:
        raise ValueError("a passphrase has at least two words")
    words = materialized(numbered(words_df.select(F.col(word).alias("_word")).filter("_word is not null").distinct(), "_no"), "words")
    count = words.count()
    if not count:
        raise ValueError("the word table is empty")
    draw = _uniform()

    @F.pandas_udf("array<bigint>")
    def numbers(rows: pd.Series) -> pd.Series:
        return pd.Series(list(draw(count, len(rows) * n).reshape(len(rows), n).astype(np.int64)))

    kept = df.select(F.struct(*df.columns).alias("_kept"), F.monotonically_increasing_id().alias("_row"))
    drawn = kept.withColumn("_nos", numbers.asNondeterministic()("_row")).select(
        "_kept", "_row", F.posexplode("_nos").alias("_at", "_no"))
    shown = F.concat(F.upper(F.left("_word", F.lit(1))), F.lower(F.substring("_word", 2, 2**31 - 1))) if capitalize else F.col("_word")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("_at", "_shown"))), lambda x: x["_shown"])
    return drawn.join(words, "_no").withColumn("_shown", shown).groupBy("_row").agg(
        F.any_value("_kept").alias("_kept"), F.array_join(parts, separator).alias(output)).select("_kept.*", output)


def issue_pins(df: DataFrame, length: int = 6, output: str = "pin") -> DataFrame:
    """Independent random digits per row."""
    if length < 1:
        raise ValueError("length must be at least 1")
    draw = _uniform()

    def make(n: int) -> list[str]:
        return ["".join(map(str, row)) for row in draw(10, n * length).reshape(n, length)]

    return _issue(df, output, make)
