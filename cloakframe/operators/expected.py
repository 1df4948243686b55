"""Rows whose keys are expected, told by a Bloom filter before anything costly is done with them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Bits of the filter: 16 for each key, at least and at most so many (8 MB).
_LEAST_BITS, _MOST_BITS = 1 << 12, 1 << 26


def _places(key: Sequence[str | Column], bits: int) -> list[Column]:
    """Two bit positions of a key."""
    marks = F.xxhash64(*key), F.xxhash64(*key, F.lit(1))
    return [F.pmod(mark, F.lit(bits)).cast("bigint") for mark in marks]


def _words(keys: DataFrame, key: Sequence[str], bits: int) -> DataFrame:
    """One row with the filter as an array of 64-bit words, put together by the executors."""
    place = keys.select(F.explode(F.array(*_places(key, bits))).alias("place"))
    word = F.shiftright("place", 6)
    masks = place.groupBy(word.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("mask"))
    every = keys.sparkSession.range(bits // 64).join(masks, F.col("id") == F.col("word"), "left")
    ordered = F.array_sort(F.collect_list(F.struct("id", F.coalesce("mask", F.lit(0).cast("bigint")).alias("mask"))))
    return every.agg(F.transform(ordered, lambda x: x["mask"]).alias("words"))


def among(keys: DataFrame, key: Sequence[str], probe: Sequence[str | Column], most_bits: int = _MOST_BITS) -> Column:
    """Whether the ``probe`` columns of a row, of the same types, are a key of ``keys``; by chance true for others.

    The filter stands in the plan as a scalar subquery.  With more keys than it was made for it is true
    more often, never false for a key.
    """
    count = keys.count()
    bits = _LEAST_BITS
    while bits < min(16 * count, most_bits):
        bits *= 2
    words = _words(keys, key, bits).scalar()
    test = F.lit(True)
    for place in _places(probe, bits):
        at = F.element_at(words, (F.shiftright(place, 6) + 1).cast("int"))
        test &= F.getbit(at, place.bitwiseAND(F.lit(63)).cast("int")) == 1
    return test


def maybe_expected(df: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    """The rows of ``df`` whose key is among ``keys``, and by chance a few others.

    The test is a filter right above the scan, so contents of other rows are not even looked at.
    """
    return df.filter(among(keys, key, key))
