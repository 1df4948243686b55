"""Equi-join that stays balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

_WAYS = 16
_SALT = "_spread"


def spread_join(
    many: DataFrame, one: DataFrame, on: Sequence[str], how: str, ways: int = _WAYS
) -> DataFrame:
    """Join ``many`` with ``one``, which has at most one row per key.

    Rows of a key are spread by a hash of their other columns over ``ways``
    shuffle partitions and the row of ``one`` is repeated for each; no key is
    treated apart, so nothing has to be counted first.  If ``one`` turns out
    small, adaptive execution still replaces the shuffle by a broadcast.
    """
    rest = [c for c in many.columns if c not in on]
    salted = many.withColumn(_SALT, F.pmod(F.xxhash64(*(rest or on)), F.lit(ways)).cast("int"))
    repeated = one.withColumn(
        _SALT, F.explode(F.array(*[F.lit(i) for i in range(ways)]))
    )
    return salted.join(repeated, [*on, _SALT], how).drop(_SALT)


#: Keys that the sketch of a table follows, and keys that are split at most.
_TRACKED, _HEAVIEST = 4096, 64


def heavy_keys(rows: DataFrame, on: Sequence[str], parts: int) -> dict[int, int]:
    """Hash to number of ways for the keys that hold more than half of the fair share of one of ``parts`` tasks.

    One aggregate with a mergeable sketch of frequent items: the driver gets at most 64 hashes.  A key of
    such a share cannot be missed as long as the sketch follows more keys than there are fair shares.
    """
    tops = rows.agg(F.count("*").alias("n"), F.expr(
        f"approx_top_k(xxhash64({', '.join(f'`{c}`' for c in on)}), {_HEAVIEST}, {_TRACKED})").alias("top")).first()
    if not tops.n:
        return {}
    fair = tops.n / parts
    return {t["item"]: max(2, min(parts, round(2 * t["count"] / fair))) for t in tops.top if t["count"] > fair / 2}


def heavy_join(many: DataFrame, one: DataFrame, on: Sequence[str], how: str, parts: int | None = None) -> DataFrame:
    """Like :func:`spread_join`, with as many ways for a key as its share of ``many`` asks for.

    Light keys, most of them, stay in one way and their rows of ``one`` are not repeated.  ``many`` is
    read twice, so it should be a stored table.  ``parts``: the tasks to spread over, at least 64.
    """
    parts = parts or max(64, int(many.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    heavy = heavy_keys(many, on, parts)
    if not heavy:
        return many.join(one, list(on), how)

    def ways(default: int) -> Column:
        mark = F.xxhash64(*on)
        out = F.when(F.lit(False), default)
        for key, count in heavy.items():
            out = out.when(mark == key, count)
        return out.otherwise(default)

    rest = [c for c in many.columns if c not in on]
    salted = many.withColumn(_SALT, F.pmod(F.xxhash64(*(rest or on)), ways(1)).cast("int"))
    repeated = one.withColumn(_SALT, F.explode(F.sequence(F.lit(0), ways(1) - 1)))
    return salted.join(repeated, [*on, _SALT], how).drop(_SALT)
