"""Digest, verify, compare and group contents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from cloakframe.functions.digests import ALGORITHMS, algorithm_of, digest, first_difference
from cloakframe.functions.formatting import format_size
from cloakframe.functions.matching import strip
from cloakframe.operators.expected import among, maybe_expected
from cloakframe.operators.spread import heavy_join
from cloakframe.sources.scratch import materialized


def fingerprint(df: DataFrame, key: Sequence[str], content: str,
                algorithm: str = "sha256") -> DataFrame:
    """Key columns, size in bytes, algorithm and digest of each row's content."""
    return df.select(
        *key,
        F.octet_length(content).cast("bigint").alias("length"),
        F.lit(algorithm).alias("algorithm"),
        digest(F.col(content), algorithm).alias("digest"),
    )


def _judged(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Status of rows with ``expected``, ``actual``, ``present`` and ``same_size`` (null: no size is expected)."""
    status = (
        F.when(~F.coalesce("present", F.lit(False)), "MISSING")
        .when(~F.coalesce("same_size", F.lit(True)), "MISMATCH")
        .when(F.col("actual").isNull(), "MISSING")
        .when(F.col("actual") == F.col("expected"), "MATCH")
        .otherwise("MISMATCH")
    )
    return rows.select(
        *key, "algorithm", "expected", "actual", status.alias("status"),
        F.when(status == "MISMATCH", first_difference("actual", "expected")).alias("first_difference"),
    )


def wanted_digests(expected: DataFrame, key: Sequence[str], algorithm: str = "sha256") -> DataFrame:
    """Key columns, expected (bare, lower case), algorithm, and expected_length where there is a ``length``."""
    wanted = expected.select(
        *key, F.lower(strip(F.col("expected"))).alias("expected"),
        (F.col("length") if "length" in expected.columns else F.lit(None)).cast("bigint").alias("expected_length"))
    return wanted.withColumn("algorithm", algorithm_of(F.col("expected"), algorithm))


def verify(df: DataFrame, key: Sequence[str], content: str, expected: DataFrame,
           algorithm: str = "sha256") -> DataFrame:
    """Check contents against expected digests (key columns and ``expected``, unique keys).

    Status is MATCH, MISMATCH (with the first differing position, from 0) or
    MISSING.  Unless an algorithm is asked for, it follows from the length of the
    expected digest.  Rows that nobody expects are told by a Bloom filter of the keys and neither
    hashed nor shuffled; digests are computed before the join, so that contents
    are never shuffled.  Only algorithms that occur are run: their names, four at most, are
    looked up first.  With a column ``length`` in ``expected``, contents of another size (in bytes)
    are a MISMATCH without a digest.
    """
    wanted = wanted_digests(expected, key, algorithm)
    kinds = [algorithm]
    if algorithm == "sha256":
        asked = {r.algorithm for r in wanted.select("algorithm").distinct().collect()}
        kinds = [k for k in ALGORITHMS if k in asked] or kinds
    size = F.octet_length(content).cast("bigint")
    hashed = F.lit(True)
    if "length" in expected.columns:  # -1: any size
        sizes = wanted.select(*key, F.coalesce("expected_length", F.lit(-1).cast("bigint")).alias("expected_length"))
        names = [*key, "expected_length"]
        hashed = among(sizes, names, [*key, size]) | among(sizes, names, [*key, F.lit(-1).cast("bigint")])
    found = maybe_expected(df, wanted, key).select(
        *key, F.lit(True).alias("present"), size.alias("_size"),
        *[F.when(hashed, digest(F.col(content), k)).alias(k) for k in kinds])
    joined = wanted.join(found, list(key), "left").withColumn("same_size", F.col("_size") == F.col("expected_length"))
    actual = F.coalesce(*[F.when(F.col("algorithm") == k, F.col(k)) for k in kinds])
    return _judged(joined.withColumn("actual", F.when(F.coalesce("same_size", F.lit(True)), actual)), key)


def verify_digests(found: DataFrame, key: Sequence[str]) -> DataFrame:
    """Like :func:`verify` for rows that have ``expected``, ``actual``, ``present`` and ``same_size`` already."""
    return _judged(found, key)


def compare(left: DataFrame, right: DataFrame, key: Sequence[str], content: str,
            algorithm: str = "sha256") -> DataFrame:
    """Compare two collections by key: IDENTICAL, DIFFERENT, LEFT_ONLY, RIGHT_ONLY or REPEATED.

    One row per key.  A key that both sides have, one of them with different contents
    under it, is REPEATED and shows the smallest size; equal repeated rows count once.  Two null
    contents are identical.  Only key, size and digest of each row are shuffled, never the contents.
    """
    prints = {}
    for side, df in (("left", left), ("right", right)):
        rows = df.select(
            *key,
            F.octet_length(content).cast("bigint").alias("length"),
            digest(F.col(content), algorithm).alias("digest"),
        )
        found = F.struct("length", "digest")
        prints[side] = rows.groupBy(*key).agg(
            F.min(found).alias(f"in_{side}"),
            (~F.min(found).eqNullSafe(F.max(found))).alias(f"{side}_repeated"),
        )
    both = prints["left"].join(prints["right"], list(key), "full_outer").withColumns({
        f"{side}_length": F.col(f"in_{side}.length") for side in prints
    })
    status = (
        F.when(F.col("in_right").isNull(), "LEFT_ONLY")
        .when(F.col("in_left").isNull(), "RIGHT_ONLY")
        .when(F.col("left_repeated") | F.col("right_repeated"), "REPEATED")
        .when(F.col("in_left") == F.col("in_right"), "IDENTICAL")
        .otherwise("DIFFERENT")
    )
    return both.select(*key, "left_length", "right_length", status.alias("status"))


def identical_groups(df: DataFrame, row_id: str, content: str,
                     algorithm: str = "sha256") -> DataFrame:
    """Contents that occur more than once: length, digest, copies, first_id.

    Null contents are no copies of each other.  A plain aggregate with partial sums: a content shared by a third of all rows
    is reduced before the shuffle, and no list of members is built.
    """
    return _groups(fingerprint(df, [row_id], content, algorithm), row_id)


def _groups(prints: DataFrame, row_id: str) -> DataFrame:
    return (
        prints.filter("digest is not null").groupBy("length", "digest")
        .agg(F.count("*").alias("copies"), F.min(row_id).alias("first_id"))
        .filter("copies > 1")
    )


def identical_members(df: DataFrame, row_id: str, content: str,
                      algorithm: str = "sha256") -> DataFrame:
    """One row per member of each group of identical contents, with the group's data.

    Contents are hashed once and the fingerprints written.
    """
    prints = materialized(
        fingerprint(df, [row_id], content, algorithm).drop("algorithm"), "fingerprints"
    )
    return heavy_join(prints, _groups(prints, row_id), ["length", "digest"], "inner").select(
        row_id, "length", "digest", "copies", "first_id"
    )


def manifest_rows(df: DataFrame, path: str, content: str, algorithm: str = "sha256") -> DataFrame:
    """rel_path, length, algorithm and digest, ordered by path.

    Contents are hashed once and the fingerprints written: sampling for the sort would hash them again.
    """
    rows = fingerprint(df.withColumnRenamed(path, "rel_path"), ["rel_path"], content, algorithm)
    return materialized(rows, "fingerprints").orderBy("rel_path")


def inventory_summary(inventory: DataFrame, length: str = "length") -> DataFrame:
    """One row: files, total size in bytes and readable total size."""
    totals = inventory.agg(
        F.count("*").alias("files"),
        F.coalesce(F.sum(length), F.lit(0)).cast("bigint").alias("total_size"),
    )
    return totals.withColumn("total_size_text", format_size("total_size"))
