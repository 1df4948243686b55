"""Whole jobs over folders: scan, sanitize, anonymize, hash, list properties."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cloakframe.functions import fixed_values as fixed
from cloakframe.operators.anonymize import anonymize, infer_column_plan
from cloakframe.operators.detect import hit_counts, scan_text
from cloakframe.operators import fingerprint as prints
from cloakframe.operators.properties import os_properties
from cloakframe.operators.sanitize import pieces_stats, sanitize_changed, sanitize_pieces, sanitize_stats
from cloakframe.operators.spread import heavy_join
from cloakframe.sources import files, ranges, tables
from cloakframe.sources.scratch import materialized

#: First bytes that tell most files apart.
_HEAD = 1 << 16


def scan_files(spark: SparkSession, path: str | Sequence[str], recursive: bool = False,
               types: Iterable[str] | None = None, range_bytes: int = ranges.RANGE) -> DataFrame:
    """Findings in all files of scannable types: file and the finding columns.

    Large files are read in byte ranges by many tasks; lines are those of the whole file.
    """
    pieces = ranges.read_text_pieces(spark, path, recursive, fixed.SCANNABLE_EXTENSIONS, range_bytes=range_bytes)
    found = scan_text(pieces, "text", types, keep=["file", "first_line"])
    return found.withColumn("line", (F.col("first_line") + F.col("line") - 1).cast("bigint")).drop("first_line")


def scan_files_summary(spark: SparkSession, path: str | Sequence[str], recursive: bool = False,
                       types: Iterable[str] | None = None, range_bytes: int = ranges.RANGE) -> DataFrame:
    """One row: files found, files scanned, files with hits, findings, and per type."""
    pieces = ranges.read_text_pieces(spark, path, recursive, fixed.SCANNABLE_EXTENSIONS, range_bytes=range_bytes)
    found = files.file_inventory(spark, path, recursive).count()
    counts = hit_counts(pieces, "text", types, keep=["file"])
    kinds = [c for c in counts.columns if c != "file"]
    total = sum((F.col(c) for c in kinds), F.lit(0).cast("bigint"))
    in_files = counts.groupBy("file").agg(*[F.sum(c).alias(c) for c in kinds])
    sums = in_files.select("*", total.alias("n")).agg(
        F.count("*").alias("files_scanned"), F.count_if(F.col("n") > 0).alias("files_with_pii"),
        F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("total_findings"),
        *[F.sum(c).alias(c) for c in kinds])
    by_type = F.create_map(*[x for c in kinds for x in (F.lit(c.upper()), F.col(c))])
    return sums.select(
        F.lit(found).alias("files_found"), "files_scanned", "files_with_pii", "total_findings",
        F.map_filter(by_type, lambda _, n: n > 0).alias("types_found"))


def sanitize_files(spark: SparkSession, path: str | Sequence[str], out: str | None = None,
                   recursive: bool = False, types: Iterable[str] | None = None,
                   key: str = "", mode: str = "line", range_bytes: int = ranges.RANGE) -> DataFrame:
    """Sanitize log files; the stats row is returned.

    With ``out``, the changed files are written as rows (file, first_line, text, output_name): pieces of
    whole lines, a small file in one piece.  Texts are read and sanitized once, for both; all sanitized
    pieces stay in ``out/_pieces``, which readers of ``out`` skip, and may be deleted.
    With ``mode='document'``, for private keys over several lines, every file is one piece (below 2 GiB).
    """
    log = dict(extensions=fixed.LOG_EXTENSIONS, allow_no_suffix=True)
    if mode == "document":
        texts = files.read_texts(spark, path, recursive, **log).withColumn("first_line", F.lit(1).cast("bigint"))
        if out:
            _named(sanitize_changed(texts, "text", types, key, mode)).write.parquet(out)
        return sanitize_stats(texts, "text", types)
    pieces = ranges.read_text_pieces(spark, path, recursive, **log, range_bytes=range_bytes)
    if not out:
        return sanitize_stats(pieces, "text", types)
    done = sanitize_pieces(pieces, "text", types, key)
    done.write.parquet(f"{out}/_pieces")
    done = spark.read.schema(done.schema).parquet(f"{out}/_pieces")
    changed = done.filter("lines_modified > 0").select("file").distinct()
    _named(done.join(changed, "file", "left_semi")).write.mode("append").parquet(out)
    return pieces_stats(done, types)


def _named(pieces: DataFrame) -> DataFrame:
    return pieces.select("file", "first_line", "text", output_name(F.col("file"), "_sanitized").alias("output_name"))


def output_name(path: Column, suffix: str) -> Column:
    """``<folder>/<stem><suffix><extension>``; files without an extension get .log."""
    ext = F.regexp_extract(path, r"(?s)[^/](\.[^./]+)$", 1)
    stem = F.left(path, F.length(path) - F.length(ext))
    return F.concat(stem, F.lit(suffix), F.when(ext == "", ".log").otherwise(ext))


def anonymize_csv(spark: SparkSession, path: str, out: str, plan: dict[str, str] | None = None,
                  encoding: str = "UTF-8", key: str = "") -> dict[str, str]:
    """Anonymize a CSV file into a folder of CSV files; returns the plan that was used."""
    df = tables.read_csv_strings(spark, path, encoding)
    plan = infer_column_plan(df) if plan is None else plan
    tables.write_csv(anonymize(df, plan, key), out)
    return plan


def manifest(spark: SparkSession, folder: str, recursive: bool = False,
             algorithm: str = "sha256") -> DataFrame:
    """rel_path, length, algorithm and digest of the files in a folder, by path."""
    found = files.file_inventory(spark, folder, recursive).select("path")
    spread = found.repartition(spark.sparkContext.defaultParallelism, "path")
    # Written before sorting: sampling for the sort would read all files again.
    digests = materialized(files.digest_files(spread, "path", algorithm).drop("bytes_read"), "digests")
    return digests.select(
        _relative(folder).alias("rel_path"), "length", F.lit(algorithm).alias("algorithm"),
        "digest",
    ).orderBy("rel_path")


def _relative(folder: str) -> Column:
    return F.substring(F.col("path"), len(folder.rstrip("/")) + 2, 2**31 - 1)


def compare_files(spark: SparkSession, left: str, right: str, recursive: bool = True,
                  algorithm: str = "sha256") -> DataFrame:
    """Compare two folders by relative path; only same-size pairs are read and hashed."""
    sides = {}
    for side, folder in (("left", left), ("right", right)):
        sides[side] = files.file_inventory(spark, folder, recursive).select(
            _relative(folder).alias("rel_path"),
            F.col("path").alias(f"{side}_path"), F.col("length").alias(f"{side}_length"),
        )
    pairs = sides["left"].join(sides["right"], "rel_path", "full_outer")
    same_size = pairs.filter("left_length = right_length")
    wanted = same_size.select(F.explode(F.array("left_path", "right_path")).alias("path")).repartition(
        4 * spark.sparkContext.defaultParallelism, "path")
    digests = materialized(
        files.digest_files(wanted, "path", algorithm).select("path", "digest"), "digests"
    )
    for side in sides:
        pairs = pairs.join(
            digests.select(F.col("path").alias(f"{side}_path"),
                           F.col("digest").alias(f"{side}_digest")),
            f"{side}_path", "left",
        )
    status = (
        F.when(F.col("right_path").isNull(), "LEFT_ONLY")
        .when(F.col("left_path").isNull(), "RIGHT_ONLY")
        .when(F.col("left_digest") == F.col("right_digest"), "IDENTICAL")
        .otherwise("DIFFERENT")
    )
    return pairs.select("rel_path", "left_length", "right_length", status.alias("status"))


def verify_files(spark: SparkSession, folder: str, expected: DataFrame, recursive: bool = True,
                 algorithm: str = "sha256") -> DataFrame:
    """Check the files of a folder against expected digests: rel_path, ``expected`` and, if there is one, ``length``.

    One row per expected file, as in :func:`~cloakframe.operators.fingerprint.verify`.  Only expected files
    of the expected size are read.
    """
    found = files.file_inventory(spark, folder, recursive).select(
        _relative(folder).alias("rel_path"), "path", F.col("length").alias("_size"))
    wanted = materialized(prints.wanted_digests(expected, ["rel_path"], algorithm).join(found, "rel_path", "left").withColumns({
        "present": F.col("path").isNotNull(), "same_size": F.col("_size") == F.col("expected_length")}), "expected")
    read = wanted.filter("present and coalesce(same_size, true)")
    digests = None
    for kind in sorted(r.algorithm for r in read.select("algorithm").distinct().collect() if r.algorithm):
        own = read.filter(F.col("algorithm") == kind).repartition(4 * spark.sparkContext.defaultParallelism, "path")
        rows = files.digest_files(own, "path", kind).select("path", F.lit(kind).alias("algorithm"), F.col("digest").alias("actual"))
        digests = rows if digests is None else digests.union(rows)
    if digests is None:
        return prints.verify_digests(wanted.withColumn("actual", F.lit(None).cast("string")), ["rel_path"])
    return prints.verify_digests(wanted.join(digests, ["path", "algorithm"], "left"), ["rel_path"])


def verify_manifest(spark: SparkSession, folder: str, manifest_path: str, algorithm: str = "sha256") -> DataFrame:
    """:func:`verify_files` against a manifest written by :func:`~cloakframe.sources.tables.write_manifest`."""
    return verify_files(spark, folder, tables.read_manifest(spark, manifest_path).withColumnRenamed("digest", "expected"),
                        algorithm=algorithm)


def identical_files(spark: SparkSession, path: str | Sequence[str], recursive: bool = True,
                    algorithm: str = "sha256", head: int = _HEAD) -> DataFrame:
    """Groups of files with the same content: path, length, digest, copies, first_path, bytes_read; a row per member.

    Identity in stages: files of a size of their own are not read, the others by their first ``head`` bytes,
    and whole ones only where size and head still agree.  The groups are those of hashing all files.
    """
    found = materialized(files.file_inventory(spark, path, recursive).select("path", "length"), "inventory")
    parts = 4 * spark.sparkContext.defaultParallelism

    def tied(rows: DataFrame, on: list[str]) -> DataFrame:
        several = rows.groupBy(*on).agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
        return heavy_join(rows, several, on, "inner")

    same_size = materialized(tied(found, ["length"]).select("path", "length"), "same-size")
    heads = files.digest_files(same_size.repartition(parts, "path"), "path", algorithm, head).select(
        "path", F.col("length").isNotNull().alias("whole"), F.col("digest").alias("head"), "bytes_read")
    headed = materialized(same_size.join(heads, "path"), "heads")
    same_head = materialized(tied(headed, ["length", "head"]), "same-head")
    rest = same_head.filter("not whole")
    full = files.digest_files(rest.repartition(parts, "path"), "path", algorithm).select(
        "path", F.col("digest").alias("full"), F.col("bytes_read").alias("more"))
    known = materialized(same_head.join(full, "path", "left").select(
        "path", "length", F.coalesce("full", "head").alias("digest"),
        (F.col("bytes_read") + F.coalesce("more", F.lit(0))).alias("bytes_read")), "identity")
    groups = known.groupBy("length", "digest").agg(
        F.count("*").alias("copies"), F.min("path").alias("first_path")).filter("copies > 1")
    return heavy_join(known, groups, ["length", "digest"], "inner").select(
        "path", "length", "digest", "copies", "first_path", "bytes_read")


def file_properties(spark: SparkSession, path: str | Sequence[str],
                    recursive: bool = False) -> DataFrame:
    """Property rows (scope 'os') of the files of a folder: size, times, permissions, or an error."""
    found = files.file_inventory(spark, path, recursive)
    stats = files.stat_files(found.repartition(4 * spark.sparkContext.defaultParallelism, "path"))
    return os_properties(found.join(stats, "path", "left"))
