"""Tables as sources and sinks: parquet, all-string CSV, reports and manifests."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cloakframe.operators.detect import without_raw_values, with_masks
from cloakframe.operators.properties import with_risk
from cloakframe.operators.sanitize import sanitize_changed
from cloakframe.operators.spread import spread_join
from cloakframe.sources.files import file_inventory
from cloakframe.sources.ranges import RANGE, read_csv_ranges

_PROPERTIES_PER_LINE = 4096


def read_table(spark: SparkSession, folder: str, name: str, spread: bool = False) -> DataFrame:
    """A parquet table.

    ``spread`` is for costly work per row: input with fewer splits than there are
    cores (less than one split of data per core) is spread over all of them, so
    that one small file does not keep one core busy with all expressions.  Larger
    input is read as it lies, without a shuffle.
    """
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if spread and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def read_csv_strings(spark: SparkSession, path: str, encoding: str = "UTF-8",
                     na_values: Sequence[str] = (), range_bytes: int = RANGE) -> DataFrame:
    """CSV with a header, every column as a string; ``na_values`` become null.

    Files of any size are read in byte ranges, as UTF-8 or else Latin-1 (see
    :func:`~cloakframe.sources.ranges.read_csv_ranges`).  Compressed files, and other encodings
    named, are read by Spark's own reader, a file a task.
    """
    packed = F.lower("path").rlike(r"\.(gz|bz2|zst|lz4|snappy|deflate)$")
    if encoding.upper() == "UTF-8" and file_inventory(spark, path, True).filter(packed).isEmpty():
        df = read_csv_ranges(spark, path, range_bytes)
    else:
        df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"',
                            encoding=encoding)
    if na_values:
        df = df.withColumns({
            c: F.when(~F.col(c).isin(*na_values), F.col(c)) for c in df.columns
        })
    return df


def column_names(df: DataFrame) -> list[str]:
    """The header only; no row is read."""
    return df.columns


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header; quotes inside values are doubled, outer blanks stay."""
    df.write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_findings_json(findings: DataFrame, summary: DataFrame, path: str,
                        include_raw: bool = False) -> None:
    """JSON lines in ``path/findings`` and the summary in ``path/summary``.

    Values are masked, also in the context, unless ``include_raw``.
    """
    rows = with_masks(findings) if include_raw else without_raw_values(findings)
    rows.write.json(f"{path}/findings")
    summary.write.json(f"{path}/summary")


def write_sanitized(df: DataFrame, text: str, path: str, types: Iterable[str] | None = None,
                    key: str = "") -> None:
    """Sanitize and write, as parquet, only the rows whose text changed."""
    sanitize_changed(df, text, types, key).write.parquet(path)


def write_manifest(manifest: DataFrame, path: str, algorithm: str = "sha256",
                   directory: str = "") -> None:
    """Text files of ``digest  path`` lines in path order, and a header file."""
    manifest.select(F.concat_ws("  ", "digest", "rel_path")).write.text(f"{path}/lines")
    counted = manifest.agg(F.count("*").alias("n")).select(F.explode(F.array(
        F.lit(f"# {algorithm.upper()} manifest"),
        F.lit(f"# Directory: {directory}"),
        F.concat(F.lit("# Files: "), F.col("n").cast("string")),
    )))
    counted.write.text(f"{path}/header")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """rel_path and digest from manifest text below ``path``; comments are skipped."""
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    value: Column = F.col("value")
    return lines.filter(~value.startswith("#") & (value != "")).select(
        F.regexp_extract(value, "^([0-9a-fA-F]+)  (.*)$", 2).alias("rel_path"),
        F.lower(F.regexp_extract(value, "^([0-9a-fA-F]+)  (.*)$", 1)).alias("digest"),
    )


def metadata_objects(props: DataFrame, per_line: int = _PROPERTIES_PER_LINE) -> DataFrame:
    """path, part, file_type, os_metadata, format_metadata, fields as maps.

    Where both scopes have a key, ``fields`` has the value of the format.  A path
    with more than ``per_line`` keys continues in further parts, so that no group
    grows without bound.
    """
    rank = F.when(F.col("scope") == "format", 1).otherwise(0)
    keys = with_risk(props).groupBy("path", "key").agg(
        F.max("file_type").alias("file_type"),
        F.max(F.when(F.col("scope") == "os", F.col("value"))).alias("os_value"),
        F.max(F.when(F.col("scope") == "format", F.col("value"))).alias("format_value"),
        F.max_by(F.struct("value", "risk"), rank).alias("field"),
    )
    parts = keys.groupBy("path").agg(F.ceil(F.count("*") / per_line).alias("parts"))
    numbered = spread_join(keys, parts, ["path"], "inner").withColumn(
        "part", F.pmod(F.xxhash64("key"), F.col("parts"))
    )

    def as_map(value: Column) -> Column:
        entries = F.collect_list(F.when(value.isNotNull(), F.struct("key", value)))
        return F.map_from_entries(F.array_sort(entries))

    return numbered.groupBy("path", "part").agg(
        F.max("file_type").alias("file_type"),
        as_map(F.col("os_value")).alias("os_metadata"),
        as_map(F.col("format_value")).alias("format_metadata"),
        as_map(F.col("field")).alias("fields"),
    )


def write_metadata_json(props: DataFrame, path: str) -> None:
    """One JSON object per path, see :func:`metadata_objects`."""
    metadata_objects(props).write.json(path)
