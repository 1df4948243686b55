"""File properties as rows (path, file_type, scope, key, value): grade, clear, check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cloakframe.functions import fixed_values as fixed
from cloakframe.functions.formatting import file_type, format_size, risk_level
from cloakframe.functions.validators import is_present


def os_properties(inventory: DataFrame) -> DataFrame:
    """Property rows of each file of an inventory: size and time, and what other columns of it tell.

    ``accessed``, ``created``, ``permissions`` and ``error`` (see ``stat_files``) are used where they are; Spark's own
    sources do not know them.  A property without a value is left out.
    """
    def moment(column: str) -> Column:
        return F.date_format(column, "yyyy-MM-dd HH:mm:ss")

    known = {"File Size": format_size("length"), "Last Modified": moment("modificationTime")}
    for key, column in (("Last Accessed", "accessed"), ("Created", "created")):
        if column in inventory.columns:
            known[key] = moment(column)
    for key, column in (("Permissions", "permissions"), ("Error", "error")):
        if column in inventory.columns:
            known[key] = F.col(column)
    pairs = F.array(*[F.struct(F.lit(key).alias("key"), value.alias("value")) for key, value in known.items()])
    return inventory.select(
        "path", file_type(F.col("path")).alias("file_type"), F.lit("os").alias("scope"),
        F.inline(F.filter(pairs, lambda p: p["value"].isNotNull())),
    )


def with_risk(props: DataFrame, split_camel: bool = False) -> DataFrame:
    return props.withColumn("risk", risk_level(F.col("key"), F.col("value"), split_camel))


def _rank() -> Column:
    level = risk_level(F.col("key"), F.col("value"))
    ranks = F.when(level == "high", 2).when(level == "medium", 1).otherwise(0)
    return F.when(F.col("scope") == "format", ranks).otherwise(0)


def file_risk(props: DataFrame, inventory: DataFrame | None = None) -> DataFrame:
    """Worst grade among the format properties of each path; none means low.

    Files of ``inventory`` (column path, unique) without any property are low too.
    """
    worst = props.groupBy("path").agg(F.max(_rank()).alias("rank"))
    if inventory is not None:
        worst = worst.join(inventory.select("path"), "path", "full_outer")
    name = F.when(F.col("rank") == 2, "high").when(F.col("rank") == 1, "medium").otherwise("low")
    return worst.select("path", name.alias("risk"))


def risk_summary(props: DataFrame, inventory: DataFrame | None = None) -> DataFrame:
    """One row: files scanned and files by worst grade (low counts as clean)."""
    return file_risk(props, inventory).agg(
        F.count("*").alias("files_scanned"),
        F.count_if(F.col("risk") == "high").alias("high_risk"),
        F.count_if(F.col("risk") == "medium").alias("medium_risk"),
        F.count_if(F.col("risk") == "low").alias("clean"),
    )


def is_sensitive_tag(key: Column) -> Column:
    return key.isin(*fixed.SENSITIVE_IMAGE_TAGS)


def sensitive_tag_counts(props: DataFrame) -> DataFrame:
    """Number of distinct sensitive tags per path; paths without any have 0."""
    tags = [
        F.max(F.when(F.col("key") == t, 1).otherwise(0)) for t in fixed.SENSITIVE_IMAGE_TAGS
    ]
    return props.groupBy("path").agg(sum(tags, F.lit(0)).cast("bigint").alias("sensitive_tags"))


def present_properties(props: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Rows of the given names (default: document properties) that are not blank."""
    if names is None:
        names = (*fixed.CORE_PROPERTIES, "revision", *fixed.DATE_PROPERTIES)
    return props.filter(F.col("key").isin(*names) & is_present(F.col("value")))


def _core_names(strict: bool) -> tuple[str, ...]:
    return fixed.CORE_PROPERTIES + (("creator", "company") if strict else ())


def _is_cleared(strict: bool) -> Column:
    key, value = F.col("key"), F.col("value")
    core = key.isin(*_core_names(strict)) & is_present(value)
    dates = key.isin(*fixed.DATE_PROPERTIES) & value.isNotNull()
    return F.coalesce(core | (key == "revision") | dates, F.lit(False))


def clear_properties(props: DataFrame, strict: bool = False) -> DataFrame:
    """Document properties emptied, the revision set to 1, dates made neutral.

    ``strict`` clears creator and company too.
    """
    key = F.col("key")
    new = (
        F.when(key == "revision", fixed.NEUTRAL_REVISION)
        .when(key.isin(*fixed.DATE_PROPERTIES), fixed.NEUTRAL_DATE)
        .otherwise("")
    )
    return props.withColumn("value", F.when(_is_cleared(strict), new).otherwise(F.col("value")))


def clear_stats(props: DataFrame, strict: bool = False) -> DataFrame:
    """Properties cleared per path; a revision counts even if it is 1 already."""
    return props.groupBy("path").agg(
        F.count_if(_is_cleared(strict)).alias("properties_cleared")
    )


def clear_summary(props: DataFrame, strict: bool = False) -> DataFrame:
    """One row: files processed, files changed, properties cleared."""
    return clear_stats(props, strict).agg(
        F.count("*").alias("files_processed"),
        F.count_if(F.col("properties_cleared") > 0).alias("files_cleaned"),
        F.coalesce(F.sum("properties_cleared"), F.lit(0).cast("bigint"))
        .alias("properties_cleared"),
    )


def clear_all(props: DataFrame, fields: Sequence[str] = fixed.PDF_PROPERTIES) -> DataFrame:
    """Every listed field emptied."""
    listed = F.col("key").isin(*fields)
    return props.withColumn("value", F.when(listed, "").otherwise(F.col("value")))


def still_dirty(props: DataFrame, fields: Sequence[str] = fixed.PDF_PROPERTIES) -> DataFrame:
    """Whether any listed field still has a value, per path."""
    left = F.coalesce(F.col("key").isin(*fields) & (F.col("value") != ""), F.lit(False))
    return props.groupBy("path").agg(F.bool_or(left).alias("dirty"))


def wipe_summary(props: DataFrame, fields: Sequence[str] = fixed.PDF_PROPERTIES) -> DataFrame:
    """One row after clearing: files in all, cleaned, failed."""
    return still_dirty(props, fields).agg(
        F.count("*").alias("total"),
        F.count_if(~F.col("dirty")).alias("cleaned"),
        F.count_if("dirty").alias("failed"),
    )


def drop_comments(items: DataFrame, comments: DataFrame, key: Sequence[str]) -> DataFrame:
    """Items that are not listed as comments."""
    return items.join(comments.select(*key), list(key), "left_anti")


def comment_counts(comments: DataFrame) -> DataFrame:
    return comments.groupBy("path").agg(F.count("*").alias("comments_removed"))
