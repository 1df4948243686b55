"""Find personal data in text columns: findings, masks, reports and counts."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cloakframe.functions.matching import gaps, hits, let, name, starts, strip, text
from cloakframe.functions.patterns import DETECTORS, Pattern, choose, may_occur, may_occur_sql
from cloakframe.operators.spread import heavy_join
from cloakframe.sources.scratch import sealed

_AROUND = 20


def explode_lines(
    df: DataFrame, body: str, keep: Sequence[str] | None = None, where: str | None = None
) -> DataFrame:
    """One row per line of ``body``: kept columns, ``line_no`` from 1, ``line``.

    Rows that fail the SQL condition ``where`` give no lines.
    """
    kept = [c for c in df.columns if c != body] if keep is None else list(keep)
    lines = f"split({name(body)}, '\n', -1)"
    if where:
        lines = f"if({where}, {lines}, null)"
    return df.select(*kept, F.posexplode(F.expr(lines)).alias("pos", "line")).select(
        *kept, (F.col("pos") + 1).alias("line_no"), "line"
    )


def _hits_per_type(line: str, patterns: list[Pattern]) -> Column:
    """Array of (type, hits, gaps), only for the types with a hit in the line."""
    entries = [
        f"if({p.hint(line)}, "
        + let(hits(line, p.regex), "hs", f"if(size(hs) = 0, null, named_struct('type', "
              f"{text(p.name)}, 'hits', hs, 'gaps', {gaps(line, p.regex)}))")
        + ", null)"
        for p in patterns
    ]
    return F.expr(f"array_compact(array({', '.join(entries)}))")


def _by_type(kind: Column, patterns: list[Pattern], value) -> Column:
    chosen = F.when(kind == patterns[0].name, value(patterns[0]))
    for p in patterns[1:]:
        chosen = chosen.when(kind == p.name, value(p))
    return chosen


def find_in_lines(lines: DataFrame, line: str, types: Iterable[str] | None = None) -> DataFrame:
    """Valid hits in single lines: all columns, type, description, value, column, context.

    Each hit of each type is a row; hits of different types may overlap.
    """
    patterns = choose(DETECTORS, types)
    per_type = lines.filter(may_occur(line, patterns)).select(
        "*", F.inline(_hits_per_type(name(line), patterns))
    )
    placed = per_type.select(
        *lines.columns, "type",
        F.inline(F.expr(
            f"zip_with(hits, {starts('hits', 'gaps')}, "
            "(hit, start) -> named_struct('value', hit, 'column', start))"
        )),
    ).filter(_by_type(F.col("type"), patterns, lambda p: p.valid(F.col("value"))))
    first = F.greatest(F.col("column") - _AROUND, F.lit(1))
    after = F.col("column") + F.length("value") + _AROUND
    return placed.select(
        *lines.columns, "type",
        _by_type(F.col("type"), patterns, lambda p: F.lit(p.description)).alias("description"),
        "value", "column", strip(F.substring(F.col(line), first, after - first)).alias("context"),
    )


def scan_text(
    df: DataFrame, body: str, types: Iterable[str] | None = None, keep: Sequence[str] | None = None
) -> DataFrame:
    """Findings in ``body``: kept columns, type, description, value, line, column, context.

    Texts and then lines that cannot hold a hit are dropped before any positions
    are computed; a hit in a line is a hit in the text, so none is lost.
    """
    suspect = may_occur_sql(name(body), choose(DETECTORS, types))
    lines = explode_lines(df, body, keep, where=suspect)
    kept = [c for c in lines.columns if c not in ("line_no", "line")]
    return find_in_lines(lines, "line", types).select(
        *kept, "type", "description", "value", F.col("line_no").alias("line"), "column", "context"
    )


def mask_value(value: Column, kind: Column) -> Column:
    """Short form of ``value`` for the type named in ``kind``."""
    masked = F.when(F.lit(False), value)
    for p in DETECTORS:
        masked = masked.when(kind == p.name, p.mask(value))
    return masked.otherwise(value)


def with_masks(findings: DataFrame) -> DataFrame:
    return findings.withColumn("value_masked", mask_value(F.col("value"), F.col("type")))


def without_raw_values(findings: DataFrame) -> DataFrame:
    """Masked values only.

    The context keeps the masked value; digits and addresses around it, which may
    belong to other findings, are blotted out.
    """
    marked = F.replace(F.col("context"), F.col("value"), F.lit("\x01"))
    blotted = F.regexp_replace(F.regexp_replace(marked, r"[^\s\x01]*@[^\s\x01]*", "***"), r"\p{Nd}", "#")
    return with_masks(findings).withColumn(
        "context", F.replace(blotted, F.lit("\x01"), F.col("value_masked"))
    ).drop("value")


def hit_counts(df: DataFrame, body: str, types: Iterable[str] | None = None,
               keep: Sequence[str] | None = None) -> DataFrame:
    """Number of valid hits per row, one column per type (lower-case name).

    Runs over the whole text with expressions that stay within lines, so no
    lines are exploded.
    """
    kept = [c for c in df.columns if c != body] if keep is None else list(keep)
    counts = [
        F.when(
            F.expr(p.occurs(name(body), whole_text=True)),
            F.size(F.filter(F.expr(hits(name(body), p.text_regex)), p.valid)),
        ).otherwise(0).cast("bigint").alias(p.name.lower())
        for p in choose(DETECTORS, types)
    ]
    return df.select(*kept, *counts)


def scan_summary(df: DataFrame, body: str, types: Iterable[str] | None = None) -> DataFrame:
    """One row: rows scanned, rows with a hit, hits in all, and hits per type as a map."""
    counts = hit_counts(df, body, types, keep=[])
    total = sum((F.col(c) for c in counts.columns), F.lit(0).cast("bigint"))
    sums = counts.select("*", total.alias("n")).agg(
        F.count("*").alias("rows_scanned"),
        F.count_if(F.col("n") > 0).alias("rows_with_hits"),
        F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("total_findings"),
        *[F.sum(c).alias(c) for c in counts.columns],
    )
    by_type = F.create_map(
        *[x for c in counts.columns for x in (F.lit(c.upper()), F.col(c))]
    )
    return sums.select(
        "rows_scanned", "rows_with_hits", "total_findings",
        F.map_filter(by_type, lambda _, n: n > 0).alias("types_found"),
    )


def count_by_type(findings: DataFrame) -> DataFrame:
    return findings.groupBy("type").agg(F.count("*").alias("n"))


def findings_counts(findings: DataFrame, file: str) -> DataFrame:
    """Number of findings per file and type."""
    return findings.groupBy(file, "type").agg(F.count("*").alias("instances"))


def findings_report(findings: DataFrame, file: str) -> DataFrame:
    """Masked findings in reading order, each with the count of its file and type.

    Rows, not one list per group: a single file may hold most of the findings.
    The masked findings are written once, as counting, joining and sorting would
    each scan all texts again; masks that show a value (addresses of hosts) lie there encrypted.
    """
    masked = sealed(
        with_masks(findings).select(file, "type", "line", "column", "value_masked"), "findings", ["value_masked"]
    )
    return (
        heavy_join(masked, findings_counts(masked, file), [file, "type"], "inner")
        .select(file, "type", "instances", "line", "column", "value_masked")
        .orderBy(file, "type", "line", "column")
    )
