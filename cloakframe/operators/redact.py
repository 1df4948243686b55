"""Remove literal and pattern hits from paged text."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cloakframe.functions.dialect import java_pattern, quote
from cloakframe.functions.matching import gaps, hits, let, name, running, starts, text
from cloakframe.operators.detect import explode_lines

_SHOWN = 40


def fill_of(fill: str) -> str:
    if len(fill) > 1:
        raise ValueError("fill must be one character or empty")
    return fill


def page_filter(page: Column, pages: Iterable[int] | None) -> Column:
    """Whether a page is selected; numbers that do not exist select nothing."""
    return F.lit(True) if pages is None else page.isin(*sorted(set(pages)))


def _regexes(terms: Sequence[str], patterns: Sequence[str]) -> list[tuple[str, str]]:
    """(what was asked for, Java expression); terms ignore case, patterns do not."""
    if not terms and not patterns:
        raise ValueError("give at least one term or pattern")
    for t in terms:
        if not t or "\n" in t:
            raise ValueError(f"a term must be one non-empty line: {t!r}")
    for p in patterns:
        if re.compile(p).search(""):
            raise ValueError(f"a pattern must not match the empty string: {p!r}")
    return [(t, java_pattern(quote(t), ignore_case=True)) for t in terms] + [
        (p, java_pattern(p)) for p in patterns
    ]


def _any_hit(source: str, regexes: list[tuple[str, str]]) -> str:
    return "(" + " or ".join(f"{source} rlike {text(r)}" for _, r in regexes) + ")"


def _spans(source: str, regex: str) -> str:
    placed = (
        f"zip_with(hs, {starts('hs', 'gs')}, "
        "(hit, start) -> named_struct('s', start, 'e', start + length(hit)))"
    )
    return let(hits(source, regex), "hs", let(gaps(source, regex), "gs", placed))


def _cut(source: str, regexes: list[tuple[str, str]], fill: str, granularity: str) -> str:
    """The line without its hits.  Overlapping hits are merged before anything is cut."""
    if granularity == "line":
        return f"repeat({text(fill)}, length({source}))"
    return covered(source, f"array_sort(concat({', '.join(_spans(source, r) for _, r in regexes)}))", fill)


def covered(source: str, found: str, fill: str) -> str:
    """SQL text for ``source`` without the sorted spans (s, e) of the array ``found``, which may overlap."""
    ends = running("transform(found, f -> f.e)", "greatest({a}, {x})")
    before = "if(k > 0, ends_so_far[k - 1], 1)"
    piece = (
        f"concat(substring({source}, {before}, greatest(f.s - {before}, 0)), "
        f"repeat({text(fill)}, greatest(f.e - greatest(f.s, {before}), 0)))"
    )
    whole = (
        f"concat(array_join(transform(found, (f, k) -> {piece}), ''), "
        f"substring({source}, ends_so_far[size(ends_so_far) - 1]))"
    )
    return let(found, "found", let(ends, "ends_so_far", whole))


def redacted(column: str, terms: Sequence[str] = (), patterns: Sequence[str] = (),
             fill: str = "█", granularity: str = "match") -> Column:
    """The text with every hit covered by ``fill`` per character ('' removes it).

    Hits are searched in the original line by line; ``granularity='line'``
    covers every line that has a hit.
    """
    if granularity not in ("match", "line"):
        raise ValueError(f"granularity must be 'match' or 'line', not {granularity!r}")
    fill_of(fill)
    regexes = _regexes(terms, patterns)
    cut = _cut("line", regexes, fill, granularity)
    lines = (
        f"transform(split({name(column)}, chr(10), -1), "
        f"line -> if({_any_hit('line', regexes)}, {cut}, line))"
    )
    return F.expr(f"array_join({lines}, chr(10))")


def redact(df: DataFrame, column: str, terms: Sequence[str] = (), patterns: Sequence[str] = (),
           page: str | None = None, pages: Iterable[int] | None = None, fill: str = "█",
           granularity: str = "match") -> DataFrame:
    """Redact a text column on the selected pages, in place."""
    new = redacted(column, terms, patterns, fill, granularity)
    if page is None or pages is None:
        return df.withColumn(column, new)
    chosen = page_filter(F.col(page), pages)
    return df.withColumn(column, F.when(chosen, new).otherwise(F.col(column)))


def redact_preview(df: DataFrame, column: str, terms: Sequence[str] = (),
                   patterns: Sequence[str] = (), page: str | None = None,
                   pages: Iterable[int] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """What would be removed: kept columns, line_no, wanted, column, found (cut to 40)."""
    regexes = _regexes(terms, patterns)
    if page is not None:
        df = df.filter(page_filter(F.col(page), pages))
    lines = explode_lines(df, column, keep, where=None).filter(
        F.expr(_any_hit("line", regexes))
    )
    per_term = ", ".join(
        f"named_struct('wanted', {text(w)}, 'hits', {hits('line', r)}, 'gaps', {gaps('line', r)})"
        for w, r in regexes
    )
    found = lines.select(*keep, "line_no", F.expr(f"inline(array({per_term}))"))
    rows = found.select(*keep, "line_no", "wanted", F.inline(F.expr(
        f"zip_with(hits, {starts('hits', 'gaps')}, "
        "(hit, start) -> named_struct('column', start, 'found', hit))"
    )))
    trimmed = F.trim("found")
    return rows.withColumn("found", F.concat(
        F.left(trimmed, F.lit(_SHOWN)), F.when(F.length(trimmed) > _SHOWN, "...").otherwise("")
    ))


def redact_stats(df: DataFrame, column: str, terms: Sequence[str] = (),
                 patterns: Sequence[str] = (), page: str | None = None,
                 pages: Iterable[int] | None = None) -> DataFrame:
    """One row: pages processed, pages with hits, hits.  Counted on the original text."""
    regexes = _regexes(terms, patterns)
    if page is not None:
        df = df.filter(page_filter(F.col(page), pages))
    lines = f"split({name(column)}, chr(10), -1)"
    in_line = " + ".join(f"size({hits('line', r)})" for _, r in regexes)
    n = (
        f"aggregate({lines}, 0L, (n, line) -> "
        f"n + if({_any_hit('line', regexes)}, {in_line}, 0))"
    )
    return df.select(F.expr(n).alias("n")).agg(
        F.count("*").alias("pages_processed"),
        F.count_if(F.col("n") > 0).alias("pages_with_redactions"),
        F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("total_redactions"),
    )
