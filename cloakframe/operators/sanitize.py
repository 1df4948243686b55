"""Replace secrets by stable placeholders, so that lines still correlate."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cloakframe.functions.keyed import digest_sql, under_key
from cloakframe.functions.matching import gaps, hits, let, name, stitch, text
from cloakframe.functions.patterns import SECRETS, Pattern, choose, may_occur, may_occur_sql
from cloakframe.operators.detect import explode_lines


def placeholder(value: Column, prefix: str, key: Column | None = None) -> Column:
    """``[PREFIX_xxxxxxxx]`` with eight hex digits of a digest of the value.

    A secret ``key``, a column, hinders guessing values back from their placeholders.
    """
    mark = F.md5(value) if key is None else F.sha2(F.concat(key, F.sha2(F.concat(key, value), 256)), 256)
    return F.concat(F.lit(f"[{prefix}_"), F.substring(mark, 1, 8), F.lit("]"))


def _placeholder_sql(value: str, prefix: str, key_column: str) -> str:
    return f"concat({text(f'[{prefix}_')}, substr({digest_sql(value, key_column)}, 1, 8), ']')"


def _replace(source: str, p: Pattern, key: str, whole_text: bool) -> str:
    regex = p.text_regex if whole_text else p.regex
    new = stitch(gaps(source, regex), "hs", "hit", _placeholder_sql("hit", p.prefix, key))
    replaced = let(hits(source, regex), "hs", f"if(size(hs) = 0, {source}, {new})")
    return f"if({p.hint(source)}, {replaced}, {source})"


def _replace_noted(state: str, p: Pattern, key: str) -> str:
    source = f"{state}.text"
    notes = (
        f"transform({hits(source, p.regex)}, hit -> named_struct('type', {text(p.name)}, "
        f"'original_length', length(hit), "
        f"'placeholder', {_placeholder_sql('hit', p.prefix, key)}))"
    )
    new = (
        f"named_struct('text', {stitch(gaps(source, p.regex), 'notes', 'n', 'n.placeholder')}, "
        f"'replacements', concat({state}.replacements, notes))"
    )
    replaced = let(notes, "notes", f"if(size(notes) = 0, {state}, {new})")
    return f"if({p.hint(source)}, {replaced}, {state})"


def sanitized(column: str, types: Iterable[str] | None = None, key_column: str = "",
              mode: str = "line") -> Column:
    """The column with every secret replaced, kind after kind, each on the result so far.

    A value may have many lines; secrets are found line by line.  With
    ``mode='document'``, private key blocks over several lines are replaced first.
    ``key_column`` names a column with a secret key (see ``functions/keyed.py``).
    """
    if mode not in ("line", "document"):
        raise ValueError(f"mode must be 'line' or 'document', not {mode!r}")
    patterns = choose(SECRETS, types)
    result = name(column)
    if mode == "document":
        for p in patterns:
            if p.name == "PRIVATE_KEY":
                result = _replace(result, p, key_column, False)
    for i, p in enumerate(patterns):
        result = let(result, f"t{i}", _replace(f"t{i}", p, key_column, True))
    return F.expr(f"if({may_occur_sql(name(column), patterns)}, {result}, {name(column)})")


_NOTES = "array<struct<type:string,original_length:int,placeholder:string>>"


def _noted_sql(source: str, patterns: list[Pattern], key: str) -> str:
    clean = f"named_struct('text', {source}, 'replacements', cast(array() as {_NOTES}))"
    result = clean
    for i, p in enumerate(patterns):
        result = let(result, f"s{i}", _replace_noted(f"s{i}", p, key))
    return f"if({may_occur_sql(source, patterns)}, {result}, {clean})"


def sanitized_with_notes(column: str, types: Iterable[str] | None = None,
                         key_column: str = "") -> Column:
    """For single lines: struct of the new text and the replacements in order."""
    return F.expr(_noted_sql(name(column), choose(SECRETS, types), key_column))


def sanitize(df: DataFrame, column: str, types: Iterable[str] | None = None, key: str = "",
             mode: str = "line") -> DataFrame:
    """Replace secrets in a text column, in place; works on streams too."""
    return under_key(df, key, lambda rows, k: rows.withColumn(column, sanitized(column, types, k, mode)))


def sanitize_changed(df: DataFrame, column: str, types: Iterable[str] | None = None,
                     key: str = "", mode: str = "line") -> DataFrame:
    """Sanitized rows, only those whose text changed.

    The new text comes out of a generator, below which no filter is pushed, so it is worked out once.
    """
    def change(rows: DataFrame, k: str) -> DataFrame:
        after = F.explode(F.array(sanitized(column, types, k, mode))).alias("_after")
        changed = rows.select("*", after).filter(F.col(column) != F.col("_after"))
        return changed.withColumn(column, F.col("_after")).drop("_after")

    return under_key(df, key, change)


def sanitize_noted(df: DataFrame, line: str, types: Iterable[str] | None = None,
                   key: str = "") -> DataFrame:
    """Like :func:`sanitize` for single lines, plus a ``replacements`` array."""
    state = under_key(df, key, lambda rows, k: rows.withColumn("_state", sanitized_with_notes(line, types, k)))
    return state.withColumns(
        {line: F.col("_state.text"), "replacements": F.col("_state.replacements")}
    ).drop("_state")


def sanitize_preview(df: DataFrame, body: str, keep: Sequence[str],
                     types: Iterable[str] | None = None) -> DataFrame:
    """What would be replaced: kept columns, line_no, step, type, original_length, placeholder.

    ``step`` counts the replacements of a line in order of application, from 1.
    """
    patterns = choose(SECRETS, types)
    lines = explode_lines(df, body, keep, where=may_occur_sql(name(body), patterns))
    noted = lines.filter(may_occur("line", patterns)).select(
        *keep, "line_no",
        F.posexplode(sanitized_with_notes("line", types)["replacements"]).alias("step", "r"),
    )
    return noted.select(*keep, "line_no", (F.col("step") + 1).alias("step"), "r.*")


def sanitize_stats(df: DataFrame, body: str, types: Iterable[str] | None = None) -> DataFrame:
    """One row: lines, lines modified, replacements and replacements per type as a map.

    Only suspect lines of suspect texts are exploded, in the same pass that
    counts all lines.
    """
    patterns = choose(SECRETS, types)
    source = name(body)
    suspect = (
        f"if({may_occur_sql(source, patterns)}, filter(split({source}, '\n', -1), "
        f"line -> {may_occur_sql('line', patterns)}), null)"
    )
    lines = df.select(
        F.expr(f"length({source}) - length(replace({source}, '\n')) + 1").alias("n_lines"),
        F.posexplode_outer(F.expr(suspect)).alias("pos", "line"),
    )
    noted = lines.select(
        F.expr("cast(if(coalesce(pos, 0) = 0, n_lines, 0) as bigint)").alias("n_lines"),
        sanitized_with_notes("line", types)["replacements"].alias("r"),
    )
    names = [p.name for p in patterns]
    counts = [
        f"coalesce(sum(if(size(r) > 0, size(filter(r, x -> x.type = {text(n)})), 0)), 0L) "
        f"as {name(n)}"
        for n in names
    ]
    sums = noted.selectExpr(
        "coalesce(sum(n_lines), 0L) as total_lines",
        "count_if(size(r) > 0) as lines_modified",
        "coalesce(sum(if(r is null, 0, size(r))), 0L) as total_replacements",
        *counts,
    )
    by_type = ", ".join(f"{text(n)}, {name(n)}" for n in names)
    return sums.selectExpr(
        "total_lines", "lines_modified", "total_replacements",
        f"map_filter(map({by_type}), (k, n) -> n > 0) as type_counts",
    )


def sanitize_pieces(df: DataFrame, body: str, types: Iterable[str] | None = None, key: str = "") -> DataFrame:
    """``df`` sanitized, with total_lines, lines_modified and ``kinds``, the type of each replacement.

    One pass for texts and counts; lines are looked at singly only in texts that may hold a secret.
    """
    patterns, source = choose(SECRETS, types), name(body)

    def noted(rows: DataFrame, k: str) -> DataFrame:
        lines = f"transform(split({source}, '\n', -1), line -> {_noted_sql('line', patterns, k)})"
        return rows.select("*", F.explode(F.array(F.expr(
            f"if({may_occur_sql(source, patterns)}, {lines}, null)"))).alias("_notes"))

    notes = under_key(df, key, noted)
    return notes.withColumns({
        "total_lines": F.expr(f"cast(length({source}) - length(replace({source}, '\n')) + 1 as bigint)"),
        "lines_modified": F.expr("cast(coalesce(size(filter(_notes, n -> size(n.replacements) > 0)), 0) as bigint)"),
        "kinds": F.expr("coalesce(flatten(transform(_notes, n -> n.replacements.type)), cast(array() as array<string>))"),
        body: F.expr(f"if(_notes is null, {source}, array_join(transform(_notes, n -> n.text), '\n'))"),
    }).drop("_notes")


def pieces_stats(pieces: DataFrame, types: Iterable[str] | None = None) -> DataFrame:
    """The row of :func:`sanitize_stats` from what :func:`sanitize_pieces` counted."""
    names = [p.name for p in choose(SECRETS, types)]
    sums = pieces.agg(
        F.coalesce(F.sum("total_lines"), F.lit(0).cast("bigint")).alias("total_lines"),
        F.coalesce(F.sum("lines_modified"), F.lit(0).cast("bigint")).alias("lines_modified"),
        F.coalesce(F.sum(F.size("kinds")), F.lit(0).cast("bigint")).alias("total_replacements"),
        *[F.expr(f"coalesce(sum(size(filter(kinds, k -> k = {text(n)}))), 0L)").alias(n) for n in names])
    by_type = F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])
    return sums.select("total_lines", "lines_modified", "total_replacements",
                       F.map_filter(by_type, lambda _, n: n > 0).alias("type_counts"))
