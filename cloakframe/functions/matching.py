"""Find every hit of an expression in a string column, with positions, JVM-side.

For an expression that never matches the empty string, ``split`` gives the gaps
around the hits of ``regexp_extract_all``: one gap more than hits.  Positions,
computed replacements and counts all follow from these two arrays.

The helpers build SQL expression text for ``F.expr``: a deep expression is then
one call into the JVM instead of hundreds.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from cloakframe.functions.dialect import SPACES

_BLOCK = 256


def name(column: str) -> str:
    """A column name as SQL text."""
    return "`" + column.replace("`", "``") + "`"


def text(value: str) -> str:
    """A string literal as SQL text (under Spark's default rules for escapes)."""
    parts = [f"r'{part}'" if "\\" in part else f"'{part}'" for part in value.split("'")]
    return parts[0] if len(parts) == 1 else f"concat({', chr(39), '.join(parts)})"


def let(value: str, variable: str, body: str) -> str:
    """``body`` with ``variable`` bound to ``value``, which is evaluated once."""
    return f"transform(array({value}), {variable} -> {body})[0]"


def hits(source: str, regex: str) -> str:
    return f"regexp_extract_all({source}, {text(regex)}, 0)"


def gaps(source: str, regex: str) -> str:
    """What lies between the hits.

    Splitting by an expression compiles it again for every row, so hits are first
    replaced by a mark that splits fast; texts that hold the mark are split directly.
    """
    marked = f"split(regexp_replace({source}, {text(regex)}, chr(1)), chr(1), -1)"
    return f"if(contains({source}, chr(1)), split({source}, {text(regex)}, -1), {marked})"


def stitch(gap_array: str, values: str, variable: str, new_value: str) -> str:
    """Text from gaps, with ``new_value`` of each of ``values`` between them."""
    return (
        f"array_join(zip_with({gap_array}, {values}, "
        f"(gap, {variable}) -> concat(gap, coalesce({new_value}, ''))), '')"
    )


def strip(value: Column) -> Column:
    """Remove Unicode blanks at both ends."""
    return F.regexp_replace(value, f"^{SPACES}+|{SPACES}+$", "")


def running(values: str, step: str) -> str:
    """Inclusive running fold of an int array from 0; ``step`` is SQL text over {a} and {x}.

    Works block by block: growing one long array element by element would take
    quadratic time for a text with very many hits.
    """
    into = step.format(a="acc.t", x="x")

    def fold(items: str, first: str) -> str:
        return (
            f"aggregate({items}, named_struct('t', {first}, 'l', cast(array() as array<int>)), "
            f"(acc, x) -> named_struct('t', {into}, 'l', concat(acc.l, array({into})))).l"
        )

    blocks = (
        f"transform(sequence(0, cast((size(v) - 1) div {_BLOCK} as int)), "
        f"b -> slice(v, b * {_BLOCK} + 1, {_BLOCK}))"
    )
    ends = fold(f"transform(bs, b -> aggregate(b, 0, (a, x) -> {step.format(a='a', x='x')}))", "0")
    each = f"flatten(transform(bs, (b, i) -> {fold('b', 'if(i > 0, ends[i - 1], 0)')}))"
    long = let(blocks, "bs", let(ends, "ends", each))
    return let(values, "v", f"if(size(v) <= {_BLOCK}, {fold('v', '0')}, {long})")


def starts(hit_array: str, gap_array: str) -> str:
    """Where each hit begins, from 1, in code points; for columns of hits and gaps."""
    steps = (
        f"transform({hit_array}, (one, at) -> "
        f"length({gap_array}[at]) + if(at > 0, length({hit_array}[at - 1]), 0))"
    )
    return f"transform({running(steps, '{a} + {x}')}, before -> before + 1)"
