"""Fakes of which no two originals share one.

The different values of a column are numbered, the number goes through a keyed permutation of
the kind's domain (a Feistel network over two digits of mixed size, in SQL), and the fake
is written from the permuted number.  Different numbers give different fakes; open domains
(names, cities, ...) grow with the count of values.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from cloakframe.functions.dialect import SPACES
from cloakframe.functions.keyed import digest_sql, under_key
from cloakframe.functions.matching import let, name, text
from cloakframe.functions.pseudonyms import (
    AGE_SPAN_DAYS, CITIES, COMPANY_FORMS, COMPANY_WORDS, FIRST_NAMES, LAST_NAMES, REFERENCE_DATE, STATES, STREETS,
    YOUNGEST_DAYS)
from cloakframe.operators.numbering import numbered
from cloakframe.operators.spread import heavy_join
from cloakframe.sources.scratch import materialized

ROUNDS = 6
_SYLLABLES = [c + v for c in "bdfgklmnprstvz" for v in "aeiou"]


def feistel(number: str, size: int, key_column: str = "", purpose: str = "") -> str:
    """SQL text for a keyed permutation of 0 to about ``size`` - 1: see :func:`reach`.

    A number is two digits, of base a and b; each round adds a keyed digest of one to the other.
    """
    a, b = _bases(size)
    state = f"named_struct('l', {number} div {b}, 'r', {number} % {b})"
    for i in range(ROUNDS):
        old = f"f{i}"
        moved, fixed, base = ("l", "r", a) if i % 2 == 0 else ("r", "l", b)
        mixed = digest_sql(f"concat({text(f'{purpose}:{i}:')}, cast({old}.{fixed} as string))", key_column)
        new = f"pmod({old}.{moved} + cast(conv(substr({mixed}, 1, 12), 16, 10) as bigint), {base}L)"
        parts = {moved: new, fixed: f"{old}.{fixed}"}
        state = let(state, old, f"named_struct('l', {parts['l']}, 'r', {parts['r']})")
    return let(state, "done", f"done.l * {b}L + done.r")


def _bases(size: int) -> tuple[int, int]:
    a = max(1, math.isqrt(size))
    return a, max(1, size // a)


def reach(size: int) -> int:
    """How many numbers the permutation of a domain of ``size`` covers: a product of two near its root."""
    a, b = _bases(size)
    return a * b


def _pick(values, number: str) -> str:
    return f"array({', '.join(text(v) for v in values)})[cast({number} as int)]"


def _syllables(number: str, count: int) -> str:
    base = len(_SYLLABLES)
    return "concat(" + ", ".join(
        _pick(_SYLLABLES, f"({number} div {base ** i}L) % {base}") for i in range(count)) + ")"


def _padded(number: str, width: int) -> str:
    return f"lpad(cast({number} as string), {width}, '0')"


@dataclass
class Domain:
    """How many fakes there are, and SQL text for the fake of a number below that."""

    size: int
    fake: Callable[[str], str]


def _with_syllables(base: int, count: int, plain: Callable[[str], str], joined: Callable[[str, str], str]) -> Domain:
    """A list of ``base`` values, followed by as many syllables as ``count`` values need."""
    more = 0
    while reach(base * len(_SYLLABLES) ** more) < count:
        more += 1
    if not more:
        return Domain(base, plain)
    return Domain(base * len(_SYLLABLES) ** more, lambda x: joined(
        plain(f"({x} % {base})"), f"initcap({_syllables(f'({x} div {base}L)', more)})"))


def _person(x: str) -> str:
    n = len(FIRST_NAMES)
    return f"concat_ws(' ', {_pick(FIRST_NAMES, f'{x} % {n}')}, {_pick(LAST_NAMES, f'{x} div {n}')})"


def domain(kind: str, count: int) -> Domain:
    """The domain of a kind for ``count`` different values; an error if the kind has fewer fakes."""
    def digits_for(base: int) -> int:
        return next(d for d in range(1, 20) if reach(base * 10 ** d) >= count)

    names = len(FIRST_NAMES) * len(LAST_NAMES)
    hyphen = lambda plain, more: f"concat({plain}, '-', {more})"
    if kind == "name":
        found = _with_syllables(names, count, _person, hyphen)
    elif kind == "email":
        wide = digits_for(names)
        found = Domain(names * 10 ** wide, lambda x: (
            f"concat(lower(replace({_person(f'({x} % {names})')}, ' ', '.')), "
            f"{_padded(f'{x} div {names}L', wide)}, '@example.com')"))
    elif kind == "phone":
        if count <= reach(80_000):
            found = Domain(80_000, lambda x: f"concat('(', cast(200 + {x} % 800 as string), ') 555-01', {_padded(f'{x} div 800', 2)})")
        else:
            found = Domain(800 * 800 * 10_000, lambda x: (
                f"concat('(', cast(200 + {x} % 800 as string), ') ', cast(200 + {x} div 800 % 800 as string), '-', "
                f"{_padded(f'{x} div 640000', 4)})"))
    elif kind == "ssn":
        found = Domain(10 ** 8, lambda x: (f"concat('9', {_padded(f'{x} % 100', 2)}, '-', {_padded(f'{x} div 100 % 100', 2)}, '-', "
                                           f"{_padded(f'{x} div 10000', 4)})"))
    elif kind == "address":
        wide = max(4, digits_for(len(STREETS)))
        found = Domain(len(STREETS) * 10 ** wide, lambda x: (
            f"concat(cast(1 + {x} div {len(STREETS)} as string), ' ', {_pick(STREETS, f'{x} % {len(STREETS)}')})"))
    elif kind == "city":
        found = _with_syllables(len(CITIES), count, lambda x: _pick(CITIES, x), hyphen)
    elif kind == "company":
        forms = len(COMPANY_FORMS)
        found = _with_syllables(
            len(COMPANY_WORDS) * forms, count,
            lambda x: f"concat_ws(' ', {_pick(COMPANY_WORDS, f'{x} div {forms}')}, {_pick(COMPANY_FORMS, f'{x} % {forms}')})",
            lambda plain, more: f"concat({more}, ' ', {plain})")
    elif kind == "state":
        found = Domain(len(STATES), lambda x: _pick(STATES, x))
    elif kind == "zip":
        found = Domain(10 ** 5, lambda x: _padded(x, 5)) if count <= reach(10 ** 5) else Domain(
            10 ** 9, lambda x: f"concat({_padded(f'{x} % 100000', 5)}, '-', {_padded(f'{x} div 100000', 4)})")
    elif kind == "date_of_birth":
        found = Domain(AGE_SPAN_DAYS, lambda x: (
            f"cast(date_sub(date'{REFERENCE_DATE}', cast({YOUNGEST_DAYS} + {x} as int)) as string)"))
    elif kind == "ip_address":
        found = Domain(1 << 24, lambda x: (
            f"concat_ws('.', '10', cast({x} div 65536 as string), cast({x} div 256 % 256 as string), cast({x} % 256 as string))"))
    elif kind == "credit_card":
        def card(x: str) -> str:
            check = "filter(sequence(0, 9), d -> luhn_check(concat(body, cast(d as string))))[0]"
            return let(f"concat('4', {_padded(x, 14)})", "body", f"concat(body, cast({check} as string))")

        found = Domain(10 ** 14, card)
    else:
        raise ValueError(f"no domain for {kind!r}")
    if reach(found.size) < count:
        raise ValueError(f"{count} different values of {kind!r}, but only {reach(found.size)} fakes")
    return found


def _bare(column: str) -> str:
    return f"lower(regexp_replace(cast({name(column)} as string), {text(f'^{SPACES}+|{SPACES}+$')}, ''))"


def _marked(df: DataFrame, column: str, key: str) -> DataFrame:
    """``df`` with ``_mark``, a digest of the normalized value, null for null and blank ones."""
    bare = _bare(column)
    return under_key(df, key, lambda rows, k: rows.withColumn(
        "_mark", F.expr(f"if({bare} != '', {digest_sql(bare, k)}, null)")))


def unique_fakes(df: DataFrame, column: str, kind: str, key: str = "") -> DataFrame:
    """``_mark`` and ``_fake``: the digest of each different normalized value, and a fake of its own.

    Only digests are stored.  The same table and secret ``key`` give the same fakes, another key gives others.
    """
    marks = _marked(df, column, key).select("_mark").filter("_mark is not null").distinct()
    found = materialized(numbered(marks, "_number", [F.col("_mark")]), "marks")
    made = domain(kind, max(1, found.count()))
    return under_key(found, key, lambda rows, k: rows.select("_mark", F.expr(
        let(feistel("_number", made.size, k, kind), "x", made.fake("x"))).alias("_fake"), *([k] if k else [])))


def anonymize_uniquely(df: DataFrame, plan: Mapping[str, str], key: str = "") -> DataFrame:
    """Replace the planned columns by fakes, different ones for different values; others stay.

    Values count as equal apart from case and outer blanks; null and blank ones pass through.  Fakes are
    unique within the table (numbers come from it); a kind with too few fakes is an error.  One join per
    column on digests of its values, hot ones split.
    """
    out = df
    for column, kind in plan.items():
        joined = heavy_join(_marked(out, column, key), unique_fakes(df, column, kind, key), ["_mark"], "left")
        out = joined.withColumn(column, F.coalesce("_fake", F.col(column).cast("string"))).select(*df.columns)
    return out
