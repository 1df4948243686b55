"""Sizes, file types, risk grades, coordinates and display forms as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from cloakframe.functions import fixed_values as fixed
from cloakframe.functions.validators import is_present


def format_size(size: str) -> Column:
    """``12.3 KB``: one decimal, base 1024, exact halves rounded to even.

    Whole-number arithmetic, as formatting a double rounds halves up.  Sizes may be decimals beyond 64 bits
    (30 digits).
    """
    tenths = f"(cast({size} as decimal(36,0)) * 10)"

    def shown(power: int) -> str:
        unit = 1024**power
        down, rest = f"({tenths} div {unit})", f"({tenths} % {unit})"
        half = f"({rest} * 2 > {unit} or ({rest} * 2 = {unit} and {down} % 2 = 1))"
        count = f"(cast({down} as bigint) + if({half}, 1, 0))"
        return f"concat({count} div 10, '.', {count} % 10, ' {fixed.SIZE_UNITS[power]}')"

    cases = " ".join(f"when {size} < {1024 ** (p + 1)}L then {shown(p)}" for p in range(4))
    return F.expr(f"case {cases} when {size} is not null then {shown(4)} end")


def extension(path: Column) -> Column:
    """Last suffix of the file name in lower case, with its dot, or an empty string."""
    return F.lower(
        F.regexp_extract(F.substring_index(path, "/", -1), r"(?s)^.+(\.[^.]+)$", 1)
    )


def file_type(path: Column) -> Column:
    ext = extension(path)
    known = F.create_map(*[F.lit(x) for pair in fixed.FILE_TYPES.items() for x in pair])
    other = F.concat(
        F.lit("Other ("), F.when(ext == "", "no extension").otherwise(ext), F.lit(")")
    )
    return F.coalesce(F.try_element_at(known, ext), other)


def risk_level(key: Column, value: Column, split_camel: bool = False) -> Column:
    """'high', 'medium' or 'low' by the name of a property that is not blank."""
    if split_camel:
        key = F.regexp_replace(key, "(?<=[a-z0-9])(?=[A-Z])", "_")
    plain = F.replace(F.lower(key), F.lit(" "), F.lit("_"))
    return (
        F.when(~F.coalesce(is_present(value), F.lit(False)), "low")
        .when(plain.isin(*fixed.HIGH_RISK_KEYS), "high")
        .when(plain.rlike("|".join(fixed.MEDIUM_RISK_WORDS)), "medium")
        .otherwise("low")
    )


def gps_decimal(dms: Column, ref: Column) -> Column:
    """Decimal degrees from degrees, minutes, seconds; null if incomplete."""
    at = [F.get(dms, i) for i in range(3)]
    degrees = at[0] + at[1] / 60.0 + at[2] / 3600.0
    return F.when(ref != "", F.when(ref.isin("S", "W"), -degrees).otherwise(degrees))


def gps_position(latitude: Column, longitude: Column) -> Column:
    """``lat, lon`` with six decimals if both are known."""
    return F.when(
        latitude.isNotNull() & longitude.isNotNull(),
        F.format_string("%.6f, %.6f", latitude, longitude),
    )


def render_value(value: Column, style: str = "image") -> Column:
    """Short display form of a text: 80 characters at most ('image') or 80 and dots."""
    if style not in ("image", "office"):
        raise ValueError(f"style must be 'image' or 'office', not {style!r}")
    cut = F.left(value, F.lit(77 if style == "image" else 80))
    return F.when(F.length(value) > 80, F.concat(cut, F.lit("..."))).otherwise(value)


def render_binary(value: Column) -> Column:
    """Long binary values as their size, short ones as text."""
    size = F.octet_length(value)
    return F.when(
        size > 100, F.concat(F.lit("<binary data, "), size.cast("string"), F.lit(" bytes>"))
    ).otherwise(F.decode(value, "ISO-8859-1"))
