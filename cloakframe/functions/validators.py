"""Predicates that tell real identifiers from look-alikes."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column, functions as F

from cloakframe.functions.dialect import SPACES

_OTHER_DIGITS = [
    chr(c) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"
]
_OTHER_DIGIT_VALUES = "".join(str(unicodedata.digit(c)) for c in _OTHER_DIGITS)


def ascii_digits(value: Column) -> Column:
    """Decimal digits of any script as 0-9."""
    return F.when(
        value.rlike(r"[^\x00-\x7F]"),
        F.translate(value, "".join(_OTHER_DIGITS), _OTHER_DIGIT_VALUES),
    ).otherwise(value)


def digits_of(value: Column) -> Column:
    """Only the decimal digits of ``value``."""
    return F.regexp_replace(value, r"\P{Nd}", "")


def is_card(value: Column) -> Column:
    """13 to 19 digits, apart from blanks and dashes, with a right check digit."""
    plain = ascii_digits(F.regexp_replace(value, f"{SPACES}|-", ""))
    return plain.rlike(r"^[0-9]{13,19}\z") & F.call_function("luhn_check", plain)


def is_ssn(value: Column) -> Column:
    """Nine digits in a range that is issued."""
    plain = ascii_digits(F.translate(value, "- ", ""))
    return plain.rlike(
        r"^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}\z"
    )


def is_phone(value: Column) -> Column:
    """10 to 15 digits."""
    return F.length(digits_of(value)).between(10, 15)


def is_ipv4(value: Column) -> Column:
    """Numbers between dots, every one at most 255."""
    part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    return ascii_digits(value).rlike(rf"^{part}(?:\.{part})*\z")


def any_value(value: Column) -> Column:
    return value.isNotNull()


def is_present(value: Column) -> Column:
    """Neither null nor only blanks."""
    return value.isNotNull() & value.rlike(rf"[^{SPACES[1:]}")
