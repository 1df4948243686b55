"""Short forms of identifiers that are safe to show."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from cloakframe.functions.validators import digits_of


def mask_ssn(value: Column) -> Column:
    return F.concat(F.lit("***-**-"), F.right(value, F.lit(4)))


def mask_card(value: Column) -> Column:
    return F.concat(F.lit("****-****-****-"), F.right(digits_of(value), F.lit(4)))


def mask_email(value: Column) -> Column:
    name = F.substring_index(value, "@", 1)
    shown = F.when(F.length(name) > 1, F.concat(F.left(name, F.lit(1)), F.lit("***")))
    return F.when(
        F.size(F.split(value, "@", -1)) == 2,
        F.concat_ws("@", F.coalesce(shown, F.lit("***")), F.substring_index(value, "@", -1)),
    ).otherwise(value)


def mask_phone(value: Column) -> Column:
    plain = digits_of(value)
    return F.when(
        F.length(plain) >= 4, F.concat(F.lit("***-***-"), F.right(plain, F.lit(4)))
    ).otherwise(value)


def unmasked(value: Column) -> Column:
    return value
