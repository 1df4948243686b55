"""Entropy and rating of code policies."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from cloakframe.functions import fixed_values as fixed


def entropy_bits(
    mode: Column, length: Column, words: Column, use_upper: Column, use_lower: Column,
    use_digits: Column, use_symbols: Column, exclude_ambiguous: Column,
    word_list_size: int = fixed.PASSPHRASE_WORDS,
) -> Column:
    """Bits of randomness of a code made by the policy."""

    def add(flag: Column, size: int) -> Column:
        return F.when(flag, size).otherwise(0)

    characters = (
        add(use_upper, 26) + add(use_lower, 26) + add(use_digits, 10)
        + add(use_symbols, len(fixed.SYMBOLS)) - add(exclude_ambiguous, len(fixed.AMBIGUOUS))
    )
    return (
        F.when(mode == "passphrase", words * F.log2(F.lit(float(word_list_size))))
        .when(mode == "pin", length * F.log2(F.lit(10.0)))
        .otherwise(length * F.log2(F.greatest(characters, F.lit(1)).cast("double")))
    )


def strength_rating(bits: Column) -> Column:
    return (
        F.when(bits < 40, "Weak").when(bits < 60, "Fair").when(bits < 80, "Good")
        .when(bits < 100, "Strong").when(bits.isNotNull(), "Excellent")
    )
