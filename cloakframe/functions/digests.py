"""Digests as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from cloakframe.functions import fixed_values as fixed

ALGORITHMS = {
    "sha256": lambda c: F.sha2(c, 256),
    "sha512": lambda c: F.sha2(c, 512),
    "sha1": F.sha1,
    "md5": F.md5,
}


def digest(content: Column, algorithm: str = "sha256") -> Column:
    """Hex digest of a string (as UTF-8) or binary column."""
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {algorithm!r}; known: {sorted(ALGORITHMS)}")
    return ALGORITHMS[algorithm](content)


def algorithm_of(expected: Column, algorithm: str = "sha256") -> Column:
    """Algorithm that fits the length of a digest, unless one was asked for."""
    if algorithm != "sha256":
        return F.lit(algorithm)
    lengths = F.create_map(
        *[F.lit(x) for pair in fixed.DIGEST_LENGTHS.items() for x in pair]
    )
    return F.coalesce(F.try_element_at(lengths, F.length(expected)), F.lit(algorithm))


def first_difference(left: str, right: str) -> Column:
    """0-based place of the first character that differs, up to the shorter length; null if there is none."""
    return F.expr(
        f"try_element_at(filter(sequence(1, least(length({left}), length({right}))), "
        f"i -> substr({left}, i, 1) <> substr({right}, i, 1)), 1) - 1"
    )
