"""The validators and masks as temporary SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from cloakframe.functions.dialect import SPACES
from cloakframe.functions.matching import text

_BARE = rf"regexp_replace(v, {text(SPACES + '|-')}, '')"
_DIGITS = rf"regexp_replace(v, {text(r'\P{Nd}')}, '')"
_SSN = text(r"^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}\z")

FUNCTIONS = {
    "is_card": ("BOOLEAN", rf"{_BARE} rlike {text('^[0-9]{13,19}$')} and luhn_check({_BARE})"),
    "is_ssn": ("BOOLEAN", f"translate(v, '- ', '') rlike {_SSN}"),
    "is_phone": ("BOOLEAN", f"length({_DIGITS}) between 10 and 15"),
    "is_ipv4": (
        "BOOLEAN",
        rf"forall(split(v, {text(r'\.')}), p -> coalesce(try_cast(p as int) <= 255, false))",
    ),
    "mask_ssn": ("STRING", "concat('***-**-', right(v, 4))"),
    "mask_card": ("STRING", f"concat('****-****-****-', right({_DIGITS}, 4))"),
    "mask_email": (
        "STRING",
        "if(size(split(v, '@')) = 2, concat(if(length(substring_index(v, '@', 1)) > 1, "
        "left(v, 1), ''), '***@', substring_index(v, '@', -1)), v)",
    ),
    "mask_phone": (
        "STRING",
        f"if(length({_DIGITS}) >= 4, concat('***-***-', right({_DIGITS}, 4)), v)",
    ),
}


def register_sql_functions(spark: SparkSession) -> None:
    for name, (returns, body) in FUNCTIONS.items():
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(v STRING) RETURNS {returns} "
            f"RETURN {body}"
        )
