"""Consistent fake values: pure functions of a digest of the normalized original.

Equal values (apart from case and outer blanks) get equal fakes in every row, run
and partition, so no shared cache is needed.  A generator takes SQL text for four
32-bit numbers cut from the digest and returns SQL text for the fake value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from cloakframe.functions.dialect import SPACES
from cloakframe.functions.keyed import digest_sql
from cloakframe.functions.matching import let, name, text

# Fixed values the fakes are made of.
FIRST_NAMES = (
    "Ada", "Ben", "Cora", "Dario", "Elif", "Finn", "Greta", "Hugo", "Ines", "Jonas", "Kira",
    "Liam", "Mara", "Nils", "Olga", "Pavel", "Quinn", "Rosa", "Sven", "Tara", "Umar", "Vera",
    "Wim", "Xenia", "Yusuf", "Zoe",
)
LAST_NAMES = (
    "Abbott", "Bauer", "Castro", "Duval", "Engel", "Fischer", "Garner", "Holm", "Ivanov",
    "Jensen", "Keller", "Lindqvist", "Moreau", "Novak", "Okafor", "Petrov", "Quist", "Rossi",
    "Sato", "Tanaka", "Ueda", "Vargas", "Weber", "Xu", "Yilmaz", "Zeman",
)
STREETS = (
    "Maple Street", "Oak Avenue", "River Road", "Hill Lane", "Garden Way", "Station Road",
    "Mill Street", "Church Lane", "Park Avenue", "Lake Drive", "Forest Road", "King Street",
)
CITIES = (
    "Fairview", "Riverton", "Lakewood", "Greenfield", "Milton", "Ashland", "Clayton",
    "Dover", "Georgetown", "Kingston", "Newport", "Oxford", "Salem", "Winchester",
)
STATES = (
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL", "IN", "IA",
    "KS", "KY", "LA", "ME", "MD", "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ",
    "NM", "NY", "NC", "ND", "OH", "OK", "OR", "PA", "RI", "SC", "SD", "TN", "TX", "UT", "VT",
    "VA", "WA", "WV", "WI", "WY",
)
COMPANY_WORDS = (
    "Northwind", "Bluebird", "Silverline", "Redwood", "Cobalt", "Harbor", "Summit", "Meadow",
    "Granite", "Beacon", "Orchard", "Lantern",
)
COMPANY_FORMS = ("Ltd", "Group", "Partners", "Works", "Systems", "Trading")
REFERENCE_DATE = "2025-01-01"
YOUNGEST_DAYS = 6574  # 18 years
AGE_SPAN_DAYS = 26298  # up to 90 years

Generator = Callable[[list[str]], str]


def _pick(values: tuple[str, ...], number: str) -> str:
    items = ", ".join(text(v) for v in values)
    return f"array({items})[cast({number} % {len(values)} as int)]"


def _digits(number: str, width: int) -> str:
    return f"lpad(cast({number} % {10 ** width} as string), {width}, '0')"


def _name(s: list[str]) -> str:
    return f"concat_ws(' ', {_pick(FIRST_NAMES, s[0])}, {_pick(LAST_NAMES, s[1])})"


def _email(s: list[str]) -> str:
    return (
        f"concat(lower({_pick(FIRST_NAMES, s[0])}), '.', lower({_pick(LAST_NAMES, s[1])}), "
        f"{_digits(s[2], 4)}, '@example.com')"
    )


def _phone(s: list[str]) -> str:
    return f"concat('(', cast(200 + {s[0]} % 800 as string), ') 555-01', {_digits(s[1], 2)})"


def _ssn(s: list[str]) -> str:
    return f"concat('9', {_digits(s[0], 2)}, '-', {_digits(s[1], 2)}, '-', {_digits(s[2], 4)})"


def _issued_ssn(s: list[str]) -> str:
    return (
        f"concat(lpad(cast(1 + {s[0]} % 665 as string), 3, '0'), '-', "
        f"lpad(cast(1 + {s[1]} % 99 as string), 2, '0'), '-', "
        f"lpad(cast(1 + {s[2]} % 9999 as string), 4, '0'))"
    )


def _address(s: list[str]) -> str:
    return f"concat(cast(1 + {s[0]} % 9999 as string), ' ', {_pick(STREETS, s[1])})"


def _company(s: list[str]) -> str:
    return f"concat_ws(' ', {_pick(COMPANY_WORDS, s[0])}, {_pick(COMPANY_FORMS, s[1])})"


def _date_of_birth(s: list[str]) -> str:
    days = f"cast({YOUNGEST_DAYS} + {s[0]} % {AGE_SPAN_DAYS} as int)"
    return f"cast(date_sub(date'{REFERENCE_DATE}', {days}) as string)"


def _ip_address(s: list[str]) -> str:
    parts = ", ".join(f"cast({x} % 256 as string)" for x in s[:3])
    return f"concat_ws('.', '10', {parts})"


def _credit_card(s: list[str]) -> str:
    body = f"concat('4', {_digits(s[0], 7)}, {_digits(s[1], 7)})"
    check = "filter(sequence(0, 9), d -> luhn_check(concat(body, cast(d as string))))[0]"
    return let(body, "body", f"concat(body, cast({check} as string))")


GENERATORS: dict[str, Generator] = {
    "name": _name,
    "email": _email,
    "phone": _phone,
    "ssn": _ssn,
    "address": _address,
    "city": lambda s: _pick(CITIES, s[0]),
    "state": lambda s: _pick(STATES, s[0]),
    "zip": lambda s: _digits(s[0], 5),
    "company": _company,
    "date_of_birth": _date_of_birth,
    "ip_address": _ip_address,
    "credit_card": _credit_card,
}


def register_generator(kind: str, generator: Generator) -> None:
    if kind in GENERATORS:
        raise ValueError(f"{kind} is registered already")
    GENERATORS[kind] = generator


def seed(column: str, key_column: str = "") -> Column:
    """32-bit number that identifies the normalized value."""
    return F.expr(let(_digest(column, key_column), "h", _slices("h")[3]))


def _digest(column: str, key_column: str) -> str:
    value = f"cast({name(column)} as string)"
    return digest_sql(f"lower(regexp_replace({value}, {text(f'^{SPACES}+|{SPACES}+$')}, ''))", key_column)


def _slices(digest: str) -> list[str]:
    return [f"cast(conv(substr({digest}, {i}, 8), 16, 10) as bigint)" for i in (1, 9, 17, 25)]


def pseudonym(column: str, kind: str, key_column: str = "", valid_ssn: bool = False) -> Column:
    """Fake of the given kind; null, blank and unknown kinds pass through.

    ``key_column`` names a column that holds a secret key (see ``functions/keyed.py``).

    Social security numbers get an area that is never issued unless ``valid_ssn``.
    """
    generator = GENERATORS.get(kind)
    if kind == "ssn" and valid_ssn:
        generator = _issued_ssn
    if generator is None:
        return F.col(column)
    fake = let(_digest(column, key_column), "h", generator(_slices("h")))
    value = f"cast({name(column)} as string)"
    present = f"{value} rlike {text('[^' + SPACES[1:])}"
    return F.expr(f"if({present}, {fake}, {value})")
