"""Registry of the kinds of personal data and secrets, open to additions."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, functions as F

from cloakframe.functions import fixed_values as fixed, masks, validators
from cloakframe.functions.dialect import java_pattern
from cloakframe.functions.matching import name, text

Test = Callable[[Column], Column]


@dataclass(frozen=True)
class Pattern:
    """One kind of value to look for.

    ``hint_words`` (one of them occurs; best with a rare first letter) or ``hint_regex`` are cheap conditions
    that hold for every text with a hit; most texts fail them, so the costly
    expression never runs there.  ``near_regex`` is a second, closer condition
    for expressions that are slow to fail.  ``text_pattern`` replaces the pattern
    over whole texts where it would otherwise cross lines.
    """

    name: str
    pattern: str
    description: str = ""
    ignore_case: bool = False
    valid: Test = validators.any_value
    mask: Test = masks.unmasked
    prefix: str = ""
    default: bool = True
    hint_words: tuple[str, ...] = ()
    hint_regex: str = ""
    near_regex: str = ""
    text_pattern: str | None = None

    @cached_property
    def regex(self) -> str:
        return java_pattern(self.pattern, self.ignore_case)

    @cached_property
    def text_regex(self) -> str:
        return java_pattern(self.text_pattern or self.pattern, self.ignore_case, True)

    def coarse_hint(self, source: str) -> str:
        """The cheap condition, as SQL text over the SQL text ``source``."""
        if self.hint_words:
            tests = [f"contains({source}, {text(w)})" for w in self.hint_words]
            return "(" + " or ".join(tests) + ")"
        # Without a hint nothing is ruled out: the expression itself may be bound to the ends of a line.
        return f"{source} rlike {text(self.hint_regex)}" if self.hint_regex else "true"

    def hint(self, source: str) -> str:
        """All conditions that spare running the expression itself."""
        near = f" and {source} rlike {text(self.near_regex)}" if self.near_regex else ""
        return f"({self.coarse_hint(source)}{near})"

    def occurs(self, source: str, whole_text: bool = False) -> str:
        """Whether there is a hit, as SQL text."""
        regex = self.text_regex if whole_text else self.regex
        return f"({self.hint(source)} and {source} rlike {text(regex)})"


# A superset of the decimal digits of all scripts, cheap to test.
_ANY_DIGIT = r"[0-9\u0660-\x{10FFFF}]"
_NUMBER = rf"{_ANY_DIGIT}(?:{_ANY_DIGIT}{{2}}|\.{_ANY_DIGIT})"
_PHONE_DIGITS = java_pattern(r"X{3}\)?[-.\s]?X{3}[-.\s]?X{4}").replace("X", _ANY_DIGIT)
_DOTTED = r"\." + _ANY_DIGIT
# The last four letters are those that ignoring case adds to A-Z.
_ASSIGNMENT = java_pattern(r"[=:]\s*['\"]?[A-Za-z0-9\-._~+/\u0130\u0131\u017F\u212A]{16}")

DETECTORS: list[Pattern] = [
    Pattern("SSN", fixed.SSN, valid=validators.is_ssn, mask=masks.mask_ssn, hint_regex=_NUMBER,
            description=fixed.DESCRIPTIONS["SSN"]),
    Pattern("CREDIT_CARD", fixed.CREDIT_CARD, valid=validators.is_card, mask=masks.mask_card,
            hint_regex=_NUMBER, description=fixed.DESCRIPTIONS["CREDIT_CARD"]),
    Pattern("EMAIL", fixed.EMAIL, mask=masks.mask_email, hint_words=("@",),
            description=fixed.DESCRIPTIONS["EMAIL"]),
    Pattern("PHONE", fixed.PHONE, valid=validators.is_phone, mask=masks.mask_phone,
            hint_regex=_NUMBER, near_regex=_PHONE_DIGITS,
            description=fixed.DESCRIPTIONS["PHONE"]),
    Pattern("IP_ADDRESS", fixed.IPV4, valid=validators.is_ipv4, hint_regex=_NUMBER,
            near_regex=_DOTTED, description=fixed.DESCRIPTIONS["IP_ADDRESS"]),
]

SECRETS: list[Pattern] = [
    Pattern("JWT", fixed.JWT, prefix="JWT", hint_words=(".eyJ",)),
    Pattern("AWS_KEY", fixed.AWS_KEY, prefix="AWS_KEY",
            hint_words=("AKIA", "ABIA", "ACCA", "ASIA")),
    Pattern("BEARER_TOKEN", fixed.BEARER_TOKEN, prefix="BEARER",
            hint_words=("Bearer", "bearer")),
    Pattern("BASIC_AUTH", fixed.BASIC_AUTH, prefix="BASIC_AUTH",
            hint_words=("Basic", "basic")),
    Pattern("API_KEY", fixed.API_KEY, prefix="API_KEY", ignore_case=True,
            hint_words=("=", ":"), near_regex=_ASSIGNMENT),
    Pattern("PRIVATE_KEY", fixed.PRIVATE_KEY, prefix="PRIVATE_KEY", hint_words=("-----BEGIN ",),
            text_pattern=fixed.PRIVATE_KEY.replace(r"[\s\S]", ".")),
    Pattern("CONNECTION_STRING", fixed.CONNECTION_STRING, prefix="CONNECTION_STRING",
            ignore_case=True, hint_words=("://",)),
    Pattern("IPV4", fixed.IPV4, prefix="IP", hint_regex=_DOTTED),
    Pattern("IPV6", fixed.IPV6, prefix="IPV6", default=False, hint_words=(":",)),
    Pattern("EMAIL", fixed.PLAIN_EMAIL, prefix="EMAIL", hint_words=("@",)),
    Pattern("SESSION_ID", fixed.SESSION_ID, prefix="SESSION", ignore_case=True,
            hint_words=("=", ":"), near_regex=_ASSIGNMENT),
    Pattern("SET_COOKIE", fixed.SET_COOKIE, prefix="COOKIE", hint_words=("-Cookie:", "-cookie:"),
            text_pattern=r"[Ss]et-[Cc]ookie:[^\n]+"),
    Pattern("HEX_TOKEN", fixed.HEX_TOKEN, prefix="TOKEN", default=False,
            hint_regex="[0-9a-fA-F]{32}"),
]


def choose(registry: list[Pattern], types: Iterable[str] | str | None) -> list[Pattern]:
    """Patterns by name or placeholder prefix; None gives the defaults, 'all' all."""
    if types is None:
        return [p for p in registry if p.default]
    if isinstance(types, str):
        types = types.split(",")
    wanted = {t.strip().lower() for t in types}
    if wanted == {"all"}:
        return list(registry)
    by_name = {p.name.lower(): p.name for p in registry}
    by_prefix = {p.prefix.lower(): p.name for p in registry if p.prefix}
    unknown = sorted(wanted - by_name.keys() - by_prefix.keys())
    if unknown:
        raise ValueError(f"unknown types {unknown}; known: {sorted(by_name)}")
    names = {by_name.get(t) or by_prefix[t] for t in wanted}
    return [p for p in registry if p.name in names]


def register_pattern(registry: list[Pattern], pattern: Pattern, before: str | None = None) -> None:
    """Add a kind of value, at the end or before another one (order matters for secrets)."""
    if any(p.name == pattern.name for p in registry):
        raise ValueError(f"{pattern.name} is registered already")
    names = [p.name for p in registry]
    registry.insert(names.index(before) if before else len(names), pattern)


def may_occur_sql(source: str, patterns: list[Pattern]) -> str:
    """Condition that fails only if every pattern is ruled out, as SQL text."""
    return "(" + " or ".join(dict.fromkeys(p.coarse_hint(source) for p in patterns)) + ")"


def may_occur(column: str, patterns: list[Pattern]) -> Column:
    return F.expr(may_occur_sql(name(column), patterns))
