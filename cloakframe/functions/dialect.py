"""Regular expressions: from the common dialect to Java, with the same meaning.

``\\d \\w \\s \\b`` are Unicode-aware in the patterns users write but ASCII (or a
different Unicode set) in Java, so these escapes are spelled out.  With
``within_lines`` the expression never matches a line feed, so it can run over a
whole text and still find exactly what it finds line by line.
"""

from __future__ import annotations

import re

_SPACE = r"\t\x0B\f\r\x1C-\x1F \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
# ASCII first: looking up the Unicode category of every letter is slow.
# The last code point stands there literally, as Java looks back over a character
# outside the basic plane only if the expression itself contains one.
_LAST = "\U0010FFFF"
_DIGIT = r"[0-9\u0660-" + _LAST + r"&&\p{Nd}]"
_WORD = r"A-Za-z0-9_[\x80-" + _LAST + r"&&[\p{L}\p{N}]]"
_BOUNDARY = rf"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))"
_NO_BOUNDARY = rf"(?:(?<=[{_WORD}])(?=[{_WORD}])|(?<![{_WORD}])(?![{_WORD}]))"

_STARTS_WORD = re.compile(r"(?:\((?:\?:)?)*(\\d|\[[0-9A-Za-z-]+\])")
_ENDS_WORD = re.compile(r"(?:\\d|\[[0-9A-Za-z-]+\])(?:[+]|\{[0-9,]+\})?\)*$")

_LINE_START, _LINE_END = r"(?<![^\n])", r"(?![^\n])"

SPACES = rf"[{_SPACE}\n]"


def java_pattern(pattern: str, ignore_case: bool = False, within_lines: bool = False) -> str:
    """Java form of ``pattern``: ``.`` and ``$`` stop at line feeds only.

    ``within_lines`` binds ``^ $ \\A \\Z`` to the ends of each line.
    """
    out, i, in_class, negated = [], 0, False, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            if pattern[i + 1] == "b" and not in_class:
                out.append(_boundary(pattern[:i], pattern[i + 2 :]))
            else:
                out.append(_escape(pattern[i + 1], in_class, negated, within_lines))
            i += 2
            continue
        if in_class:
            first = out[-1] in ("[", "[^")
            if ch == "]" and not first:
                in_class = False
                if negated and within_lines:
                    out.append(r"\n")
                out.append("]")
            else:
                out.append("\\" + ch if ch in "[]&" else _plain(ch))
        elif ch == "[":
            in_class, negated = True, pattern[i + 1 : i + 2] == "^"
            out.append("[^" if negated else "[")
            i += int(negated)
        elif within_lines and ch in "^$":
            out.append(_LINE_START if ch == "^" else _LINE_END)
        else:
            out.append(_plain(ch))
        i += 1
    return ("(?iud)" if ignore_case else "(?d)") + "".join(out)


def _boundary(before: str, after: str) -> str:
    """Word boundary; a one-sided test where the pattern itself shows the other side."""
    starts = _STARTS_WORD.match(after)
    if starts:
        first = java_pattern(starts[1]).removeprefix("(?d)")
        return rf"(?={first})(?<![{_WORD}])"
    if _ENDS_WORD.search(before):
        return rf"(?![{_WORD}])"
    return _BOUNDARY


def _plain(ch: str) -> str:
    return r"\x27" if ch == "'" else ch  # keeps the expression a simple SQL literal


def _escape(letter: str, in_class: bool, negated: bool, within_lines: bool) -> str:
    feed = "" if within_lines and not negated else r"\n"
    if letter == "d":
        return _DIGIT
    if letter == "D":
        return r"\P{Nd}"
    if letter == "s":
        return _SPACE + feed if in_class else f"[{_SPACE}{feed}]"
    if letter == "S":
        return rf"[^{_SPACE}\n]"
    if letter == "w":
        return _WORD if in_class else f"[{_WORD}]"
    if letter == "W":
        return f"[^{_WORD}" + (r"\n]" if within_lines else "]")
    if letter == "B":
        return _NO_BOUNDARY
    if letter in "AZ" and not in_class:
        if within_lines:
            return _LINE_START if letter == "A" else _LINE_END
        return r"\A" if letter == "A" else r"\z"
    return r"\x27" if letter == "'" else "\\" + letter


def quote(term: str) -> str:
    """Expression that matches ``term`` literally, in both dialects."""
    return "".join("\\" + ch if ch in r"\.^$|?*+()[]{}-&~#" else ch for ch in term)
