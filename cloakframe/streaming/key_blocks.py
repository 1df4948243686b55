"""Private key blocks over many lines of a stream, replaced as a whole.

A block may begin in one micro-batch and end in a later one, so the lines from its begin on are
held as state of their source, until its end comes (the block becomes one placeholder, as
in whole texts) or until it is clear that none will: too many lines, or no end in time.  Then the held lines go on as
they were.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cloakframe.functions import fixed_values as fixed
from cloakframe.functions.keyed import KEY, under_key

_BEGIN = re.compile(fixed.PRIVATE_KEY.split(r"[\s\S]")[0])
_BLOCK = re.compile(fixed.PRIVATE_KEY)


def placeholder(block: str, key: str | None) -> str:
    """The placeholder of a block, as :func:`cloakframe.operators.sanitize.placeholder` makes it."""
    if key is None:
        mark = hashlib.md5(block.encode()).hexdigest()
    else:
        inner = hashlib.sha256((key + block).encode()).hexdigest()
        mark = hashlib.sha256((key + inner).encode()).hexdigest()
    return f"[PRIVATE_KEY_{mark[:8]}]"


class Holder:
    """The lines of one source: what goes in comes out, blocks replaced, in the same order."""

    def __init__(self, held: list[tuple[int, str]], most_lines: int, key: str | None):
        self.held, self.most_lines, self.key = held, most_lines, key

    def feed(self, place: int, line: str) -> list[tuple[int, str]]:
        """The lines that can go on once ``line`` is there."""
        out: list[tuple[int, str]] = []
        if not self.held:
            begins = _BEGIN.search(_BLOCK.sub("", line))  # whole blocks within the line do not open one
            if not begins:
                return [(place, self._replaced(line))]
            self.held.append((place, line))
            return out
        self.held.append((place, line))
        text = "\n".join(x for _, x in self.held) if "-----END " in line else ""
        if _BLOCK.search(text):
            first, self.held = self.held[0][0], []
            lines = self._replaced(text).split("\n")
            out += [(first, x) for x in lines[:-1]]
            out += self.feed(first, lines[-1]) if _BEGIN.search(lines[-1]) else [(first, lines[-1])]
        elif len(self.held) > self.most_lines:
            out += self.give_up()
        return out

    def _replaced(self, text: str) -> str:
        return _BLOCK.sub(lambda m: placeholder(m.group(0), self.key), text)

    def give_up(self) -> list[tuple[int, str]]:
        """All held lines, as they were."""
        out, self.held = self.held, []
        return out


def sanitize_key_blocks(stream: DataFrame, source: str, order: str, line: str, key: str = "",
                        timeout: str | None = "10 minutes", most_lines: int = 500) -> DataFrame:
    """source, order and line of a stream of lines, private key blocks replaced by placeholders.

    Lines of a ``source`` come in ``order`` (bigint) within a batch and from batch to batch.  A replaced block
    has the order of its first line.  Other secrets are left to
    :func:`~cloakframe.operators.sanitize.sanitize`, before or after.  A block is held for ``most_lines``
    lines or ``timeout`` of processing time without a new line of its source; longer ones pass unreplaced.
    A query that awaits timeouts goes on for ever, with ``availableNow`` too; with None it ends, and
    held lines wait for the next run.
    """
    duration = int(pd.Timedelta(timeout).total_seconds() * 1000) if timeout else None

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        places, lines = state.get if state.exists else ([], [])
        holder = Holder(list(zip(places, lines)), most_lines, None)
        out: list[tuple[int, str]] = []
        if state.hasTimedOut:
            out = holder.give_up()
        else:
            rows = pd.concat(list(batches)).sort_values("place", kind="stable")
            if KEY in rows:
                holder.key = rows[KEY].iloc[0]
            for place, text in zip(rows["place"].tolist(), rows["line"].tolist()):
                out += [(place, text)] if text is None else holder.feed(place, text)
        if holder.held:
            state.update(([p for p, _ in holder.held], [x for _, x in holder.held]))
            if duration:
                state.setTimeoutDuration(duration)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"source": [group[0]] * len(out), "place": [p for p, _ in out], "line": [x for _, x in out]})

    def change(rows: DataFrame, k: str) -> DataFrame:
        named = rows.selectExpr(f"cast(`{source}` as string) as source", f"cast(`{order}` as bigint) as place",
                                f"`{line}` as line", *([k] if k else []))
        return named.groupBy("source").applyInPandasWithState(
            run, "source string, place bigint, line string", "places array<bigint>, lines array<string>",
            "append", GroupStateTimeout.ProcessingTimeTimeout if duration else GroupStateTimeout.NoTimeout)

    changed = under_key(stream, key, change)
    return changed.withColumnsRenamed({"source": source, "place": order, "line": line})
