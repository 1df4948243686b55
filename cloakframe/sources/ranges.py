"""Text and CSV files of any size, read in byte ranges by many tasks.

A file is cut at fixed bytes, whatever lies there.  A first pass looks at the ranges of
files that have more than one and notes, for each, how many lines begin in it and whether
its characters are valid UTF-8 (a character belongs to the range of its first byte), or,
for CSV, where the states of a small automaton lead.  Numbers of lines
before a range, the encoding of the file and the state at each border follow from these notes, one
small row per range.  The second pass reads the lines or records that begin in a range, on behind its
end if the last of them does.  So no file has to fit into a task, and the result does not
depend on where the cuts are.
"""

from __future__ import annotations

import codecs
import csv
import io
import re
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cloakframe.operators.detect import explode_lines
from cloakframe.sources.files import file_inventory, file_system_of
from cloakframe.sources.scratch import materialized

#: Bytes of a range, and of the lines that make one row.
RANGE, PIECE = 64 << 20, 4 << 20
_BLOCK = 1 << 20
_END = re.compile(rb"\r\n|\n|\r")
_ANY_END = re.compile(rb"[\r\n]")
Reader = Callable[[int, int], bytes]  # (position, how many) -> bytes


def byte_ranges(inventory: DataFrame, size: int = RANGE) -> DataFrame:
    """path, length, begin and end; an empty file is one empty range."""
    return inventory.select("path", "length", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.greatest(F.col("length") - 1, F.lit(0).cast("bigint")), F.lit(size).cast("bigint")
    )).alias("begin")).withColumn("end", F.least(F.col("begin") + size, F.col("length")))


def dealt(ranges: DataFrame, size: int) -> DataFrame:
    """The stored ranges over as many tasks as their bytes ask for, small ranges many to a task."""
    total, count = ranges.agg(F.sum(F.col("end") - F.col("begin")), F.count("*")).first()
    tasks = max(ranges.sparkSession.sparkContext.defaultParallelism, -(-(total or 0) // max(size, RANGE)))
    return ranges.repartition(max(1, min(count, tasks)), "path", "begin")


def _blocks(read: Reader, begin: int, end: int) -> Iterator[bytes]:
    while begin < end:
        block = read(begin, min(_BLOCK, end - begin))
        if not block:
            raise OSError(f"file ends before byte {end}")
        begin += len(block)
        yield block


def overhang(before: bytes) -> int:
    """Bytes that a UTF-8 character begun in ``before`` has behind it."""
    for back in range(1, min(3, len(before)) + 1):
        byte = before[-back]
        if byte >= 0xC0:
            return max(0, 2 + (byte >= 0xE0) + (byte >= 0xF0) - back)
        if byte < 0x80:
            return 0
    return 0


def valid_utf8(read: Reader, begin: int, end: int, length: int) -> bool:
    """Whether the characters that begin in the range are valid UTF-8."""
    first = min(length, begin + overhang(read(max(0, begin - 3), min(3, begin))))
    last = min(length, end + overhang(read(max(0, end - 3), min(3, end))))
    decoder = codecs.getincrementaldecoder("utf-8")("strict")
    try:
        for block in _blocks(read, first, last):
            decoder.decode(block)
        decoder.decode(b"", final=True)
    except UnicodeDecodeError:
        return False
    return True


def line_begins(read: Reader, begin: int, end: int, length: int) -> int:
    """How many lines begin in the range, in the last one also at its end."""
    found = int(begin == 0)
    before = read(begin - 1, 1) if begin else b""
    for block in _blocks(read, begin, end):
        signs = np.frombuffer(before + block, np.uint8)
        found += int(((signs[:-1] == 10) | ((signs[:-1] == 13) & (signs[1:] != 10))).sum())
        before = block[-1:]
    return found + int(end == length and before in (b"\r", b"\n"))


def lines_in(read: Reader, begin: int, end: int, length: int) -> Iterator[list[bytes]]:
    """The lines that begin in the range, in lists of one block each; the last may end behind it."""
    skip = begin > 0  # what stands before the first line end belongs to an earlier range
    parts: list[bytes] = []
    at = start = max(0, begin - 1)
    while at < end:
        block = read(at, min(_BLOCK, end - at))
        if not block:
            raise OSError(f"file ends before byte {end}")
        if block[-1:] == b"\r" and at + len(block) < end and len(block) > 1:
            block = block[:-1]  # to be seen together with what follows
        elif block == b"\r" and at + 1 < end:
            block = read(at, 2)
        at += len(block)
        lines = _END.split(block)
        if len(lines) > 1:
            lines[0] = b"".join([*parts, lines[0]])
            parts = [lines.pop()]
            start = at - len(parts[0])
            if lines[skip:]:
                yield lines[skip:]
            skip = False
        else:
            parts += lines
    if skip or not (start < end or end == length):
        return
    while at < length:  # the last line goes on in the next range
        block = read(at, min(_BLOCK, length - at))
        found = _ANY_END.search(block)
        if found:
            parts.append(block[:found.start()])
            break
        parts.append(block)
        at += len(block)
    yield [b"".join(parts)]


def _each_range(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[dict, Reader]]:
    """The rows of the batches with readers of their files."""
    resolve = file_system_of()
    for batch in batches:
        for row in batch.to_dict("records"):
            system, where = resolve(row["path"])
            with system.open_input_file(where) as opened:
                yield row, lambda position, count, opened=opened: opened.read_at(count, position)


def _line_notes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for row, read in _each_range(batches):
        place = row["begin"], row["end"], row["length"]
        yield pd.DataFrame([{**row, "lines": line_begins(read, *place), "valid": valid_utf8(read, *place)}])


def _pieces(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        def row_of(row: dict, first: int, lines: list[bytes]) -> pa.RecordBatch:
            text = b"\n".join(lines)
            return pa.RecordBatch.from_pydict({
                "file": pa.array([row["path"]], pa.string()), "first_line": pa.array([first], pa.int64()),
                "text": pa.array([text.decode("utf-8" if row["utf8"] else "latin-1")], pa.string())})

        for batch in batches:
            for row, read in _each_range(iter([batch.to_pandas()])):
                place = row["begin"], row["end"], row["length"]
                if row["utf8"] is None or pd.isna(row["utf8"]):  # the only range of its file
                    row["utf8"] = valid_utf8(read, *place)
                first, held, bytes_held = int(row["before"]) + 1, [], 0
                for lines in lines_in(read, *place):
                    for line in lines:
                        if held and bytes_held + len(line) > size:
                            yield row_of(row, first, held)
                            first, held, bytes_held = first + len(held), [], 0
                        held.append(line)
                        bytes_held += len(line) + 1
                if held:
                    yield row_of(row, first, held)

    return run


def read_text_pieces(spark: SparkSession, path: str | Sequence[str], recursive: bool = False,
                     extensions: Iterable[str] | None = None, allow_no_suffix: bool = False,
                     range_bytes: int = RANGE, piece_bytes: int = PIECE) -> DataFrame:
    """file, first_line and text: the lines of all files, whole lines joined by line feeds.

    A piece has about ``piece_bytes`` or is one longer line (below 2 GiB); a small file is one piece.
    The pieces of a file in order of ``first_line``, joined by line feeds, are its text: UTF-8, else (if
    any of its bytes are not) Latin-1, with line ends as line feeds.  An empty file is one empty piece.
    The files are those of :func:`~cloakframe.sources.files.file_inventory`.
    """
    found = byte_ranges(file_inventory(spark, path, recursive, extensions, allow_no_suffix), range_bytes)
    ranges = materialized(found, "ranges")
    several = dealt(ranges.filter(F.col("length") > range_bytes), range_bytes).mapInPandas(
        _line_notes, "path string, length bigint, begin bigint, `end` bigint, lines bigint, valid boolean")
    noted = materialized(several, "range-notes")
    in_file = Window.partitionBy("path")
    numbered = noted.select(
        "path", "length", "begin", "end",
        (F.sum("lines").over(in_file.orderBy("begin")) - F.col("lines")).alias("before"),
        F.min("valid").over(in_file).alias("utf8"))
    single = ranges.filter(F.col("length") <= range_bytes).withColumns(
        {"before": F.lit(0).cast("bigint"), "utf8": F.lit(None).cast("boolean")})
    return dealt(materialized(numbered.unionByName(single), "ranges"), range_bytes).mapInArrow(
        _pieces(piece_bytes), "file string, first_line bigint, text string")


def read_text_lines(spark: SparkSession, path: str | Sequence[str], recursive: bool = False,
                    extensions: Iterable[str] | None = None, allow_no_suffix: bool = False,
                    range_bytes: int = RANGE, piece_bytes: int = PIECE) -> DataFrame:
    """file, line_no (from 1) and line of files of any size."""
    pieces = read_text_pieces(spark, path, recursive, extensions, allow_no_suffix, range_bytes, piece_bytes)
    return explode_lines(pieces, "text").select(
        "file", (F.col("first_line") + F.col("line_no") - 1).alias("line_no"), "line")


# --- CSV ----------------------------------------------------------------------

#: Outside of quotes; inside; inside, right behind a quote that closes or doubles.
OUTSIDE, INSIDE, QUOTE = 0, 1, 2
_OPENS = re.compile(rb'(?<=[,\r\n])"')


class QuoteScan:
    """The automaton over blocks of one file: state, and the byte before the next block."""

    def __init__(self, state: int, before: bytes):
        self.state, self.before = state, before[-1:] or b"\n"

    def feed(self, block: bytes) -> list[tuple[int, int]]:
        """Go over the block; its spans outside of quotes, in order.

        A quote opens behind a separator or line end only; elsewhere it is a sign like others.
        """
        spans = []
        data = self.before + block  # one byte to look back
        at, end = 1, len(data)
        while at < end:
            if self.state == QUOTE:
                if data[at:at + 1] == b'"':
                    self.state, at = INSIDE, at + 1
                    continue
                self.state = OUTSIDE
            if self.state == INSIDE:
                close = data.find(b'"', at)
                if close < 0:
                    break
                self.state, at = QUOTE, close + 1
                continue
            opens = _OPENS.search(data, at)
            stop = opens.start() if opens else end
            if stop > at:
                spans.append((at - 1, stop - 1))
            if opens:
                self.state, at = INSIDE, stop + 1
            else:
                at = end
        self.before = data[-1:]
        return spans


def _csv_notes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The state behind the range for each state before it."""
    for row, read in _each_range(batches):
        place = row["begin"], row["end"], row["length"]
        before = read(row["begin"] - 1, 1) if row["begin"] else b""
        scans = [QuoteScan(state, before) for state in (OUTSIDE, INSIDE, QUOTE)]
        for block in _blocks(read, row["begin"], row["end"]):
            for scan in scans:
                scan.feed(block)
        yield pd.DataFrame([{**row, "after": [scan.state for scan in scans], "valid": valid_utf8(read, *place)}])


def _composed(group: pd.DataFrame) -> pd.DataFrame:
    """The state before each range of a file, from the first on."""
    group = group.sort_values("begin", ignore_index=True)
    states, state = [], OUTSIDE
    for after in group["after"]:
        states.append(state)
        state = after[state]
    return group.assign(state=states, utf8=bool(group["valid"].all()))[
        ["path", "length", "begin", "end", "state", "utf8"]]


def records_in(read: Reader, begin: int, end: int, length: int, state: int) -> Iterator[bytes]:
    """The records that belong to the range, in blocks of whole ones; the last may end behind it.

    A record belongs where the line end before it ends, the first one to the first range.
    Line ends in quotes are part of a value.
    """
    scan = QuoteScan(state, read(begin - 1, 1) if begin else b"")
    held: list[bytes] | None = None if begin else []
    at = begin
    while at < length:
        block = read(at, min(_BLOCK, (end if at < end else length) - at))
        behind = read(at + len(block), 1)
        cuts = [m.end() for left, right in scan.feed(block) for m in _ANY_END.finditer(block, left, right)
                if m.group() == b"\n" or (block[m.end():m.end() + 1] or behind) != b"\n"]
        if at >= end:
            if held is None:
                return
            held.append(block[:cuts[0]] if cuts else block)
            if cuts:
                break
        elif cuts:
            if held is not None:
                yield b"".join([*held, block[:cuts[-1]]])
            elif len(cuts) > 1:
                yield block[cuts[0]:cuts[-1]]
            held = [block[cuts[-1]:]]
        elif held is not None:
            held.append(block)
        at += len(block)
    rest = b"".join(held or [])
    if rest:
        yield rest


def _rows(records: bytes, utf8: bool) -> Iterator[list[str | None]]:
    """Values of the records; an empty value without quotes is null, blank lines are none."""
    csv.field_size_limit(2**31 - 1)
    text = records.decode("utf-8" if utf8 else "latin-1")
    return filter(None, csv.reader(io.StringIO(text, newline=""), quoting=csv.QUOTE_NOTNULL))


def _header(read: Reader, length: int, utf8: bool) -> tuple[int, list[str]] | None:
    """Where the first record of a file begins, behind blank lines, and its values without a byte order mark."""
    begin = 0
    for block in _blocks(read, 0, length):
        begin += len(block) - len(block.lstrip(b"\r\n"))
        if block.lstrip(b"\r\n"):
            break
    for records in records_in(read, 0, length, length, OUTSIDE):
        for row in _rows(records, utf8):
            row[0] = (row[0] or "").removeprefix("\ufeff" if utf8 else "\u00ef\u00bb\u00bf")
            return begin, [value or "" for value in row]
    return None


def _headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for row, read in _each_range(batches):
        found = _header(read, row["length"], row["utf8"])
        if found:
            yield pd.DataFrame({"path": [row["path"]], "header": [found[0]], "names": [found[1]]})


def _column_names(names: Sequence[str]) -> list[str]:
    """Names for all columns: unnamed and repeated ones get their place."""
    lower = [n.lower() for n in names]
    return [f"_c{i}" if not n else f"{n}{i}" if lower.count(n.lower()) > 1 else n for i, n in enumerate(names)]


def _csv_rows(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, read in _each_range(iter([batch.to_pandas()])):
                skip = row["begin"] <= max(0, row["header"] - 1) < row["end"]
                for records in records_in(read, row["begin"], row["end"], row["length"], row["state"]):
                    values = list(_rows(records, row["utf8"]))
                    if skip and values:
                        values, skip = values[1:], False
                    long = next((v for v in values if len(v) > len(names)), None)
                    if long is not None:
                        raise ValueError(f"{row['path']}: a row of {len(long)} values under {len(names)} names")
                    for v in values:
                        v.extend([None] * (len(names) - len(v)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([v[i] for v in values], pa.string()) for i in range(len(names))], names)

    return run


def read_csv_ranges(spark: SparkSession, path: str | Sequence[str], range_bytes: int = RANGE) -> DataFrame:
    """CSV with a header, every column as a string; files of any size, several tasks for a large one.

    Values may hold separators, doubled quotes and line ends in quotes.  Each file is read as UTF-8 or, if it is not
    valid, as Latin-1.  An empty value is null, an empty one in quotes the empty string, a short row ends in nulls; a
    row longer than the header and files with different headers are errors.  Blank lines are
    skipped; names beginning with . or _ in a folder too.
    """
    paths = [path] if isinstance(path, str) else list(path)
    given = [p.rstrip("/") for p in paths]
    found = file_inventory(spark, paths, True)
    shown = ~F.substring_index("path", "/", -1).rlike("^[._]") | F.col("path").isin(given)
    ranges = materialized(byte_ranges(found.filter(shown), range_bytes), "ranges")
    noted = dealt(ranges, range_bytes).mapInPandas(
        _csv_notes, "path string, length bigint, begin bigint, `end` bigint, after array<int>, valid boolean")
    placed = materialized(noted.groupBy("path").applyInPandas(
        _composed, "path string, length bigint, begin bigint, `end` bigint, state int, utf8 boolean"), "csv-states")
    headers = materialized(placed.filter("begin = 0").mapInPandas(
        _headers, "path string, header bigint, names array<string>"), "csv-headers")
    first = headers.orderBy("path").first()
    if first is None:
        return spark.createDataFrame([], "struct<>")
    other = headers.filter(F.to_json("names") != F.to_json(F.lit(list(first.names)))).first()
    if other is not None:
        raise ValueError(f"different headers: {first.path}, {other.path}")
    names = _column_names(first.names)
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    read = materialized(placed.join(headers.select("path", "header"), "path"), "csv-ranges")
    return dealt(read, range_bytes).mapInArrow(_csv_rows(names), schema)
