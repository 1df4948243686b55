"""Redaction by a table of terms of any size.

Terms are grouped by length.  Rolling hashes of all windows of these lengths of a text are looked up in a
Bloom filter of the terms' hashes, which has a largest size whatever the table; the
windows that pass are joined with the table, so chance hits go.  The plan does not grow with
the terms, and they are never sent whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from cloakframe.functions.matching import name
from cloakframe.operators.redact import covered, fill_of
from cloakframe.operators.spread import heavy_join
from cloakframe.sources.scratch import materialized

#: Bits of the filter: 16 for each term, at least and at most so many (16 MB).
_LEAST_BITS, _MOST_BITS = 1 << 12, 1 << 27


def _tools():
    """Functions for folded text and window hashes, shipped by value."""
    base = 0x9E3779B97F4A7C15 | 1
    inverse = pow(base, -1, 1 << 64)

    def folded(text: str) -> str:
        """Lower case, character by character; one whose lower case is longer stays."""
        low = text.lower()
        return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)

    def powers(of: int, n: int) -> np.ndarray:
        out = np.full(n, of, np.uint64)
        if n:
            out[0] = 1
            out = np.multiply.accumulate(out)
        return out

    def sums(text: str) -> tuple[np.ndarray, np.ndarray]:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        with np.errstate(over="ignore"):
            return (np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * powers(base, len(codes))))),
                    powers(inverse, len(codes)))

    def windows(prefix: np.ndarray, back: np.ndarray, length: int) -> np.ndarray:
        """The hash of the window of that length at each place."""
        with np.errstate(over="ignore"):
            out = (prefix[length:] - prefix[:-length]) * back[:len(prefix) - length]
            out ^= out >> np.uint64(33)
            return (out + np.uint64(length)) * np.uint64(0xC2B2AE3D27D4EB4F)

    def places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        return ((hashes >> np.uint64(20)) % np.uint64(bits)).astype(np.int64), (
            (hashes ^ (hashes >> np.uint64(31))) % np.uint64(bits)).astype(np.int64)

    return folded, sums, windows, places


def _terms(terms: DataFrame, term: str) -> DataFrame:
    """folded and size of the different terms; empty ones and those of several lines are an error."""
    folded, *_ = _tools()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_pylist()
            for v in values:
                if not v or "\n" in v:
                    raise ValueError(f"a term must be one non-empty line: {v!r}")
            values = [folded(v) for v in values]
            yield pa.RecordBatch.from_pydict({"found": pa.array(values, pa.string()),
                                              "size": pa.array([len(v) for v in values], pa.int32())})

    plain = terms.select(F.col(term).cast("string").alias("term")).filter("term is not null")
    return materialized(plain.mapInArrow(run, "found string, size int").distinct(), "terms")


def _filter(known: DataFrame) -> tuple[list[int], np.ndarray]:
    """The different lengths and the filter's bytes, which the executors put together."""
    _, sums, windows, places = _tools()
    bits, count = _LEAST_BITS, known.count()
    while bits < min(16 * count, _MOST_BITS):
        bits *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [windows(*sums(t), len(t))[0] for t in batch.column("found").to_pylist()]
            at = np.unique(np.concatenate(places(np.array(hashes, np.uint64), bits))) if hashes else np.empty(0, np.int64)
            yield pa.RecordBatch.from_pydict({
                "word": pa.array(at >> 6, pa.int64()),
                "mask": pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64), pa.int64())})

    words = known.mapInArrow(run, "word bigint, mask bigint").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[np.asarray(words.column("word"))] = np.asarray(words.column("mask"))
    return sorted(r[0] for r in known.select("size").distinct().collect()), out.view(np.uint8)


def find_terms(df: DataFrame, keys: Sequence[str], column: str, terms: DataFrame, term: str) -> DataFrame:
    """keys, start (from 1), end (exclusive) and found: every hit of a term, without regard to case.

    Hits of one term do not overlap each other (the first one counts), those of different terms may.
    ``keys`` tell the rows of ``df`` apart.  Null texts have no hits.
    """
    known = _terms(terms, term)
    lengths, bits = _filter(known)
    folded, sums, windows, places = _tools()
    kept = df.select(*keys, F.col(column).cast("string").alias("_text")).filter("_text is not null")
    schema = StructType([*df.select(*keys).schema.fields]).add("start", IntegerType()).add("end", IntegerType()).add("found", StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, ends, found = [], [], [], []
            for row, text in enumerate(batch.column("_text")):
                text = folded(text.as_py())
                prefix, back = sums(text)
                for length in lengths:
                    if length > len(text):
                        break
                    one, two = places(windows(prefix, back, length), 8 * len(bits))
                    hit = (bits[one >> 3] >> (one & 7).astype(np.uint8)) & (bits[two >> 3] >> (two & 7).astype(np.uint8)) & 1
                    free: dict[str, int] = {}
                    for at in np.flatnonzero(hit).tolist():
                        word = text[at:at + length]
                        if at >= free.get(word, 0):
                            free[word] = at + length
                            rows.append(row)
                            starts.append(at + 1)
                            ends.append(at + 1 + length)
                            found.append(word)
            own = batch.select(list(keys)).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*own.columns, pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(found, pa.string())],
                [*keys, "start", "end", "found"])

    candidates = materialized(kept.mapInArrow(run, schema), "term-hits")
    return heavy_join(candidates, known.select("found"), ["found"], "inner").select(*keys, "start", "end", "found")


def redact_by_table(df: DataFrame, keys: Sequence[str], column: str, terms: DataFrame, term: str,
                    fill: str = "█") -> DataFrame:
    """Every character of a hit covered by ``fill`` ('' removes it); equal to ``redact`` with all the terms.

    ``keys`` tell the rows apart; only texts with hits are worked on.  The folded hits, which are
    among the given terms, are stored in the scratch folder, never the texts.
    """
    hits = find_terms(df, keys, column, terms, term)
    spans = hits.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("start").alias("s"), F.col("end").alias("e")))).alias("_spans"))
    cut = F.expr(f"if(_spans is null, {name(column)}, {covered(name(column), '_spans', fill_of(fill))})")
    return df.join(spans, list(keys), "left").withColumn(column, cut).select(*df.columns)
