"""Benchmark items inside documents: size-partitioned MinHash containment search.

The similarity of a short item and a long document says nothing, so both are brought
to like sizes.  Items are partitioned by the number of their shingles (size classes of powers
of two); for each class a document is cut into windows of two units with a step of
one unit, the class's size, so that a passage as long as an item lies within one window.
Items and windows have the minima of the same universal hashes; a window that has one
minimum in common with an item of its class makes the document a candidate (one minimum
per band: an item lying in a window to four fifths is missed with a
probability below 1e-5, over the windows of a scattered item likewise).  Candidates are
verified on the full shingle sets of item and document, in the same task.  A document that
shares no shingle with any item, seen in a table of bits and then a sorted list, holds none and is not cut at all.

Items are taken in blocks of bounded size, each sent to all executors; a longer list of
items means more passes over the documents, nothing else.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from cloakframe.llm.near_duplicates import hash_family
from cloakframe.llm.tables import Kept, kept_in_process, keyed_texts, only_ids, stored

SHINGLE = 5
HASHES = 64
#: Item shingles that are sent to the executors at once, on average.
BLOCK_SHINGLES = 200_000
_LEAST_UNIT = 16
_MIX = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(r"[^\W_]+")
_TABLE = 1 << 20
_MET = 1 << 22
_TABLE_BITS = 14
_SLICE = 1 << 12


def text_words() -> Kept:
    return kept_in_process("text words", None, lambda: lambda word: xxhash.xxh3_64_intdigest(
        word.encode("utf-8", "surrogatepass")))


def sequence(text: str, words: dict, size: int = SHINGLE) -> np.ndarray:
    """Hashes of a text's shingles in order; words are runs of letters and digits, lower-cased."""
    tokens = _WORD.findall(text.lower())
    n = len(tokens) - size + 1
    if n < 1:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out = (out ^ (out >> np.uint64(29))) * _MIX + hashes[i:i + n]
        return (out ^ (out >> np.uint64(32))) * _MIX


def unit_of(shingles: int) -> int:
    """The size class of an item: the next power of two, or 1 for the smallest items.

    Windows of the smallest class are single shingles, on which all hashes agree: such an item
    is looked up by each of its shingles.
    """
    return 1 if 2 * shingles <= _LEAST_UNIT else max(_LEAST_UNIT, 1 << (shingles - 1).bit_length())


@dataclass
class Items:
    """One block of items as sent to the executors."""

    ids: np.ndarray
    sets: list[np.ndarray]
    percent: int

    def __post_init__(self):
        family = _family()
        self.every = np.unique(np.concatenate(self.sets)) if self.sets else np.empty(0, np.uint64)
        self.met = np.zeros(_MET, bool)
        self.met[(self.every & np.uint64(_MET - 1)).astype(np.int64)] = True
        self.units = np.array([unit_of(len(s)) for s in self.sets])
        self.classes = {}
        small = np.flatnonzero(self.units == 1)
        values = np.concatenate([self.sets[i] for i in small]) if len(small) else np.empty(0, np.uint64)
        order = np.argsort(values, kind="stable")
        self.single = values[order]
        self.single_of = np.repeat(small, [len(self.sets[i]) for i in small])[order]
        self.single_table = np.zeros(_TABLE if len(small) else 0, bool)
        self.single_table[(values & np.uint64(_TABLE - 1)).astype(np.int64)] = True
        for unit in sorted(set(self.units.tolist()) - {1}):
            at = np.flatnonzero(self.units == unit)
            lows = np.array([_block_minima(self.sets[i], len(self.sets[i]), family)[:, 0] for i in at])
            table = np.zeros((HASHES, 1 << _TABLE_BITS), bool)
            for h in range(HASHES):
                table[h, lows[:, h] & np.uint32((1 << _TABLE_BITS) - 1)] = True
            order = np.argsort(lows, axis=0, kind="stable")
            self.classes[unit] = (at, table, np.take_along_axis(lows, order, 0), order)


def shares_any(hashes: np.ndarray, items: Items) -> bool:
    """Whether any of the shingles is one of an item."""
    maybe = hashes[items.met[(hashes & np.uint64(_MET - 1)).astype(np.int64)]]
    if not len(maybe):
        return False
    at = np.minimum(np.searchsorted(items.every, maybe), len(items.every) - 1)
    return bool((items.every[at] == maybe).any())


def _family() -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and offsets of the hashes, 32 bits wide: their values are compared by the high bits."""
    a, b = hash_family(HASHES)
    return (a >> np.uint64(31)).astype(np.uint32)[:, None] | np.uint32(1), b.astype(np.uint32)[:, None]


def _block_minima(hashes: np.ndarray, unit: int, family) -> np.ndarray:
    """The minima over each run of ``unit`` shingles, a row per hash."""
    a, b = family
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    out = []
    step = max(unit, _SLICE // unit * unit)
    for at in range(0, len(short), step):
        values = short[None, at:at + step] * a
        values += b
        out.append(np.minimum.reduceat(values, np.arange(0, values.shape[1], unit), axis=1))
    return np.concatenate(out, axis=1)


def _candidates(hashes: np.ndarray, items: Items, family) -> set[int]:
    found: set[int] = set()
    if len(items.single):
        values = np.unique(hashes[items.single_table[(hashes & np.uint64(_TABLE - 1)).astype(np.int64)]])
        left = np.searchsorted(items.single, values, "left")
        right = np.searchsorted(items.single, values, "right")
        for x, y in zip(left, right):
            found.update(items.single_of[x:y].tolist())
    lows, unit = None, _LEAST_UNIT
    hash_no = np.arange(HASHES)[:, None]
    for wanted in sorted(items.classes):
        if lows is None:
            lows = _block_minima(hashes, unit, family)
        while unit < wanted:  # minima of longer blocks from those of shorter ones
            lows = np.minimum.reduceat(lows, np.arange(0, lows.shape[1], 2), axis=1)
            unit *= 2
        windows = np.minimum(lows[:, :-1], lows[:, 1:]) if lows.shape[1] > 1 else lows
        at, table, ordered, order = items.classes[wanted]
        maybe = table[hash_no, windows & np.uint32((1 << _TABLE_BITS) - 1)]
        for h in np.flatnonzero(maybe.any(1)):
            values = np.unique(windows[h, maybe[h]])
            left = np.searchsorted(ordered[:, h], values, "left")
            right = np.searchsorted(ordered[:, h], values, "right")
            for x, y in zip(left, right):
                found.update(at[order[x:y, h]].tolist())
    return found


def _search(items: Items):
    family = _family()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = text_words()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                hashes = sequence(text, words)
                if not len(hashes) or not shares_any(hashes, items):
                    continue
                own = None
                for i in _candidates(hashes, items, family):
                    own = np.unique(hashes) if own is None else own
                    wanted = items.sets[i]
                    shared = int(np.isin(wanted, own, assume_unique=True).sum())
                    if 100 * shared >= items.percent * len(wanted):
                        out.append((doc_id, items.ids[i], len(wanted), shared))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "n_shingles", "n_shared"]).astype(
                {"doc_id": "Int64", "item_id": "Int64"})

    return run


def _item_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    words = text_words()
    for batch in batches:
        sets = [np.unique(sequence(t, words)).view(np.int64) for t in batch["text"]]
        yield pd.DataFrame({"item_id": batch["item_id"], "shingles": sets})


def contained_items(docs: DataFrame, benchmark: DataFrame, percent: int = 80,
                    block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, item_id, n_shingles, n_shared: items of which a document holds ``percent`` in 100 shingles.

    Shingles are five words; words are runs of letters and digits, lower-cased.  An
    item of fewer words (also a null or empty one) has none and is found nowhere.
    Repeated documents and items give a row for each combination, a null id stays
    null.  Other columns are ignored; empty tables give no rows.
    """
    items = stored(benchmark.select(
        F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")
    ).mapInPandas(_item_sets, "item_id long, shingles array<long>").filter("size(shingles) > 0"), "items")
    total = items.agg(F.sum(F.size("shingles"))).first()[0] or 0
    blocks = -(-total // block_shingles)
    texts = keyed_texts(docs)
    schema = "doc_id long, item_id long, n_shingles long, n_shared long"
    found = []
    for block in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("shingles"), F.lit(blocks)) == block).toPandas()
        ids = [None if pd.isna(x) else int(x) for x in own["item_id"]]
        sets = [np.asarray(s, np.int64).view(np.uint64) for s in own["shingles"]]
        if sets:
            found.append(texts.mapInPandas(_search(Items(ids, sets, percent)), schema))
    if not found:
        return docs.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.union, found)


def without_leaks(docs: DataFrame, benchmark: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in no pair of :func:`contained_items`."""
    found = contained_items(docs, benchmark, percent).select("doc_id").filter("doc_id is not null")
    return only_ids(docs, stored(found.distinct(), "leaks"), "doc_id", "left_anti").select(*docs.columns)


def op3_decontamination(spark, folder: str) -> DataFrame:
    return contained_items(spark.read.parquet(f"{folder}/documents.parquet"),
                           spark.read.parquet(f"{folder}/benchmark.parquet"))


def _shingles_sql(table: str, key: str) -> str:
    return f"""(
    select {key}, row_no, list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) as s
    from (select {key}, row_number() over () as row_no,
                 regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') as w from {table}) where len(w) >= 5)"""


OP3_SQL = f"""
with d as (select doc_id, row_no, unnest(s) as g from {_shingles_sql('documents', 'doc_id')}),
i as (select item_id, row_no as item_no, len(s) as n, unnest(s) as g from {_shingles_sql('benchmark', 'item_id')})
select doc_id, item_id, n as n_shingles, count(*) as n_shared
from i join d using (g) group by doc_id, row_no, item_id, item_no, n having 100 * count(*) >= 80 * n
"""
