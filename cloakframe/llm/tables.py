"""Small helpers the operators of this folder share."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cloakframe.sources.scratch import materialized

#: An id list is sent to all executors only up to so many rows (8 bytes each).
MOST_SENT_IDS = 500_000

stored = materialized


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def keyed_texts(docs: DataFrame) -> DataFrame:
    """doc_id as long and text with null as the empty text; all other columns go."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))


def only_ids(df: DataFrame, ids: DataFrame, column: str, how: str = "left_semi") -> DataFrame:
    """The rows of ``df`` whose ``column`` is in the stored, duplicate-free table ``ids``.

    ``how`` "left_anti": those whose ``column`` is not in it, also where it is null.

    A short list of ids is broadcast after counting it; a longer one is joined by
    shuffling.  Both give the same rows.
    """
    if ids.count() <= MOST_SENT_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, column, how)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Kept(dict):
    """Values of keys met before, up to ``most``; later and longer keys are worked out each time.

    Frequent keys come early, so nothing has to make room.
    """

    #: Longer keys are not kept, so ``most`` bounds the bytes too.
    LONGEST = 64

    def __init__(self, make, most: int = 250_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self.make(key)
        if len(self) < self.most and len(key) <= self.LONGEST:
            self[key] = value
        return value


def _give_back() -> None:
    """Return freed memory to the system, so that a worker does not keep the peaks of all stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only in some C libraries
    if trim:
        trim(0)


_in_process: dict = {}


def in_process(purpose: str, mark, make):
    """What ``make`` gives, kept for later tasks of the worker process while ``mark`` stays.

    Only one purpose is kept at a time: another one takes its place, so a worker that lives
    through many stages holds what the present one needs.
    """
    if _in_process.get(purpose, (None,))[0] != mark or purpose not in _in_process:
        _in_process.clear()
        _give_back()
        _in_process[purpose] = mark, make()
    return _in_process[purpose][1]


def forget() -> None:
    """Drop what earlier purposes keep in this worker process and give its memory back."""
    if _in_process:
        _in_process.clear()
        _give_back()


def kept_in_process(purpose: str, mark, make) -> Kept:
    """The :class:`Kept` of a worker process for ``purpose``, begun anew when ``mark`` changes."""
    return in_process(purpose, mark, lambda: Kept(make()))
