"""Near-duplicate documents: minima of many universal hashes, bands, exact check, components.

1. Every document becomes its set of word shingles (64-bit hashes).  Equal sets
   are one class, known by its least doc_id; only classes go on.
2. A class has ``bands * rows`` hash minima.  Classes that share all minima of a
   band meet in a bucket.  Two sets of similarity 0.8 share no bucket of the
   default 40 bands of 5 with probability 1.2e-7.
3. In each bucket all classes are compared with the least one, on full sets.
   The links give first components.
4. Buckets of three or more classes that still lie in several components are
   settled: every class outside the bucket's largest component is compared with all
   others, in blocks.  So no link between classes of a bucket is lost, though a
   bucket whose members all hang together costs one comparison each.
5. Components of components give the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from cloakframe.llm.components import connected_components
from cloakframe.llm.tables import Kept, kept_in_process, keyed_texts, only_ids, stored
from cloakframe.operators.spread import spread_join

_MIX = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 4096
#: Classes of a bucket that one task compares at once.
BLOCK = 1024


def word_hashes() -> Kept:
    return kept_in_process("words", None, lambda: xxhash.xxh3_64_intdigest)


def shingle_hashes(text: str, size: int, words: dict) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles.

    Words are runs of anything but the six ASCII blanks, A-Z lower-cased.  A text
    of fewer than ``size`` words is one shingle, one without words none.
    """
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))
    n = max(1, len(hashes) - size + 1)
    out = np.full(n, len(hashes) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(len(hashes) - n + 1):
            out = (out ^ (out >> np.uint64(29))) * _MIX + hashes[i:i + n]
        out = (out ^ (out >> np.uint64(32))) * _MIX
    return np.unique(out)


def hash_family(count: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and offsets of ``count`` multiply-add-shift hashes."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2)


def minima(hashes: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The least value of each hash over a non-empty set, as uint32."""
    a, b = family
    low = np.full(len(a), 2**32 - 1, np.uint64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at:at + _CHUNK, None] * a
        part += b
        part >>= np.uint64(32)
        np.minimum(low, part.min(0), out=low)
    return low.astype(np.uint32)


def _signatures(size: int, bands: int, rows: int):
    family = hash_family(bands * rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, known = word_hashes(), {}
        for batch in batches:
            out = {"doc_id": batch["doc_id"], "n_shingles": [], "set_a": [], "set_b": [], "bands": []}
            for text in batch["text"]:
                found = shingle_hashes(text, size, words)
                digest = xxhash.xxh3_128_intdigest(found.tobytes())
                out["n_shingles"].append(len(found))
                out["set_a"].append((digest >> 64) - 2**63)
                out["set_b"].append((digest & (2**64 - 1)) - 2**63)
                if digest not in known:
                    if len(known) > 2000:
                        known.clear()
                    known[digest] = [] if not len(found) else [
                        xxhash.xxh3_64_intdigest(part.tobytes(), seed=at) - 2**63
                        for at, part in enumerate(minima(found, family).reshape(bands, rows))]
                out["bands"].append(known[digest])
            yield pd.DataFrame(out)

    return run


def _sets(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = word_hashes()
        for batch in batches:
            yield pd.DataFrame({
                "node": batch["doc_id"],
                "shingles": [shingle_hashes(t, size, words).view(np.int64) for t in batch["text"]],
            })

    return run


def _linked(left: str, right: str, percent: int):
    """Whether two sets are alike, from the two arrays."""
    both = f"size(array_intersect({left}, {right}))"
    return F.expr(f"100L * {both} >= {percent}L * (size({left}) + size({right}) - {both})")


def _settle(percent: int):
    """Links from the outsiders of one block of a bucket to its other members."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        members = group[~group["outsider"].to_numpy(bool)]
        outsiders = group[group["outsider"].to_numpy(bool)]
        pairs: set[tuple[int, int]] = set()
        if len(members) and len(outsiders):
            sizes = members["shingles"].map(len).to_numpy()
            every = np.concatenate(members["shingles"].to_list())
            values, local = np.unique(every, return_inverse=True)
            begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            components = members["component"].to_numpy()
            for own, component in zip(outsiders["shingles"], outsiders["component"]):
                at = np.searchsorted(values, own)
                at = at[at < len(values)]
                at = at[np.isin(values[at], own)]
                flags = np.zeros(len(values), np.int64)
                flags[at] = 1
                both = np.add.reduceat(flags[local], begins)
                like = 100 * both >= percent * (len(own) + sizes - both)
                for other in set(components[like & (components != component)].tolist()):
                    pairs.add((int(component), int(other)))
        return pd.DataFrame(sorted(pairs), columns=["a", "b"], dtype="int64")

    return run


def near_duplicates(docs: DataFrame, shingle: int = 2, percent: int = 80, bands: int = 40,
                    rows: int = 5, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs`` (doc_id, text).

    ``component_id`` is the least doc_id reachable over links (similarity of the
    sets at least ``percent`` in 100), ``kept`` whether that is the document
    itself.  A null or blank text has an empty set and is linked with nothing.
    Repeated rows are copies; a doc_id with several texts gets one row for each;
    without a doc_id a row is never kept.  Other columns are ignored, an empty table
    gives no rows.
    """
    texts = keyed_texts(docs)
    signed = stored(texts.mapInPandas(
        _signatures(shingle, bands, rows),
        "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"), "signatures")
    full = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = stored(full.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("node")), "classes")
    nodes = full.join(classes, ["set_a", "set_b"]).filter("doc_id = node").dropDuplicates(
        ["node", "set_a", "set_b"])
    banded = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("head"))
    mates = stored(banded.join(shared.filter("n > 1"), "bucket"), "buckets")
    members = stored(mates.select("node").distinct(), "members")
    sets = stored(only_ids(texts, members.withColumnRenamed("node", "doc_id"), "doc_id").mapInPandas(
        _sets(shingle), "node long, shingles array<long>"), "sets")

    stars = mates.filter("node != head").select("node", "head").distinct()
    first = stars.join(sets.withColumnRenamed("shingles", "l"), "node").join(
        sets.select(F.col("node").alias("head"), F.col("shingles").alias("r")), "head"
    ).filter(_linked("l", "r", percent)).select(F.col("node").alias("a"), F.col("head").alias("b"))
    merged = stored(members.join(connected_components(stored(first, "stars")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")), "components")

    sizes = merged.groupBy("component").agg(F.count("*").alias("members"))
    placed = mates.filter("n > 2").join(spread_join(merged, sizes, ["component"], "inner"), "node")
    mixed = placed.groupBy("bucket").agg(
        F.max(F.struct("members", "component"))["component"].alias("top"),
        F.min("component").alias("low"), F.max("component").alias("high"),
        F.ceil(F.count("*") / block).cast("int").alias("blocks"),
    ).filter("low != high").select("bucket", "top", "blocks")
    open_ = stored(placed.select("bucket", "node", "component").join(mixed, "bucket"), "open")
    seen = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    everyone = open_.select("bucket", seen.alias("block"), "node", "component",
                            F.lit(False).alias("outsider"))
    outside = open_.filter("component != top").select(
        "bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "node",
        "component", F.lit(True).alias("outsider"))
    more = stored(everyone.union(outside).join(sets, "node").groupBy("bucket", "block").applyInPandas(
        _settle(percent), "a long, b long").distinct(), "more")
    again = connected_components(more).select(
        F.col("node").alias("component"), F.col("component").alias("root"))
    final = spread_join(merged, again, ["component"], "left").select(
        "node", F.coalesce("root", "component").alias("root"))

    found = classes.join(final, "node", "left").select(
        "set_a", "set_b", F.coalesce("root", "node").alias("root"))
    rows_ = spread_join(signed.select("doc_id", "n_shingles", "set_a", "set_b"), found,
                        ["set_a", "set_b"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(
        F.coalesce("root", "doc_id"))
    return rows_.select("doc_id", "n_shingles", component.alias("component_id"),
                        F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def without_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` but for documents that are not the least doc_id of their component.

    Rows without a doc_id stay; rows that repeat a doc_id are one document and stay or go together
    by any of their texts.
    """
    found = near_duplicates(docs, shingle, percent).filter("not kept and doc_id is not null")
    gone = stored(found.select("doc_id").distinct(), "copies")
    return only_ids(docs, gone, "doc_id", "left_anti").select(*docs.columns)


def op2_near_duplicates(spark, folder: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{folder}/documents.parquet"))
