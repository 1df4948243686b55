"""Approximate nearest neighbours over learned partitions.

1. Equal vectors are one class; a class keeps its smallest ids, as many as a
   result can show, so a very common vector is neither searched nor stored twice.
2. On a bounded sample, the graph of nearest neighbours is partitioned into parts of equal
   size by label propagation with a price on full parts.
3. A small classifier (one hidden layer, trained by gradient descent on the graph's parts)
   learns to tell a vector's part.  It gives every class its part, and each query its
   most probable parts: as many as find the wanted share of neighbours on a fifth of the
   sample that training did not see.  Vectors without structure need most of the parts.
4. Classes of a part and queries sent there meet in blocks of bounded size and are
   compared exactly, in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from cloakframe.llm.tables import stored
from cloakframe.operators.spread import spread_join

#: Most vectors that partitioning and classifier see.
MOST_TRAINED = 5000
PARTS = 16
#: Share of true neighbours that probing must find on the part of the sample kept from training.
RECALL = 0.95
#: Most vectors of a part, and most queries, in one block.
BLOCK = 2048
_HASH = ["h1", "h2"]


def neighbour_graph(vectors: np.ndarray, degree: int = 10) -> np.ndarray:
    """The ``degree`` nearest others of each vector by inner product."""
    scores = vectors @ vectors.T
    np.fill_diagonal(scores, -np.inf)
    degree = min(degree, len(vectors) - 1)
    return np.argpartition(-scores, degree - 1, axis=1)[:, :degree]


def balanced_parts(graph: np.ndarray, vectors: np.ndarray, parts: int, seed: int = 3) -> np.ndarray:
    """A part for each node: neighbours together, no part above 1.1 times the mean size."""
    n = len(graph)
    rng = np.random.default_rng(seed)
    most = int(np.ceil(1.1 * n / parts))
    axis = np.linalg.svd(vectors - vectors.mean(0), full_matrices=False)[2][:4]
    signs = ((vectors - vectors.mean(0)) @ axis.T)
    order = np.lexsort(np.round(signs.T, 1))
    label = np.empty(n, np.int64)
    label[order] = np.arange(n) * parts // n
    sizes = np.bincount(label, minlength=parts)
    back = [[] for _ in range(n)]
    for i, row in enumerate(graph):
        for j in row:
            back[j].append(i)
    for _ in range(15):
        moved = 0
        for i in rng.permutation(n):
            votes = np.bincount(label[graph[i]], minlength=parts) + np.bincount(
                label[back[i]] if back[i] else [], minlength=parts).astype(float)
            votes -= 4.0 * sizes / most
            votes[(sizes >= most) & (np.arange(parts) != label[i])] = -np.inf
            to = int(np.argmax(votes))
            if to != label[i] and votes[to] > votes[label[i]]:
                sizes[label[i]] -= 1
                sizes[to] += 1
                label[i] = to
                moved += 1
        if not moved:
            break
    return label


class Router:
    """A classifier of vectors to parts: one hidden layer and a softmax."""

    def __init__(self, vectors: np.ndarray, labels: np.ndarray, parts: int, hidden: int = 64,
                 epochs: int = 60, seed: int = 4):
        rng = np.random.default_rng(seed)
        self.scale = 1 / max(1e-12, float(np.sqrt((vectors**2).mean())))
        x = vectors * self.scale
        self.w1 = rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden))
        self.b1 = np.zeros(hidden)
        self.w2 = np.zeros((hidden, parts))
        self.b2 = np.zeros(parts)
        wanted = np.eye(parts)[labels]
        for epoch in range(epochs):
            rate = 0.3 * (1 - epoch / epochs)
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 64)):
                h = np.tanh(x[at] @ self.w1 + self.b1)
                p = _softmax(h @ self.w2 + self.b2) - wanted[at]
                back = (p @ self.w2.T) * (1 - h * h)
                self.w2 -= rate * h.T @ p / len(at)
                self.b2 -= rate * p.mean(0)
                self.w1 -= rate * x[at].T @ back / len(at)
                self.b1 -= rate * back.mean(0)

    def probabilities(self, vectors: np.ndarray) -> np.ndarray:
        return _softmax(np.tanh(vectors * self.scale @ self.w1 + self.b1) @ self.w2 + self.b2)


def needed_probes(router: Router, trained: np.ndarray, apart: np.ndarray, parts: int,
                  recall: float, k: int) -> int:
    """The fewest parts per query with which ``apart`` finds ``recall`` of its neighbours."""
    every = np.concatenate([trained, apart])
    home = router.probabilities(every).argmax(1)
    scores = apart @ every.T
    scores[np.arange(len(apart)), len(trained) + np.arange(len(apart))] = -np.inf
    k = min(k, len(every) - 1)
    wanted = home[np.argpartition(-scores, k - 1, axis=1)[:, :k]]
    place = np.argsort(np.argsort(-router.probabilities(apart), axis=1, kind="stable"), axis=1)
    needed = np.take_along_axis(place, wanted, axis=1)
    return next((p for p in range(1, parts) if (needed < p).mean() >= recall), parts)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _routed(router: Router | None, probes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            if router is None:
                parts = np.zeros((len(batch), 1), np.int64)
            else:
                p = router.probabilities(np.stack(batch["vector"]))
                parts = np.argsort(-p, axis=1, kind="stable")[:, :probes]
            yield batch[_HASH].assign(parts=list(parts))

    return run


def exact_scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, added up in order of the components."""
    out = np.zeros(len(left))
    for d in range(left.shape[1]):
        out += left[:, d] * right[:, d]
    return out


def _block_search(k: int):
    """The ``k`` best candidate rows of a block for each query class, by score, then id."""

    def run(key, queries: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"q1": [], "q2": [], "vec_id": [], "score": []}).astype(
            {"q1": "int64", "q2": "int64", "vec_id": "int64", "score": "float64"})
        if not len(queries) or not len(members):
            return empty
        q, c = np.stack(queries["asked"]), np.stack(members["vector"])
        copies = members["ids"].map(len).to_numpy()
        ids, owner = np.concatenate(members["ids"].to_list()), np.repeat(np.arange(len(c)), copies)
        out = []
        for at in range(0, len(q), 256):
            part = q[at:at + 256]
            rough = part @ c.T
            # Every class among the k best has a rough score near the k-th best class or above.
            n = min(k, rough.shape[1])
            low = np.partition(rough, -n, axis=1)[:, -n]
            low -= 1e-9 * (1 + np.abs(low))
            row, column = np.nonzero(rough >= low[:, None])
            score = exact_scores(part[row], c[column])
            for i in range(len(part)):
                own, s = column[row == i], score[row == i]
                place = np.full(len(c), -1)
                place[own] = np.arange(len(own))
                rows = np.flatnonzero(place[owner] >= 0)
                found = s[place[owner[rows]]]
                best = np.lexsort((ids[rows], -found))[:k]
                out.append((at + i, ids[rows[best]], found[best]))
        which = np.concatenate([np.full(len(v), i) for i, v, _ in out])
        return pd.DataFrame({
            "q1": queries["q1"].to_numpy()[which], "q2": queries["q2"].to_numpy()[which],
            "vec_id": np.concatenate([v for _, v, _ in out]),
            "score": np.concatenate([s for _, _, s in out])})

    return run


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, parts: int = PARTS,
            recall: float = RECALL, most: int = MOST_TRAINED, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found for rows whose vec_id ``every`` divides.

    Nearest is the largest inner product, ties go to the smaller vec_id; a row is no
    candidate of its own.  Vectors that are null, zero, of another length than most, or hold null or
    non-finite components take no part, nor rows without vec_id.  Rows that
    repeat a vec_id with the same vector count once.  Other columns are ignored; an empty table
    gives no rows.  Training takes at most ``most`` vectors.
    """
    valid = ("size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < "
             "double('infinity')) and exists(vector, x -> x != 0)")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                          F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.filter("vec_id is not null and vector is not null").filter(valid)
    width = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    width = width.n if width else 1
    plain = rows.filter(F.size("vector") == width).withColumn(
        "vector", F.transform("vector", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x)))
    hashed = plain.select("vec_id", "vector", F.xxhash64("vector").alias("h1"),
                          F.xxhash64("vector", F.lit(1)).alias("h2"))
    first = Window.partitionBy(*_HASH).orderBy("vec_id")
    ranked = hashed.dropDuplicates(["vec_id", *_HASH]).withColumn("at", F.row_number().over(first))
    classes = stored(ranked.filter(F.col("at") <= k + 1).groupBy(*_HASH).agg(
        F.sort_array(F.collect_list("vec_id")).alias("ids"),
        F.min_by("vector", "vec_id").alias("vector")), "vectors")
    asked = hashed.filter(F.col("vec_id") % every == 0).select("vec_id", *_HASH).distinct()
    wanted = asked.select(*_HASH).distinct()

    sample = np.array(classes.select("vector", *_HASH).orderBy(*_HASH).limit(most).select("vector")
                      .toPandas()["vector"].to_list())
    router, probes = None, 1
    parts = min(parts, len(sample) // 50)
    if parts > 1:
        apart = np.arange(len(sample)) % 5 == 0
        own = sample[~apart]
        router = Router(own, balanced_parts(neighbour_graph(own), own, parts), parts)
        probes = needed_probes(router, own, sample[apart], parts, recall, k)
    schema = "h1 long, h2 long, parts array<long>"
    routed = stored(classes.select("vector", *_HASH).mapInPandas(_routed(router, probes), schema), "routes")
    placed = routed.select(*_HASH, F.col("parts")[0].alias("part"))
    probing = routed.join(wanted, _HASH, "left_semi").select(*_HASH, F.explode("parts").alias("part"))
    grid = placed.groupBy("part").agg(F.ceil(F.count("*") / block).cast("int").alias("c_blocks")).join(
        probing.groupBy("part").agg(F.ceil(F.count("*") / block).cast("int").alias("q_blocks")), "part")
    grid = F.broadcast(grid)  # one row per part

    def blocks(n):
        return F.sequence(F.lit(0), F.col(n) - 1)

    members = placed.join(grid, "part").select(
        "part", F.pmod(F.xxhash64(*_HASH), F.col("c_blocks")).cast("int").alias("c"),
        F.explode(blocks("q_blocks")).alias("q"), *_HASH)
    queries = probing.join(grid, "part").select(
        "part", F.explode(blocks("c_blocks")).alias("c"),
        F.pmod(F.xxhash64(*_HASH), F.col("q_blocks")).cast("int").alias("q"), *_HASH)
    key = ["part", "c", "q"]
    members = members.join(classes, _HASH).select(*key, "vector", "ids").groupBy(*key)
    queries = queries.join(classes.drop("ids"), _HASH).select(
        *[F.col(c).alias(f"q_{c}") for c in key], F.col("vector").alias("asked"),
        F.col("h1").alias("q1"), F.col("h2").alias("q2")).groupBy(*[f"q_{c}" for c in key])
    found = queries.cogroup(members).applyInPandas(
        _block_search(k + 1), "q1 long, q2 long, vec_id long, score double")
    nearest_ = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("at", F.row_number().over(nearest_)).filter(F.col("at") <= k + 1)
    lists = best.groupBy(F.col("q1").alias("h1"), F.col("q2").alias("h2")).agg(
        F.sort_array(F.collect_list(F.struct("at", F.col("vec_id").alias("id"), "score"))).alias("list"))
    answers = spread_join(asked.withColumnRenamed("vec_id", "query_id"), lists, _HASH, "inner")
    return answers.select("query_id", F.expr(
        f"posexplode(slice(filter(list, x -> x.id != query_id), 1, {int(k)})) as (pos, hit)")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"),
        F.col("hit.score").alias("score"))


def op8_nearest(spark, folder: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{folder}/embeddings.parquet"))
