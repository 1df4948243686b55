"""Centroid clustering of vectors in exact integers, filtered in PCA-rotated coordinates.

1. Every vector becomes integers.  Their second moments, summed on the executors, give the
   principal axes.  A vector is stored once, with its ``leading`` coordinates along the strongest
   axes and the norm of what is left (its residual).
2. The squared distance of a vector and a centroid is at least the squared distance of their
   leading coordinates plus the squared difference of their residual norms.  A vector is
   compared, in integers, with the centroid of the least bound; only centroids
   whose bound is not above that distance are verified too, so no nearest one is missed.
   Rounding is covered by a margin far wider than the error of the bounds.
3. Tasks add up counts, sums per component and squared distances of each cluster; the driver gets
   one row per cluster and component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cloakframe.llm.tables import stored

WIDTH = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
LEADING = 16
#: Components up to here have distances that fit 64 bits.
LARGEST = 1 << 27
#: Vectors that are compared at once.
_BLOCK = 4096


def usable(vector: Column, width: int = WIDTH) -> Column:
    """Whether a vector has ``width`` components, none of them null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.size(vector) == width, F.lit(False)) & ~F.coalesce(bad, F.lit(True))


def integer_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding",
                    width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """key (long) and ``ints``: floor(scale * x) of each component of the usable vectors."""
    as_double = F.col(vector).cast("array<double>")
    whole = F.transform(as_double, lambda x: F.floor(x * F.lit(float(scale))).cast("long"))
    fits = F.forall(whole, lambda x: F.abs(x) <= LARGEST) & F.forall(
        as_double, lambda x: F.abs(x * F.lit(float(scale))) <= float(LARGEST))
    checked = F.when(fits, whole).otherwise(F.raise_error(F.lit(
        f"a component beyond {LARGEST} in {scale}ths: distances would not fit 64 bits")))
    return vectors.filter(usable(F.col(vector), width)).select(
        F.col(key).cast("long").alias(key), checked.alias("ints"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The lists of an Arrow column as the rows of a matrix."""
    return np.asarray(column.flatten()).reshape(len(column), width)


def _moments(width: int):
    """Rows of sums over a task: products of the components, then components, then the count."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 2, width))
        for batch in batches:
            x = _matrix(batch.column("ints"), width).astype(np.float64)
            total[:width] += x.T @ x
            total[width] += x.sum(0)
            total[width + 1] += len(x)
        yield pa.RecordBatch.from_pydict({"row": pa.array(range(width + 2), pa.int32()),
                                          "sums": pa.array(list(total), pa.list_(pa.float64()))})

    return run


def principal_axes(ints: DataFrame, width: int = WIDTH) -> np.ndarray:
    """The orthonormal axes of the vectors, strongest first, as columns.

    They decide only how well the bounds filter, never a result.
    """
    parts = ints.mapInArrow(_moments(width), "row int, sums array<double>")
    total = np.zeros((width + 2, width))
    for r in parts.select("row", F.posexplode("sums").alias("at", "value")).groupBy("row", "at").agg(
            F.sum("value").alias("value")).collect():
        total[r.row, r.at] = r.value
    n = max(1.0, total[width + 1, 0])
    mean = total[width] / n
    _, axes = np.linalg.eigh(total[:width] / n - np.outer(mean, mean))
    return axes[:, ::-1]


def rotated(ints: np.ndarray, axes: np.ndarray, leading: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading coordinates and norm of the rest."""
    x = ints.astype(np.float64) @ axes
    return x[:, :leading], np.sqrt((x[:, leading:] ** 2).sum(1))


def _rotation(axes: np.ndarray, leading: int, key: str):
    width = len(axes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ints = _matrix(batch.column("ints"), width)
            lead, rest = rotated(ints, axes, leading)
            yield pa.RecordBatch.from_pydict({
                key: batch.column(key), "ints": batch.column("ints"),
                "lead": pa.array(list(lead), pa.list_(pa.float64())), "rest": pa.array(rest, pa.float64())})

    return run


def lower_bounds(lead: np.ndarray, rest: np.ndarray, centre_lead: np.ndarray,
                 centre_rest: np.ndarray) -> np.ndarray:
    """Lower bounds of the squared distances, a row per vector and a column per centroid.

    Less than exact by the margin of rounding, relative to the squared norms.
    """
    sizes = (lead ** 2).sum(1) + rest ** 2
    centre_sizes = (centre_lead ** 2).sum(1) + centre_rest ** 2
    apart = ((lead[:, None, :] - centre_lead) ** 2).sum(2) + (rest[:, None] - centre_rest) ** 2
    return apart - 1e-9 * (sizes[:, None] + centre_sizes) - 0.5


def nearest(ints: np.ndarray, lead: np.ndarray, rest: np.ndarray, centres: np.ndarray,
            centre_lead: np.ndarray, centre_rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each vector the nearest centroid (ties: the smaller number), the squared distance,
    and how many distances were computed in integers over all vectors."""
    if not len(ints):
        return np.empty(0, np.int64), np.empty(0, np.int64), 0
    bounds = lower_bounds(lead, rest, centre_lead, centre_rest)
    at = bounds.argmin(1)
    distance = ((ints - centres[at]) ** 2).sum(1)
    maybe = bounds <= distance[:, None]
    maybe[np.arange(len(ints)), at] = False
    row, centre = np.nonzero(maybe)
    others = np.full(bounds.shape, np.iinfo(np.int64).max)
    others[np.arange(len(ints)), at] = distance
    others[row, centre] = ((ints[row] - centres[centre]) ** 2).sum(1)
    best = others.argmin(1)
    return best, others[np.arange(len(ints)), best], len(ints) + len(row)


def _assigner(centres: np.ndarray, axes: np.ndarray, leading: int):
    """Function from an Arrow batch to its integers, clusters and squared distances, by blocks."""
    centre_lead, centre_rest = rotated(centres, axes, leading)
    width = len(axes)

    def blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        for start in range(0, batch.num_rows, _BLOCK):
            own = batch.slice(start, _BLOCK)
            ints = _matrix(own.column("ints"), width)
            at, distance, _ = nearest(ints, _matrix(own.column("lead"), leading), np.asarray(own.column("rest")),
                                      centres, centre_lead, centre_rest)
            yield start, ints, at, distance

    return blocks


def _sums(centres: np.ndarray, axes: np.ndarray, leading: int):
    blocks = _assigner(centres, axes, leading)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, ints, at, _ in blocks(batch):
                order = np.argsort(at, kind="stable")
                clusters, begins = np.unique(at[order], return_index=True)
                yield pa.RecordBatch.from_pydict({
                    "cluster": pa.array(clusters, pa.int32()),
                    "n": pa.array(np.diff([*begins, len(at)]), pa.int64()),
                    "sums": pa.array(list(np.add.reduceat(ints[order], begins, axis=0)), pa.list_(pa.int64()))})

    return run


def _assigned(centres: np.ndarray, axes: np.ndarray, leading: int, key: str):
    blocks = _assigner(centres, axes, leading)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, _, at, distance in blocks(batch):
                yield pa.RecordBatch.from_pydict({
                    key: batch.column(key).slice(start, len(at)), "cluster": pa.array(at, pa.int32()),
                    "distance": pa.array(distance, pa.int64())})

    return run


def moved(kept: DataFrame, centres: np.ndarray, axes: np.ndarray, leading: int) -> np.ndarray:
    """The centroids after one round: componentwise floor of the exact mean, empty ones as they were."""
    parts = kept.mapInArrow(_sums(centres, axes, leading), "cluster int, n long, sums array<long>")
    rows = parts.select("cluster", "n", F.posexplode("sums").alias("at", "value")).groupBy("cluster", "at").agg(
        F.sum(F.col("n").cast("decimal(38,0)")).alias("n"),
        F.sum(F.col("value").cast("decimal(38,0)")).alias("total")).collect()
    after = centres.copy()
    for r in rows:
        after[r.cluster, r.at] = int(r.total) // int(r.n)
    return after


def first_centroids(ints: DataFrame, key: str, clusters: int) -> np.ndarray:
    """The vectors with the least sha256 of ``1:<key>``, in that order; a row without a key comes last."""
    rows = ints.select(F.sha2(F.concat(F.lit("1:"), F.col(key).cast("string")), 256).alias("mark"), "ints").orderBy(
        F.col("mark").asc_nulls_last(), "ints").limit(clusters).collect()
    return np.array([r.ints for r in rows], np.int64)


def cluster_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", width: int = WIDTH,
                    scale: int = SCALE, clusters: int = CLUSTERS, rounds: int = ROUNDS,
                    leading: int = LEADING) -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia, centroid_sha256: one row per usable vector.

    Null vectors, vectors of another length and those with null or non-finite components
    take no part.  Repeated rows are vectors of their own, also as first
    centroids; rows without a key are clustered too.  Fewer vectors than ``clusters``
    are as many centroids; ties go to the smaller number.  Other columns are ignored, no usable
    vector gives no rows.  A component beyond 2**27 after scaling is an error.
    """
    ints = integer_vectors(vectors, key, vector, width, scale)
    centres = first_centroids(ints, key, clusters)
    schema = f"`{key}` long, cluster int, distance long"
    if not len(centres):
        assigned = vectors.sparkSession.createDataFrame([], schema)
        centres = np.zeros((0, width), np.int64)
    else:
        axes = principal_axes(ints, width)
        kept = stored(ints.mapInArrow(_rotation(axes, leading, key),
                                      f"`{key}` long, ints array<long>, lead array<double>, rest double"), "rotated")
        for _ in range(rounds):
            centres = moved(kept, centres, axes, leading)
        assigned = stored(kept.mapInArrow(_assigned(centres, axes, leading, key), schema), "clusters")
    totals = {r.cluster: int(r.total) for r in assigned.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    about = pd.DataFrame({
        "cluster": pd.Series(range(len(centres)), dtype="int32"),
        "cluster_inertia": pd.Series([totals.get(i, 0) for i in range(len(centres))], dtype="int64"),
        "inertia": pd.Series([sum(totals.values())] * len(centres), dtype="int64"),
        "centroid_sha256": [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centres]})
    described = vectors.sparkSession.createDataFrame(
        about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(described), "cluster").select(
        key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_centroids(spark, folder: str) -> DataFrame:
    return cluster_vectors(spark.read.parquet(f"{folder}/embeddings.parquet"))


def _assigned_sql(at: int) -> str:
    """CTEs that assign all vectors to the centroids ``c{at}``."""
    return f"""
x{at} as (select v.row_no, c.cluster, list_sum(list_transform(list_zip(v.w, c.w), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as distance
          from v cross join c{at} c),
a{at} as (select row_no, min(distance) as distance, arg_min(cluster, (distance, cluster)) as cluster from x{at} group by row_no)"""


def _moved_sql(at: int) -> str:
    return f"""
s{at} as (select a.cluster, p.i, sum(v.w[p.i])::hugeint as total, count(*)::hugeint as n
          from a{at} a join v using (row_no) cross join (select unnest(range(1, {WIDTH + 1})) as i) p group by a.cluster, p.i),
m{at} as (select cluster, list((((total - ((total % n) + n) % n) // n))::bigint order by i) as w from s{at} group by cluster),
c{at + 1} as (select c.cluster, coalesce(m.w, c.w) as w from c{at} c left join m{at} m using (cluster))"""


OP11_SQL = f"""
with v as (select row_number() over () as row_no, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as w
           from embeddings where len(embedding) = {WIDTH} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c0 as (select (row_number() over (order by mark nulls last, w) - 1)::integer as cluster, w from (
       select sha256('1:' || vec_id) as mark, w from v) qualify row_number() over (order by mark nulls last, w) <= {CLUSTERS}),
{','.join(_assigned_sql(i) + ',' + _moved_sql(i) for i in range(ROUNDS))},
{_assigned_sql(ROUNDS)}
select vec_id, a.cluster, distance, sum(distance) over (partition by a.cluster)::bigint as cluster_inertia,
       sum(distance) over ()::bigint as inertia, sha256(array_to_string(c.w, ',')) as centroid_sha256
from a{ROUNDS} a join v using (row_no) join c{ROUNDS} c using (cluster)
"""
