import hashlib
import math

import duckdb
import numpy as np
import pytest

from cloakframe.llm.centroids import (
    OP11_SQL, cluster_vectors, lower_bounds, nearest, op11_centroids, principal_axes, rotated, integer_vectors)

VECTORS = "vec_id long, embedding array<double>, label string, cluster string, lead int"


def brute(rows, width, clusters, rounds=3):
    kept = [(k, [math.floor(64 * x) for x in v]) for k, v in rows
            if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    marks = sorted((k is None, hashlib.sha256(f"1:{k}".encode()).hexdigest() if k is not None else "", v) for k, v in kept)
    centres = [v for _, _, v in marks[:clusters]]

    def assign():
        out = []
        for _, v in kept:
            far = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centres]
            out.append((far.index(min(far)), min(far)))
        return out

    for _ in range(rounds):
        at = assign()
        for c in range(len(centres)):
            own = [v for (_, v), (x, _) in zip(kept, at) if x == c]
            if own:
                centres[c] = [sum(col) // len(own) for col in zip(*own)]
    at = assign()
    inertia = [sum(d for c, d in at if c == x) for x in range(len(centres))]
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((k, c, d, inertia[c], sum(inertia), marks[c]) for (k, _), (c, d) in zip(kept, at)), key=repr)


def test_whole_table(spark, medium):
    got = sorted(map(tuple, op11_centroids(spark, medium).collect()))
    con = duckdb.connect()
    con.sql(f"create view embeddings as from '{medium}/embeddings.parquet'")
    assert got == sorted(con.sql(OP11_SQL).fetchall())
    table = spark.read.parquet(f"{medium}/embeddings.parquet")
    assert sorted(got, key=repr) == brute([(r.vec_id, r.embedding) for r in table.collect()], 64, 16)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_odd_vectors(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, 4) / 64]) for i in range(60)]  # many ties
    rows += rows[:10]  # repeated
    rows += [(None, [0.1, 0.2, 0.3, 0.4]), (None, [1.0, 0.0, 0.0, 0.0]), (100, None), (101, []), (102, [1.0]),
             (103, [1.0, None, 2.0, 3.0]), (104, [math.nan, 0.0, 0.0, 0.0]), (105, [math.inf, 0.0, 0.0, 0.0]),
             (106, [-0.001, 0.001, 1e5, -1e5]), (7, [0.5, 0.5, 0.5, 0.5])]
    df = spark.createDataFrame([(k, v, "x", "y", 1) for k, v in rows], VECTORS)
    got = cluster_vectors(df, width=4, clusters=5, leading=2).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 4, 5)


def test_few_and_no_vectors(spark):
    three = [(1, [0.5, 1.0]), (2, [0.25, 0.0]), (3, [9.0, 9.0])]
    df = spark.createDataFrame([(k, v, "x", "y", 1) for k, v in three], VECTORS)
    got = cluster_vectors(df, width=2, clusters=16, leading=1).collect()
    assert sorted(map(tuple, got)) == brute(three, 2, 16)
    assert cluster_vectors(df.limit(0), width=2).count() == 0
    assert cluster_vectors(df, width=3).count() == 0
    same = spark.createDataFrame([(1, [0.5, 1.0], "x", "y", 1)] * 40, VECTORS)
    got = cluster_vectors(same, width=2, clusters=4, leading=1).collect()
    assert len(got) == 40 and {(r.cluster, r.distance, r.inertia) for r in got} == {(0, 0, 0)}


def test_component_too_large_is_an_error(spark):
    df = spark.createDataFrame([(1, [1e9, 0.0], "x", "y", 1)], VECTORS)
    with pytest.raises(Exception, match="would not fit 64 bits"):
        cluster_vectors(df, width=2).collect()


def test_bounds_never_exceed_distances_and_filter(spark):
    rng = np.random.default_rng(0)
    centres = rng.integers(-500, 500, (16, 64))
    ints = centres[rng.integers(0, 16, 3000)] + rng.integers(-40, 40, (3000, 64))
    _, _, axes = np.linalg.svd(ints - ints.mean(0), full_matrices=True)
    axes = axes.T
    lead, rest = rotated(ints, axes, 16)
    c_lead, c_rest = rotated(centres, axes, 16)
    exact = ((ints[:, None, :] - centres) ** 2).sum(2)
    assert (lower_bounds(lead, rest, c_lead, c_rest) <= exact).all()
    at, distance, compared = nearest(ints, lead, rest, centres, c_lead, c_rest)
    assert (at == exact.argmin(1)).all() and (distance == exact.min(1)).all()
    assert compared < 1.1 * len(ints)  # of 16 distances each


def test_axes_are_those_of_the_covariance(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 4)) * [1, 9, 3, 0.5]
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    axes = principal_axes(integer_vectors(df, width=4), 4)
    assert np.allclose(axes.T @ axes, np.eye(4)) and [int(abs(a).argmax()) for a in axes.T] == [1, 2, 0, 3]
