"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cloakframe.llm.tables import stored
from cloakframe.operators.spread import spread_join


def _least(edges: DataFrame) -> DataFrame:
    """For each node the least of itself and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
    return both.groupBy("u").agg(F.min("v").alias("low")).select(
        "u", F.least("u", "low").alias("low")
    )


def _large_star(edges: DataFrame) -> DataFrame:
    """Each neighbour above a node is linked to the node's least neighbour (u > v in the result)."""
    up = edges.select(F.col("v").alias("u"), F.col("u").alias("above"))
    return spread_join(up, _least(edges), ["u"], "inner").select(
        F.col("above").alias("u"), F.col("low").alias("v")
    ).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its neighbours below are linked to the least of these."""
    low = edges.groupBy("u").agg(F.min("v").alias("low"))
    moved = spread_join(edges, low, ["u"], "inner").filter("v != low").select(
        F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.union(low.select("u", F.col("low").alias("v"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for all nodes of ``links`` (a, b).

    Links may be repeated, point either way or join a node with itself (such a
    node alone is its own component); a link with a null end is left out.  Every
    round is written to the shared folder, so a lost executor costs one round.
    No links: no rows.
    """
    pairs = links.filter("a is not null and b is not null")
    alone = pairs.filter("a = b").select(F.col("a").alias("node")).distinct()
    edges = stored(pairs.filter("a != b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")

    def mark(table: DataFrame):
        return table.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = mark(edges)
    while before[0]:
        edges = stored(_small_star(_large_star(edges)), "stars")
        after = mark(edges)
        if after == before:
            break
        before = after
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    rest = alone.join(found.select("node").union(roots.select("node")), "node", "left_anti")
    return found.union(roots).union(rest.select("node", F.col("node").alias("component")))
