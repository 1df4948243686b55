"""Bounded training samples for the two classifiers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cloakframe.llm.tables import held_out, keyed_texts, stored


def labelled_ids(labels: DataFrame, label: str) -> DataFrame:
    """doc_id and label (the larger one if labels differ) outside the held-out fifth."""
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"),
                         F.col(label).cast("int").alias("label")).filter(
        F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    ).groupBy("doc_id").agg(F.max("label").alias("label"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """doc_id and text of at most ``most`` labelled documents outside the held-out fifth.

    Those with the least hashes of their ids: the same in every run, spread over all
    sources.  At most ``most`` ids are broadcast.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(
        labelled_ids(labels, label), "doc_id", "left_semi").distinct()
    chosen = stored(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), "sample-ids")
    return keyed_texts(docs).join(F.broadcast(chosen), "doc_id", "left_semi")


def with_labels(featured: DataFrame, labels: DataFrame, label: str) -> pd.DataFrame:
    """The featured sample with its labels, one row per doc_id, in order, for training."""
    found = featured.join(labelled_ids(labels, label), "doc_id").toArrow().to_pandas()
    return found.sort_values("doc_id", kind="stable").drop_duplicates("doc_id").reset_index(drop=True)
