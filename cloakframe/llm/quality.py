"""Quality of documents: supervised subword embeddings, averaged, with a softmax on top.

Words and their character n-grams are hashed to buckets, each with a learned vector.
A document is the mean of the vectors of all its units; a softmax over two classes
follows.  Vectors and softmax are trained by stochastic gradient descent on a bounded
sample of labelled documents.  As everything behind the mean is linear, scoring needs
one number per bucket, and each different word is worked out once per task.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from cloakframe.llm.learning import labelled_sample, with_labels
from cloakframe.llm.tables import Kept, held_out, kept_in_process, keyed_texts

BUCKETS = 1 << 15
WIDTH = 8
#: Most labelled documents that training sees.
MOST_TRAINED = 3000
_KEPT = 300_000
_REPEAT = 0  # the bucket of "the same word again"


def units(word: str, buckets: int = BUCKETS) -> list[int]:
    """Buckets of a word and its n-grams of three and four characters, ends marked."""
    marked = f"<{word}>"
    grams = [marked]
    for n in (3, 4):
        grams += [marked[i:i + n] for i in range(len(marked) - n + 1)]
    return [1 + xxhash.xxh32_intdigest(g.encode("utf-8", "surrogatepass")) % (buckets - 1) for g in grams]


def features(text: str, known: dict, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text and how often each occurs."""
    words = text.split()
    found = [known.get(w) or known.setdefault(w, units(w, buckets)) for w in words]
    every = np.concatenate(found) if found else np.empty(0, np.int64)
    again = sum(map(eq, words, words[1:]))
    counts = np.bincount(every, minlength=1)
    counts[_REPEAT] = 4 * again
    at = np.flatnonzero(counts)
    return at.astype(np.int32), counts[at].astype(np.float32)


def _featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known: dict = {}
    for batch in batches:
        if len(known) > _KEPT:
            known.clear()
        both = [features(t, known) for t in batch["text"]]
        yield pd.DataFrame({"doc_id": batch["doc_id"], "buckets": [b for b, _ in both],
                            "counts": [c for _, c in both]})


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 6, rate: float = 1.0,
          seed: int = 1) -> tuple[np.ndarray, float]:
    """A weight per bucket and an offset: the logit of label 1, trained by SGD."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-0.5, 0.5, (BUCKETS, WIDTH)).astype(np.float32)
    soft = np.zeros((WIDTH, 2), np.float32)
    offset = np.zeros(2, np.float32)
    rows = [(b, (c / c.sum())[:, None], y) for b, c, y in rows if len(b)]
    step, steps = 0, epochs * max(1, len(rows))
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            buckets, share, label = rows[i]
            now = rate * (1 - step / steps)
            step += 1
            mean = (vectors[buckets] * share).sum(0)
            logit = mean @ soft + offset
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[label] -= 1
            back = soft @ p
            soft -= now * mean[:, None] * p
            offset -= 0.1 * now * p
            vectors[buckets] -= (now * 20) * np.minimum(share, 0.05) * back  # few units must not overshoot
    return (vectors @ (soft[:, 1] - soft[:, 0])).astype(np.float64), float(offset[1] - offset[0])


def weighed(weights: np.ndarray) -> Kept:
    """For each word the sum of its weights (real part) and its number of units (imaginary part)."""
    def make(word: str) -> complex:
        at = units(word)
        return complex(weights[at].sum(), len(at))

    return kept_in_process("quality", xxhash.xxh3_64_intdigest(weights.tobytes()), lambda: make)


def score(text: str, known: Kept, weights: np.ndarray, offset: float) -> float:
    words = text.split()
    again = 4 * sum(map(eq, words, words[1:]))
    total = sum(map(known.__getitem__, words), complex(again * weights[_REPEAT], again))
    logit = offset + (total.real / total.imag if total.imag else 0.0)
    return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_TRAINED) -> tuple[np.ndarray, float]:
    """Learn from at most ``most`` labelled documents outside the held-out fifth."""
    found = with_labels(labelled_sample(docs, labels, "quality", most).mapInPandas(
        _featured, "doc_id long, buckets array<int>, counts array<float>"), labels, "quality")
    return train(list(zip(found["buckets"], found["counts"], found["label"])))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3,
                  most: int = MOST_TRAINED) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of ``docs``.

    ``score`` is the probability of label 1.  Learning takes at most ``most`` labelled
    documents outside the held-out fifth.  A null or blank text gets the score of
    no units, the prior.  Without labels every such score is one half.  Repeated rows
    are scored alike; rows without a doc_id too, and are not held out; other columns
    are ignored, an empty table gives no rows.
    """
    weights, offset = fit(docs, labels, most)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = weighed(weights)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"],
                                "score": [score(t, known, weights, offset) for t in batch["text"]]})

    return keyed_texts(docs).mapInPandas(run, "doc_id long, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def op6_quality(spark, folder: str) -> DataFrame:
    return score_quality(spark.read.parquet(f"{folder}/documents.parquet"),
                         spark.read.parquet(f"{folder}/labels.parquet"))
