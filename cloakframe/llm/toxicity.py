"""Toxic documents by weak supervision.

1. Voters say "toxic", "clean" or nothing about a document: themes of a lexicon, patterns of
   shape and density, and word beginnings mined from labelled training documents.
2. A generative label model estimates from the votes alone how often each voter says what in
   either class.  It begins with a majority over groups of voters that speak alike and goes on by expectation
   maximization; what the classes leave unexplained gives the correlations of the voters, and
   evidence of voters that move together is shared out among them.  Labels choose the voters and give
   the share of toxic documents, which is held; no posterior sees the label of its document.
3. The posteriors of a bounded sample train a linear classifier on the hashed words and word
   beginnings that tell the classes apart.  Labels set its threshold, on scores from folds that a
   document was not trained in; it scores every document.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, functions as F

from cloakframe.llm.learning import labelled_sample, with_labels
from cloakframe.llm.tables import forget, held_out, keyed_texts

#: Most labelled documents that mining, label model and classifier see.
MOST_TRAINED = 8000
#: Most word beginnings that vote.
MOST_MINED = 150
BUCKETS = 1 << 18
_KEPT = 150_000
#: Votes of one group correlate by so much; smaller correlations within the classes count as chance.
_ALIKE, _CHANCE = 0.8, 0.1
_FOLDS = 5
#: Labelled toxic documents from which on labels set the threshold.
_LEAST_TOXIC = 10
_WORD = regex.compile(r"[^\W\d_]+")

LEXICON = {
    "stupidity": "idiot idiots idiotic moron morons moronic stupid dumb imbecile dimwit halfwit "
                 "idiota estúpido estúpida imbécil tonto tonta idiote stupide imbécile crétin débile "
                 "dummkopf trottel schwachkopf idiotin blödmann",
    "worth": "worthless loser losers useless pathetic failure inútil patético patética fracasado "
             "minable raté wertlos versager jämmerlich erbärmlich",
    "dirt": "scum trash garbage filth filthy vermin rubbish basura escoria ordure déchet racaille "
            "abschaum müll dreck",
    "disgust": "disgusting repulsive revolting vile asqueroso repugnante dégoûtant répugnant "
               "widerlich ekelhaft abscheulich",
    "mockery": "clown clowns buffoon joke payaso bufón guignol bouffon witzfigur hampelmann",
    "hatred": "hate despise loathe odio odiar haine détester hasse hassen verachte",
    "abuse": "bastard bitch asshole shit fucking fuck crap cabrón mierda puta connard salope merde "
             "arschloch scheiße hurensohn",
}
_THEME = {word: i for i, words in enumerate(LEXICON.values()) for word in words.split()}


def beginnings(word: str) -> list[str]:
    """A word as a whole and its beginnings of three to eight characters."""
    return ["=" + word] + ["^" + word[:n] for n in range(3, min(8, len(word)) + 1)]


def bucket(unit: str) -> int:
    return xxhash.xxh32_intdigest(unit.encode("utf-8", "surrogatepass")) % BUCKETS


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class _Buckets(dict):
    """Buckets of a word's units, only those with a weight if weights are given."""

    def __init__(self, weights: np.ndarray | None = None):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> tuple:
        if len(self) >= _KEPT:
            self.clear()
        found = map(bucket, beginnings(word))
        value = self[word] = tuple(found if self.weights is None else (b for b in found if self.weights[b]))
        return value


def counted(words: list[str], known: dict) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the words and how often each occurs."""
    counts = Counter(chain.from_iterable(map(known.__getitem__, words)))
    return (np.fromiter(counts.keys(), np.int32, len(counts)),
            np.fromiter(counts.values(), np.float64, len(counts)))


def scaled(counts: np.ndarray, n_words: int) -> np.ndarray:
    return np.log1p(counts) / np.sqrt(n_words)


def _featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    forget()
    known = _Buckets()
    for batch in batches:
        out = []
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            words = words_of(text)
            themes = [_THEME[w] for w in words if w in _THEME]
            at, counts = counted(words, known)
            out.append((doc_id, len(words), len(themes), sum({1 << t for t in themes}), at, counts))
        yield pd.DataFrame(out, columns=["doc_id", "n_words", "hits", "themes", "buckets", "counts"])


_FEATURES = ("doc_id long, n_words int, hits int, themes int, buckets array<int>, "
             "counts array<double>")


def mine(buckets: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Telling units, strongest first, and how many times likelier each is in toxic documents.

    Buckets of words and beginnings in at least 4 toxic documents and at least 3 times likelier there.
    """
    def documents(label):
        found = [b for b, y in zip(buckets, labels) if y == label]
        return np.bincount(np.concatenate(found) if found else np.empty(0, np.int64), minlength=BUCKETS)

    toxic, clean = documents(1), documents(0)
    n1, n0 = max(1, int((labels == 1).sum())), max(1, int((labels == 0).sum()))
    odds = np.log((toxic + 0.5) / n1) - np.log((clean + 0.5) / n0)
    good = np.flatnonzero((toxic >= 4) & (odds >= np.log(3)))
    good = good[np.argsort(-odds[good] * np.sqrt(toxic[good]), kind="stable")]
    return good, np.exp(odds[good])


def vote(found: pd.DataFrame, mined: np.ndarray) -> np.ndarray:
    """Votes as +1 (toxic), -1 (clean) and 0, a column per voter: the themes, the mined
    units, two patterns of density, and two of absence."""
    themes = found["themes"].to_numpy()[:, None] >> np.arange(len(LEXICON)) & 1
    spoken = np.zeros((len(found), len(mined)), np.int8)
    for row, buckets in enumerate(found["buckets"]):
        spoken[row] = np.isin(mined, buckets)
    hits, n_words = found["hits"].to_numpy(), found["n_words"].to_numpy()
    n_mined = spoken.sum(1)
    return np.column_stack([
        themes, spoken, hits >= 2, n_mined >= 3, -((hits == 0) & (n_mined == 0)).astype(int),
        -((hits == 0) & (n_mined * 400 < n_words)).astype(int)]).astype(np.int8)


def _correlations(values: np.ndarray) -> np.ndarray:
    rest = values - values.mean(0)
    scale = np.sqrt((rest**2).mean(0)) + 1e-9
    found = (rest.T @ rest) / len(rest) / np.outer(scale, scale)
    np.fill_diagonal(found, 0)
    return found


def group_shares(votes: np.ndarray) -> np.ndarray:
    """For each voter one over the size of its group: voters linked by votes that correlate."""
    linked = _correlations(votes) >= _ALIKE
    group = np.arange(len(linked))
    while True:
        least = np.minimum(group, np.where(linked, group, len(group)).min(1, initial=len(group)))
        if (least == group).all():
            return 1 / np.bincount(group, minlength=len(group))[group]
        group = least


def label_model(votes: np.ndarray, start: np.ndarray | None = None, share: float | None = None,
                rounds: int = 40) -> np.ndarray:
    """P(toxic) of each row of ``votes``, from these alone.

    ``start`` holds first guesses, else a majority over groups of voters gives them.  ``share`` of
    toxic rows is held, else it is that of the majority.  How often a voter says what, silence too, is
    estimated in either class; its evidence is divided by one plus the sum of its
    correlations with others within the classes.
    """
    votes = votes.astype(np.float64)
    weights = group_shares(votes)
    score = votes @ weights
    share = float(np.clip((score > 0).mean() if share is None else share, 0.005, 0.995))
    if start is None:
        cut = np.sort(score)[::-1][min(len(score) - 1, round(share * len(score)))]
        start = score > cut if (score > cut).any() else score >= cut
    p = np.where(np.asarray(start) > 0.5, 0.9, 0.1)
    said = [(votes == v).astype(np.float64) for v in (-1, 0, 1)]
    for at in range(rounds):
        n1, n0 = p.sum() + 1, (1 - p).sum() + 1
        rates1 = [(s.T @ p + 0.2) / (n1 + 0.6) for s in said]
        rates0 = [(s.T @ (1 - p) + 0.2) / (n0 + 0.6) for s in said]
        if at >= 2:
            mean1, mean0 = rates1[2] - rates1[0], rates0[2] - rates0[0]
            together = _correlations(votes - p[:, None] * mean1 - (1 - p)[:, None] * mean0)
            weights = 1 / (1 + np.where(together > _CHANCE, together, 0).sum(1))
        logit = np.log(share / (1 - share)) + sum(
            s @ (weights * (np.log(a) - np.log(b))) for s, a, b in zip(said, rates1, rates0))
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return p


def linear(rows: list[tuple[np.ndarray, np.ndarray]], p: np.ndarray, epochs: int = 12,
           rate: float = 0.3, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights per bucket and an offset, by adaptive SGD on soft labels with both classes
    given the weight of the square root of their share."""
    rng = np.random.default_rng(seed)
    weights, past, offset = np.zeros(BUCKETS), np.full(BUCKETS, 1e-3), 0.0
    share = float(np.clip(p.mean(), 0.01, 0.99)) if len(p) else 0.5
    up = np.sqrt((1 - share) / share)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            now = 1 / (1 + np.exp(-np.clip(weights[at] @ x + offset, -30, 30)))
            error = p[i] * up * (now - 1) + (1 - p[i]) * now
            step = error * x + 1e-5 * weights[at]
            past[at] += step * step
            weights[at] -= rate * step / np.sqrt(past[at])
            offset -= 0.02 * error
    return weights, offset


def best_threshold(logits: np.ndarray, labels: np.ndarray) -> float:
    """The threshold of best agreement with the labels (by F1) that calls between half and
    twice the share of toxic labels toxic."""
    order = np.argsort(-logits, kind="stable")
    called = np.arange(1, len(order) + 1)
    f1 = 2 * np.cumsum(labels[order]) / (called + max(1, labels.sum()))
    allowed = np.flatnonzero((2 * called >= labels.sum()) & (called <= 2 * labels.sum()) & (called < len(order)))
    if not len(allowed):
        return 0.0
    at = allowed[np.argmax(f1[allowed])]
    return float(logits[order[at]] + logits[order[at + 1]]) / 2


def posteriors(found: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The telling units, and P(toxic) of the featured, labelled documents by their votes."""
    labels = found["label"].to_numpy()
    telling, likelier = mine(list(found["buckets"]), labels)
    voters = np.sort(telling[likelier >= 8][:MOST_MINED])
    return telling, label_model(vote(found, voters), share=labels.mean())


def learn(found: pd.DataFrame) -> tuple[np.ndarray, float]:
    """Voters, label model and classifier from featured, labelled documents."""
    if not len(found):
        return np.zeros(BUCKETS), -1.0
    labels = found["label"].to_numpy()
    telling, p = posteriors(found)
    told = np.zeros(BUCKETS, bool)
    told[telling] = True
    rows = [(b[told[b]], scaled(c[told[b]], n)) for b, c, n in zip(found["buckets"], found["counts"], found["n_words"])]
    weights, offset = linear(rows, p)
    if not _LEAST_TOXIC <= labels.sum() < len(labels):
        return weights, offset
    logits, fold = np.empty(len(rows)), np.arange(len(rows)) % _FOLDS
    for own in range(_FOLDS):
        apart, level = linear([r for r, f in zip(rows, fold) if f != own], p[fold != own])
        for i in np.flatnonzero(fold == own):
            logits[i] = apart[rows[i][0]] @ rows[i][1] + level
    return weights, offset - best_threshold(logits, labels)


def score(text: str, known: dict, weights: np.ndarray, offset: float) -> float:
    """Probability that the text is toxic; the offset alone for a text without words."""
    words, logit = words_of(text), offset
    if words:
        at, counts = counted(words, known)
        if len(at):
            logit += weights[at] @ scaled(counts, len(words))
    return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_TRAINED) -> tuple[np.ndarray, float]:
    """Learn from at most ``most`` labelled documents outside the held-out fifth."""
    found = labelled_sample(docs, labels, "toxic", most).mapInPandas(_featured, _FEATURES)
    return learn(with_labels(found, labels, "toxic"))


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5,
                   most: int = MOST_TRAINED) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of ``docs``.

    ``score`` is the probability of being toxic.  Learning takes at most ``most`` labelled
    documents outside the held-out fifth.  A null text or one without words gets the score of
    the offset, well below one half where clean documents prevail.  Repeated rows
    are scored alike; rows without a doc_id too, and are not held out; without any
    label nothing is toxic (all scores 0.27).  Other columns are ignored, an empty table gives no rows.
    """
    weights, offset = fit(docs, labels, most)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Buckets(weights)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"],
                                "score": [score(t, known, weights, offset) for t in batch["text"]]})

    return keyed_texts(docs).mapInPandas(run, "doc_id long, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5,
                  most: int = MOST_TRAINED) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, as they are."""
    weights, offset = fit(docs, labels, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        known = _Buckets(weights)
        for batch in batches:
            yield batch.filter(pa.array([score(t.as_py() or "", known, weights, offset) < threshold
                                         for t in batch.column("text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op10_toxicity(spark, folder: str) -> DataFrame:
    return score_toxicity(spark.read.parquet(f"{folder}/documents.parquet"),
                          spark.read.parquet(f"{folder}/labels.parquet"))
