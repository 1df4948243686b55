import zlib

import numpy as np
import pytest

from cloakframe.llm import quality, toxicity
from cloakframe.llm.quality import op6_quality, score_quality
from cloakframe.llm.toxicity import label_model, op10_toxicity, score_toxicity, without_toxic

FOLDER = "/root/testdata/sf0.1"


@pytest.mark.parametrize("query, label, threshold, least", [
    (op6_quality, "quality", 0.3, 0.98), (op10_toxicity, "toxic", 0.5, 0.97)])
def test_held_out_accuracy(spark, query, label, threshold, least):
    rows = {r.doc_id: r for r in query(spark, FOLDER).collect()}
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    right = []
    for r in rows.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)
    for x in spark.read.parquet(f"{FOLDER}/labels.parquet").collect():
        if rows[x.doc_id].held_out:
            right.append(rows[x.doc_id].predicted == x[label])
    print(label, np.mean(right))
    assert len(right) > 500 and np.mean(right) >= least


@pytest.mark.parametrize("score", [score_quality, score_toxicity])
def test_odd_rows(spark, docs_of, score):
    docs = docs_of([(1, "a clean text"), (2, None), (3, ""), (4, "x " * 20000), (None, "a clean text"), (1, "a clean text")])
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, None), (None, 1, 1), (8, 0, 1)],
                                   "doc_id long, quality int, toxic int")
    rows = score(docs, labels).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (None, 1)}) == 1
    assert [r.held_out for r in rows if r.doc_id is None] == [False]
    none = labels.limit(0)
    assert {round(r.score, 2) for r in score(docs, none).collect()} == {0.5 if score is score_quality else 0.27}
    assert score(docs_of([]), none).count() == 0 and score(docs_of([]), labels).count() == 0


def test_labels_of_held_out_rows_are_not_used(spark, docs_of):
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 0]
    docs = docs_of([(i, f"word{i % 7} other") for i in range(60)])
    make = lambda y: spark.createDataFrame(
        [(i, y if i in held else i % 2, y if i in held else i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    for score in (score_quality, score_toxicity):
        a, b = (sorted((r.doc_id, r.score) for r in score(docs, make(y)).collect()) for y in (0, 1))
        assert a == b


def test_label_model_finds_reliable_voters():
    rng = np.random.default_rng(0)
    y = rng.random(3000) < 0.2
    right = np.array([0.95, 0.8, 0.8, 0.8, 0.6])
    votes = np.where(rng.random((3000, 5)) < right, y[:, None] * 2 - 1, 1 - y[:, None] * 2)
    votes[rng.random((3000, 5)) < 0.3] = 0
    votes = np.column_stack([votes, votes[:, 4], votes[:, 4], votes[:, 4]])  # one poor voter four times
    p = label_model(votes, (votes.sum(1) > 0).astype(float))
    assert ((p > 0.5) == y).mean() > 0.93


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_label_model_without_a_start(seed):
    """Close to the best possible decision, though one poor voter speaks four times."""
    rng = np.random.default_rng(seed)
    y = rng.random(3000) < 0.2
    right = np.array([0.95, 0.8, 0.8, 0.8, 0.6])
    votes = np.where(rng.random((3000, 5)) < right, y[:, None] * 2 - 1, 1 - y[:, None] * 2)
    votes[rng.random((3000, 5)) < 0.3] = 0
    best = (votes @ np.log(right / (1 - right)) + np.log(0.2 / 0.8) > 0) == y
    votes = np.column_stack([votes, votes[:, 4], votes[:, 4], votes[:, 4]])
    for share in (None, 0.2):
        p = label_model(votes, share=share)
        assert ((p > 0.5) == y).mean() > best.mean() - 0.01 and abs(p.mean() - 0.2) < 0.03
    assert toxicity.group_shares(votes).tolist() == [1, 1, 1, 1, 0.25, 0.25, 0.25, 0.25]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_posteriors_from_votes_agree_with_labels(spark, sf):
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.with_labels(toxicity.labelled_sample(docs, labels, "toxic", toxicity.MOST_TRAINED).mapInPandas(
        toxicity._featured, toxicity._FEATURES), labels, "toxic")
    _, p = toxicity.posteriors(found)
    y = found["label"].to_numpy()
    print(sf, ((p > 0.5) == y).mean())
    assert ((p > 0.5) == y).mean() >= 0.9
    # a label moves no posterior of its own document but through the choice of voters
    votes = toxicity.vote(found, np.arange(5))
    assert (label_model(votes, share=0.1) == label_model(votes[::-1], share=0.1)[::-1]).all() or np.allclose(
        label_model(votes, share=0.1), label_model(votes[::-1], share=0.1)[::-1])
    scored = {r.doc_id: r for r in score_toxicity(docs, labels).collect()}
    held = [(x.toxic, scored[x.doc_id].predicted) for x in labels.filter("toxic is not null").collect() if scored[x.doc_id].held_out]
    right = sum(a == b for a, b in held) / len(held)
    both = sum(a and b for a, b in held)
    f1 = 2 * both / max(1, sum(a for a, _ in held) + sum(b for _, b in held))
    print(sf, "held out", right, f1)
    assert right >= 0.9 and (sf != "sf0.1" or f1 >= 0.9)


def test_one_very_long_word(spark, docs_of):
    """The end of a long word counts too."""
    long = "x" * 300
    docs = docs_of([(i, long + ("tail" if i % 2 else "other")) for i in range(60)])
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    rows = score_quality(docs, labels).collect()
    assert min(r.score for r in rows if r.doc_id % 2) > max(r.score for r in rows if not r.doc_id % 2)
    assert score_toxicity(docs, labels).count() == 60


def test_filter_keeps_rows_as_they_are(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    kept = without_toxic(docs, labels)
    assert kept.schema == docs.schema
    wanted = {r.doc_id for r in score_toxicity(docs, labels).filter("predicted = 0").collect()}
    assert {r.doc_id for r in kept.select("doc_id").collect()} == wanted
    assert kept.join(docs, docs.columns, "left_anti").count() == 0


def test_bounds_are_parameters(spark, docs_of):
    assert quality.MOST_TRAINED <= 10_000 and toxicity.MOST_TRAINED <= 10_000
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    docs = docs_of([(i, "good words" if i % 2 else "bad things") for i in range(40)])
    assert score_quality(docs, labels, most=5).count() == 40


def test_scoring_drops_what_other_stages_keep():
    """A worker process that packed before does not hold its table of tokens while it scores."""
    from cloakframe.llm import tables

    tables.in_process("tokens", "file", lambda: {"a": b"1"})
    assert tables._in_process
    assert list(toxicity._featured(iter([]))) == []
    assert not tables._in_process
