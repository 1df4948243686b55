import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from cloakframe.llm import maxent as m
from cloakframe.llm.maxent import op13_lm_scores, score_texts


def out(k):
    return k is not None and zlib.crc32(str(k).encode()) % 7 == 2


def brute(rows):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score) by plain counting."""
    def tokens(text):
        return m.tokens_of(text or "")

    c = Counter(t for k, text in rows if not out(k) for t in tokens(text))
    n, v = sum(c.values()), len(c)
    return [(k, out(k), len(tokens(text)), sum(c[t] > 0 for t in tokens(text)), n,
             sum(math.log10((c[t] + 1) / (n + v + 1)) for t in tokens(text))) for k, text in rows]


def check(got, rows):
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=repr)
    wanted = sorted(brute(rows), key=repr)
    assert len(got) == len(wanted)
    for a, b in zip(sorted(got, key=lambda r: (repr(r[0]), r[2:4], round(r[5], 6))),
                    sorted(wanted, key=lambda r: (repr(r[0]), r[2:4], round(r[5], 6)))):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-9)


def test_whole_table(spark, medium):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{medium}/documents.parquet").collect()]
    got = op13_lm_scores(spark, medium).collect()
    check(got, rows)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_model_beats_the_base_on_held_out_texts(spark):
    got = op13_lm_scores(spark, "/root/testdata/sf0.1").filter("held_out").selectExpr(
        "sum(score) as own", "sum(base_score) as base", "sum(n_tokens) as n").first()
    print(got.own / got.n, got.base / got.n)
    assert got.own / got.n > got.base / got.n + 0.1  # log10 a token


def test_odd_rows(spark, docs_of):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["a", "B", "c\x1cd", "É", "x" * 300]) for _ in range(rng.randint(0, 9)))) for i in range(90)]
    rows += [(1, "a b"), (1, "a b"), (None, "a new\nword"), (None, None), (200, ""), (201, None), (202, "  \t\x0b\x0c\r "),
             (203, "z " * 60000), (204, "only here \xa0"), (5, "zz " * 3)]
    for lookup in (1 << 17, 3, 1):
        got = score_texts(docs_of(rows), lookup).collect()
        check(got, rows)
        assert all(math.isfinite(r.score) for r in got)
    same = {}
    for r in got:
        same.setdefault((r.doc_id, r.n_tokens, r.n_known), set()).add(round(r.score, 9))
    assert len(same[1, 3, 3]) == 1
    assert score_texts(docs_of([])).count() == 0
    held = next(i for i in range(100) if out(i))
    r, = score_texts(docs_of([(held, "nothing was learned")])).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (4, 0, 0, 0.0, 0.0)


def vocabulary(counts):
    top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))
    return m.Vocabulary([t for t, _ in top], np.array([n for _, n in top], np.int64),
                        min(len(top), m.CLASSES * m.PER_CLASS), sum(counts.values()), len(counts))


@pytest.mark.parametrize("words", [5, 40, 1500])
def test_probabilities_add_up(words):
    """Over every known token and one unknown, behind any history and with any weights."""
    rng = np.random.default_rng(words)
    counts = {b"w%d" % i: int(rng.integers(1, 900)) for i in range(words)} | {m.END: 50}
    v = vocabulary(counts)
    weights = [rng.normal(size=w.shape).astype(np.float32) for w in m.no_weights()]
    total = 0.0
    for token in [*counts, b"unknown"]:
        if token == m.END:
            tokens = m._Tokens(["w1 w2"], v)
        else:
            tokens = m._Tokens(["w1 w2 " + token.decode()], v)
        total += math.exp(m.log_probabilities(tokens, v, weights)[2])
    assert total == pytest.approx(1, abs=1e-4)


def test_steps_are_gradients():
    """One step from zero weights moves every row against the numeric gradient of the loss."""
    v = vocabulary({b"a": 5, b"b": 3, b"c": 2, m.END: 4} | {b"t%d" % i: 1 for i in range(2000)})
    tokens = m._Tokens(["a b c a a t7 b", "c t9 a"], v)
    weights, own = m.no_weights(), m.no_weights()
    past, touched = [np.ones(m.ROWS, np.float32) for _ in own], [np.zeros(m.ROWS) for _ in own]
    m.learn(tokens, v, own, past, touched, 1.0)

    def loss(w):
        return -m.log_probabilities(tokens, v, w).sum()

    for level in (0, 1):
        moved = np.flatnonzero(touched[level])
        assert 0 < len(moved) < 60 and (own[level][touched[level] == 0] == 0).all()
        for row in moved[::3]:
            for column in (0, 1, 5):
                up, down = m.no_weights(), m.no_weights()
                up[level][row, column] += 0.05
                down[level][row, column] -= 0.05
                gradient = (loss(up) - loss(down)) / 0.1
                step = own[level][row, column] * np.sqrt(past[level][row])
                assert step == pytest.approx(-gradient, abs=2e-2)


def test_row_sums():
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 1000):
        rows, errors = (rng.zipf(1.5, (3, n)) % 40).astype(np.uint16), rng.normal(size=(n, 4)).astype(np.float32)
        at, sizes, sums = m.row_sums(rows, errors)
        wanted = np.zeros((40, 4))
        for own in rows:
            np.add.at(wanted, own, errors)
        assert at.tolist() == sorted(set(rows.ravel().tolist())) and np.allclose(sums, wanted[at], atol=1e-4)
        assert sizes.tolist() == [int((rows == x).sum()) for x in at]


def test_vocabulary_is_bounded(spark):
    for most, least in ((5, 12), (4, 20), (3, 1 << 62), (1000, 1)):
        counts = spark.createDataFrame([(b"t%d" % i, 1, 20 if i < 4 else max(1, 16 - i)) for i in range(100)],
                                       "token binary, n long, every long")
        found = m._least_count(counts, most)
        assert found == least and counts.filter(f"every >= {found}").count() <= most


def test_averages_in_a_tree_weigh_by_tokens():
    import pandas as pd

    n1, n2 = np.full(m._SHARD, 1.0), np.full(m._SHARD, 3.0)
    n2[5] = 0
    one, two = np.full((m._SHARD, m.PER_CLASS), 1.0), np.full((m._SHARD, m.PER_CLASS), 2.0)
    group = pd.DataFrame([m._packed(1, 4, 70, n2, two), m._packed(1, 4, 64, n1, one)])
    r = m._averaged(group).iloc[0]
    change = np.frombuffer(r["change"], np.float16).reshape(m._SHARD, m.PER_CLASS)
    assert (r["level"], r["shard"], r["part"]) == (1, 4, 1) and (change[0] == 1.75).all() and (change[5] == 1).all()
    assert np.frombuffer(r["n"], np.float32)[0] == 4


def test_modelled_tokens_do_not_depend_on_the_lookup(spark):
    """More tokens of one count than are sent: those to be modelled come all the same."""
    rows = [(b"t%04d" % i, 5, 5) for i in range(700)] + [(b"often", 9, 9), (b"held", 0, 50)]
    counts = spark.createDataFrame([(bytearray(t), n, e) for t, n, e in rows], "token binary, n long, every long")
    most = m.CLASSES * m.PER_CLASS
    whole = m.vocabulary(counts)
    for lookup in (1, 100, 699):
        v = m.vocabulary(counts, lookup)
        assert v.modelled == most and v.tokens[:most] == whole.tokens[:most]
        assert (v.total, v.distinct) == (whole.total, whole.distinct) == (3509, 701)
    assert whole.tokens[:2] == [b"often", b"t0000"]


def test_row_sums_take_no_rounds_over_single_rows():
    """Sums of rows that lie by powers of two: rows that occur once are copied, no other row is moved twice."""
    rng = np.random.default_rng(6)
    errors = rng.normal(size=(300, 5)).astype(np.float32)
    for times in (1, 2, 3, 255, 256, 257, 300):
        rows = np.full((1, 300), 7, np.uint16)
        rows[0, times:] = 100 + np.arange(300 - times)
        at, sizes, sums = m.row_sums(rows, errors)
        assert at[0] == 7 and sizes[0] == times and (sizes[1:] == 1).all() and (sums[1:] == errors[times:]).all()
        pairs = errors[:times]
        while len(pairs) > 1:  # neighbours in pairs, the last of an odd number as it is
            odd = pairs[len(pairs) // 2 * 2:]
            pairs = np.concatenate([pairs[:-1:2] + pairs[1::2], odd])
        assert (sums[0] == pairs[0]).all()


def test_only_rare_tokens_outlive_their_text():
    v = vocabulary({b"a": 5, m.END: 2})
    tokens = m._Tokens(["a x a", "", "y a"], v)
    assert tokens.rare_tokens == [b"x", b"y"] and tokens.rare.tolist() == [1, 5]
    assert tokens.sizes.tolist() == [4, 1, 3] and v.index.rare is tokens.rare_tokens and b"x" not in v.index
    assert m._Tokens(["z"], v).rare_tokens == [b"z"] and tokens.rare_tokens == [b"x", b"y"]


def test_tokens_outside_the_classes_depend_on_what_came_before(spark, docs_of):
    """Far more tokens than there are places in classes, each of them behind one other token only."""
    pairs = [(f"a{i}", f"b{i}") for i in range(1500)]
    learned = [i for i in range(8000) if not out(i)][:6000]
    held = [i for i in range(30000) if out(i)][:3000]
    texts = [f"{a} {b}" for a, b in pairs * 4]
    others = [f"{a} {pairs[(i * 7 + 1) % 1500][1]}" for i, (a, _) in enumerate(pairs)]
    rows = [*zip(learned, texts), *zip(held, [f"{a} {b}" for a, b in pairs] + others)]
    for lookup in (1 << 17, 700, 1):  # by far most tokens of the tail are sent, some are, none is
        got = {r.doc_id: r for r in score_texts(docs_of(rows), lookup).collect()}
        met, unmet = (np.mean([got[k].score for k in own]) for own in (held[:1500], held[1500:]))
        base = np.mean([got[k].base_score for k in held])
        assert base == pytest.approx(np.mean([got[k].base_score for k in held[:1500]]))
        assert met > unmet + 0.3 and met > base + 0.3


@pytest.mark.parametrize("known, rare, buckets", [(30, 0, 2), (700, 900, 64), (512, 300, 2), (2000, 5, 16)])
def test_probabilities_add_up_over_sent_and_rare_tokens(known, rare, buckets):
    """Behind one history, over all that are sent, all rare ones in the trees of their buckets, and one unknown."""
    import pyarrow as pa

    rng = np.random.default_rng(known)
    sent = sorted(((b"w%d" % i, int(rng.integers(40, 900))) for i in range(known)), key=lambda x: (-x[1], x[0]))
    seldom = [(b"r%d" % i, int(rng.integers(1, 30))) for i in range(rare)]
    held = np.zeros(buckets, np.int64)
    for t, n in seldom:
        held[m._hash(t) >> (65 - buckets.bit_length())] += n + 1
    v = m.Vocabulary([t for t, _ in sent], np.array([n for _, n in sent], np.int64), min(known, 512),
                     sum(n for _, n in sent + seldom), known + rare, held)
    weights = [rng.normal(size=w.shape).astype(np.float32) for w in m.no_weights()]
    def last(token):
        tokens = m._Tokens(["w1 w2 " + token.decode()], v)
        return tokens, m.log_probabilities(tokens, v, weights)[2]

    total = sum(math.exp(last(t)[1]) for t, _ in sent)
    tokens, unknown = last(b"unknown")
    total += math.exp(unknown)
    assert tokens.rare_tokens[0] == b"unknown"
    rows = []
    for at, (t, n) in enumerate(seldom):
        tokens, _ = last(t)
        one, two = (int(x[0]) for x in tokens.before)
        own = np.uint64(one << 32 | two).view(np.int64)
        rows += [(at, False, t, 0, own, float(m.log_buckets(tokens, v, weights)[0]))] * n
    rows.append((rare, True, b"unknown", 0, np.int64(0), -3.0))
    rng.shuffle(rows)
    shelf = pa.table([list(x) for x in zip(*rows)], pa.schema([
        ("row", pa.int64()), ("held_out", pa.bool_()), ("token", pa.binary()), ("shelf", pa.int32()),
        ("before", pa.int64()), ("log_bucket", pa.float32())]))
    got = {r["row"]: r for r in m._shelved(buckets, v.tail_size, 0.5)(shelf).to_pylist()}
    assert (got[rare]["known"], got[rare]["base"], got[rare]["own"]) == (0, 0, 0)
    for at, (t, n) in enumerate(seldom):
        assert got[at]["known"] == 1 and got[at]["base"] == pytest.approx(math.log10(n + 1))
        total += math.exp(unknown) * 10 ** got[at]["own"]
    assert total == pytest.approx(1, abs=1e-4)


def test_without_weights_all_tokens_have_their_shares():
    """Trees over masses of any kind lead to each leaf with its share."""
    rng = np.random.default_rng(8)
    for n in (1, 2, 3, 17, 300):
        leaves = rng.integers(0, 50, n) * rng.integers(0, 2, n) + (np.arange(n) == n // 2)
        splits, some = m._splits(leaves), np.flatnonzero(leaves)
        got = m._log_walk(some, np.zeros((3, len(some)), np.uint64), splits, m.no_weights()[2], m._height(splits))
        assert np.exp(got) == pytest.approx(leaves[some] / leaves.sum(), rel=1e-4)


def test_steps_of_the_tree_are_gradients():
    v = vocabulary({b"a": 5, b"b": 3, m.END: 4} | {b"t%d" % i: 1 for i in range(2000)})
    tokens = m._Tokens(["a t991 a t1500 b t991", "t998 a"], v)
    assert (tokens.leaves >= 0).sum() == 4
    weights, own = m.no_weights(), m.no_weights()
    past, touched = [np.ones(m.ROWS, np.float32) for _ in own], [np.zeros(m.ROWS) for _ in own]
    m.learn(tokens, v, own, past, touched, 1.0)
    moved = np.argwhere(own[2])
    assert len(moved) >= 4 * 3 * 5 and set(moved[:, 0]) <= set(np.flatnonzero(touched[2]))
    assert touched[2].sum() == 4 * 3 * 3  # tokens, features, rows of a path of 11 steps
    for row, column in moved[::7]:
        up, down = m.no_weights(), m.no_weights()
        up[2][row, column] += 0.05
        down[2][row, column] -= 0.05
        gradient = -sum(s * m.log_probabilities(tokens, v, w).sum() for s, w in ((1, up), (-1, down))) / 0.1
        assert own[2][row, column] * np.sqrt(past[2][row]) == pytest.approx(-gradient, abs=2e-2)


def test_hashes_and_buckets_are_those_of_spark(spark):
    rng = random.Random(9)
    tokens = list({rng.randbytes(rng.randint(1, 90)) for _ in range(300)})
    counts = spark.createDataFrame([(bytearray(t), rng.randint(0, 3), rng.randint(3, 9)) for t in tokens],
                                   "token binary, n long, every long")
    got = counts.selectExpr("token", "n", "xxhash64(token) as h").collect()
    assert all(r.h % (1 << 64) == m._hash(bytes(r.token)) for r in got)
    v = m.vocabulary(counts, 0)
    wanted = Counter()
    for r in got:
        if r.n and bytes(r.token) not in v.tokens:
            wanted[m._hash(bytes(r.token)) >> (65 - len(v.buckets).bit_length())] += r.n + 1
    assert {i: n for i, n in enumerate(v.buckets.tolist()) if n} == wanted
