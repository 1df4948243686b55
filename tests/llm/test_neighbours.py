import numpy as np

from cloakframe.llm.neighbours import exact_scores, nearest, op8_nearest


def brute(ids, vectors, k=20, every=20):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = exact_scores(np.repeat(vectors[i][None], len(ids), 0), vectors)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def lists(df):
    assert df.columns == ["query_id", "rank", "vec_id", "score"]
    out = {}
    for r in sorted(df.collect()):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_recall_on_whole_table(spark):
    folder = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
    want = brute(rows["vec_id"].to_numpy(), np.stack(rows["embedding"]).astype(float))
    got = lists(op8_nearest(spark, folder))
    assert set(got) == set(want)
    hit = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    recall = hit / sum(map(len, want.values()))
    print("recall", recall)
    assert recall >= 0.92
    scores = {(q, v): s for q in want for v, s in want[q]}
    assert all(abs(scores.get((q, v), s) - s) < 1e-12 for q in got for v, s in got[q])


def test_exact_with_one_part_ties_and_bad_rows(spark):
    rng = np.random.default_rng(0)
    v = np.round(rng.normal(size=(160, 4)), 1)
    v[40:120] = v[0]
    rows = [(i, [float(x) for x in v[i]]) for i in range(160)]
    bad = [(200, None), (220, []), (240, [0.0] * 4), (260, [float("nan"), 1.0, 1.0, 1.0]), (280, [None, 1.0, 1.0, 1.0]),
           (300, [float("inf"), 1.0, 1.0, 1.0]), (None, [1.0, 1.0, 1.0, 1.0]), (320, [1.0] * 7)]
    df = spark.createDataFrame(rows + bad + rows[:30], "vec_id long, embedding array<double>").selectExpr(
        "*", "1 as part", "2 as h1", "'x' as score")
    want = brute(np.arange(160), v)
    for block in (2048, 16):
        assert lists(nearest(df, parts=1, block=block)) == want


def test_few_rows(spark):
    df = spark.createDataFrame([(20, [1.0, 2.0]), (21, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert lists(nearest(df)) == {20: [(21, 1.0)]}
    assert lists(nearest(df.limit(0))) == {}
