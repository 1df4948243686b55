import random

import duckdb
import pytest
import regex

from cloakframe.llm.decontamination import OP3_SQL, contained_items, op3_decontamination, without_leaks


def shingles(text):
    w = regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def brute(docs, items):
    out = []
    for k, text in docs:
        own = shingles(text)
        for i, item in items:
            s = shingles(item)
            if s and 100 * len(s & own) >= 80 * len(s):
                out.append((k, i, len(s), len(s & own)))
    return sorted(out)


@pytest.fixture(scope="module")
def mixed():
    rng = random.Random(1)
    words = [f"w{i}é" for i in range(3000)]
    make = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, make(rng.choice([5, 6, 12, 20, 40, 70, 300]))) for i in range(40)]
    docs = []
    for k in range(120):
        w = make(rng.choice([0, 3, 50, 400, 6000]))
        for _, item in rng.sample(items, 2):
            part = list(item)
            for _ in range(rng.choice([0, 0, 1, 2])):
                part[rng.randrange(len(part))] = "changed"
            at = rng.randint(0, len(w))
            w[at:at] = part if k % 3 else part[:len(part) // 2] + make(900) + part[len(part) // 2 - 4:]
        docs.append((k, (" " if k % 2 else ", ").join(w).upper() if k % 5 else " ".join(w)))
    return docs + [(900, None), (901, "")], [(i, " ".join(w)) for i, w in items] + [(90, None), (91, "a b")]


@pytest.mark.parametrize("block", [200_000, 300])
def test_equals_brute_force(spark, docs_of, mixed, block):
    docs, items = mixed
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(r) for r in contained_items(docs_of(docs), bench, block_shingles=block).collect())
    assert got == brute(docs, items) and len(got) > 100


def test_sql(spark, medium):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{medium}/{t}.parquet'")
    want = sorted(con.execute(f"select doc_id, item_id, n_shingles, n_shared from ({OP3_SQL})").fetchall())
    assert sorted(tuple(r) for r in op3_decontamination(spark, medium).collect()) == want and want


def test_empty_tables_and_removal(spark, docs_of):
    bench = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    docs = docs_of([(1, "x One, two three four five SIX y"), (2, "clean"), (3, None), (None, "y")])
    left = without_leaks(docs, bench)
    assert left.columns == docs.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 2, 3]
    assert contained_items(docs_of([]), bench).count() == 0
    assert contained_items(docs, bench.limit(0)).count() == 0
