import random
import re
from collections import Counter

import duckdb
import pytest
import xxhash

from cloakframe.llm import collocations as c
from cloakframe.llm.collocations import OP12_SQL, collocations, op12_collocations, phrase_counts


def count(rows):
    """Counter of (lang, words) over (lang, text)."""
    out = Counter()
    for lang, text in rows:
        text = "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            words = re.findall(r"[^ \t]+", piece)
            for k in (1, 2, 3):
                out.update((lang or "und", tuple(words[i:i + k])) for i in range(len(words) - k + 1))
    return out


def totals(counted):
    out = Counter()
    for (lang, p), n in counted.items():
        out[lang, ""] += n * (len(p) == 1)
    return dict(out)


def brute(rows, least=10, keep=50, top=2000):
    f = count(rows)
    out = []
    for lang in {k for k, _ in f}:
        found = {p: n for (own, p), n in f.items() if own == lang and len(p) > 1 and n >= least}
        inside = Counter()
        for p, n in found.items():
            if len(p) == 3:
                for q in (p[:2], p[1:]):
                    inside[q] = max(inside[q], n)
        scored = []
        for p, a in found.items():
            if 100 * inside[p] >= keep * a and p in inside:
                continue
            cuts = [(1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            scored.append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        total = sum(n for (own, p), n in f.items() if own == lang and len(p) == 1)
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total, -score))
    return sorted(out)


def test_whole_table(spark, medium):
    got = sorted(map(tuple, op12_collocations(spark, medium).collect()))
    con = duckdb.connect()
    con.sql(f"create view documents as from '{medium}/documents.parquet'")
    assert got == sorted(con.sql(OP12_SQL).fetchall())
    table = spark.read.parquet(f"{medium}/documents.parquet")
    assert got == brute([(r.lang, r.text) for r in table.collect()]) and len({r[0] for r in got}) >= 4


def texts(seed, n, words="a b c d É é Aa ab , . : ! \t \n \r x. \x0b \x1c \xa0 \x85 q".split(" ")):
    rng = random.Random(seed)
    passage = " ".join(rng.choice(words) for _ in range(60))
    for i in range(n):
        own = " ".join(rng.choices(words, k=rng.randint(0, 120)))
        yield rng.choice(["en", "de", None, "und"]), own + " " + passage * (i % 3 == 0)


@pytest.mark.parametrize("seed, trigger, bits", [(1, 2, 1 << 28), (2, 16, 64), (3, 1000, 1 << 28), (4, 1, 1 << 28)])
def test_random_texts(spark, monkeypatch, seed, trigger, bits):
    """Any cutting, also behind every word, and a filter that lets everything pass."""
    monkeypatch.setattr(c, "LEAST_BITS", 64)
    rows = [*texts(seed, 150), ("en", None), ("en", ""), (None, "  \t "), ("en", "go " * 3000), ("en", "go " * 3000),
            ("de", "z" * 5000 + " " + "z" * 5000)]
    docs = spark.createDataFrame([(1, lang, text, "x", 0, 1) for lang, text in rows],
                                 "doc_id long, lang string, text string, phrase string, n long, rank int")
    counts = phrase_counts(docs, 10, trigger, bits)
    wanted = {(lang, " ".join(p)): n for (lang, p), n in count(rows).items() if n >= 10} | totals(count(rows))
    assert {(r.lang, r.phrase): r.n for r in counts.collect()} == wanted
    for least, keep, top in ((10, 50, 2000), (3, 90, 7)):
        got = collocations(docs, least, keep, top, trigger, bits).collect()
        assert sorted(map(tuple, got)) == brute(rows, least, keep, top)


def test_small_counters_are_passed_on(spark, monkeypatch):
    """Tasks that pass on what they hold after each batch lose nothing (run in this process)."""
    import pyarrow as pa

    monkeypatch.setattr(c, "_COUNTED", 3)
    monkeypatch.setattr(c, "_TOKENS", 100)
    rows = [(lang or "und", text) for lang, text in texts(9, 40)]
    batches = [pa.RecordBatch.from_pydict({"lang": [lang], "text": [t]}) for lang, t in rows]
    parsed = list(c._parse(4)(iter(batches)))
    assert len(parsed) > 20
    total = Counter()
    for batch in c._phrases(_all_bits(), _all_bits())(iter(parsed)):
        for r in batch.to_pylist():
            total[r["lang"], tuple(r["phrase"].split(" ")) if r["phrase"] else ()] += r["n"]
    wanted = count(rows)
    assert total == wanted | {(lang, ()): n for (lang, _), n in totals(wanted).items()} | {(x, ()): 0 for x, _ in rows if (x, '') not in totals(wanted)}


def test_equal_hashes_of_different_words():
    import numpy as np

    tokens = [b"a", b"b", b"a", b"c", b"b"]
    assert c._numbers(tokens, np.array([5, 7, 5, 9, 7], np.uint64)).tolist() == [0, 1, 0, 2, 1]
    assert c._numbers(tokens, np.array([5, 7, 5, 7, 7], np.uint64)).tolist() == [0, 1, 0, 2, 1]
    ends = (np.array([0, 2]), np.array([1, 4]), np.array([2, 3, 4]))
    found = c._texts(tokens, np.array([5, 7, 5, 7, 7], np.uint64), np.array([1, 2, 3, 4, 5]), ends)
    assert dict(zip(*found)) == {b"a": 4, b"a b": 2, b"c b": 5, b"a b a": 3, b"b a c": 4, b"a c b": 5}


def test_filters_hold_every_frequent_phrase(monkeypatch):
    """Blocks of hashes put together again give exact counts (run in this process)."""
    import numpy as np
    import pandas as pd
    import pyarrow as pa

    monkeypatch.setattr(c, "_HASHED", 50)
    rows = [(lang or "und", text) for lang, text in texts(11, 60)]
    parsed = list(c._parse(4)(iter([pa.RecordBatch.from_pydict({"lang": [x for x, _ in rows], "text": [t for _, t in rows]})])))
    batches = [parsed[0].slice(i, 7) for i in range(0, parsed[0].num_rows, 7)]
    wanted = count(rows)
    for lower, lengths in ((None, (1, 2)), (_all_bits(), (3,))):
        blocks = pd.concat([b.to_pandas() for b in c._hashes(3, lower)(iter(batches))])
        assert set(blocks["bucket"]) <= set(range(8))
        for least in (1, 10):
            found = pd.concat([c._frequent(least)(g) for _, g in blocks.groupby("bucket")])
            hashes = found["hash"].to_numpy().view(np.uint64)
            assert len(hashes) == len(set(hashes.tolist())) == sum(n >= least for (_, p), n in wanted.items() if len(p) in lengths)


def _all_bits():
    import numpy as np

    return np.full(64, 255, np.uint8)


def test_copies_share_chunks(spark):
    passage = " ".join(f"w{i}" for i in range(400))
    docs = spark.createDataFrame([("en", f"own{i} begin{i} {passage}") for i in range(50)], "lang string, text string")
    parsed = c.dictionary(docs)
    assert parsed.count() < 150 and parsed.agg({"n": "max"}).first()[0] == 50
    assert xxhash.xxh3_64_intdigest(b"\xff") % c.TRIGGER != 0  # the end of a piece does not cut


def test_empty_and_large_counts(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert collocations(none).count() == 0
    one = spark.createDataFrame([(None, "a b " * 30000)], "lang string, text string")
    assert [tuple(r) for r in collocations(one).collect()] == brute([(None, "a b " * 30000)])
