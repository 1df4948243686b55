import hashlib
import random

import duckdb
from pyspark.sql import functions as F

from cloakframe.llm.line_dedup import OP7_SQL, LineRuns, dedup_lines, hashed_lines, op7_line_dedup

BLANK = " \t\n\x0b\x0c\r"


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute(pairs):
    where = {}
    for k, text in pairs:
        for line in (text or "").split("\n"):
            key = low(line.strip(BLANK))
            if len(key) >= 20:
                where.setdefault(key, set()).add(k)
    out = []
    for k, text in pairs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(where.get(low(x.strip(BLANK)), ())) < 3
                or max(where[low(x.strip(BLANK))]) == k]
        out.append((k, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out)


def test_equals_brute_force(docs_of):
    rng = random.Random(1)
    common = [f"a common line number {i} Éé" for i in range(12)] + ["short", "", "ß" * 19, "ß" * 20]
    pairs = []
    for i in range(150):
        lines = [rng.choice(common) for _ in range(rng.randint(0, 6))]
        lines += [f"an own line of document {i} and {rng.random()}"] * rng.randint(0, 2)
        lines = [rng.choice(["", " ", "\t\r", "\x0b"]) + (x.upper() if rng.random() < .3 and "ß" not in x and "é" not in x else x)
                 + rng.choice(["", " ", "\r"]) for x in lines]
        pairs.append((i, "\n".join(lines)))
    pairs += [(200, None), (201, ""), (202, "\n"), (203, (common[0] + "\n") * 5000), (204, " " + common[0])]
    assert sorted(tuple(r) for r in dedup_lines(docs_of(pairs)).collect()) == brute(pairs)


def test_sql_and_empty_tables(spark, small, docs_of):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{small}/documents.parquet'")
    want = con.execute("select doc_id, n_lines, n_dropped, kept_sha256 from (" + OP7_SQL + ")").fetchall()
    assert sorted(tuple(r) for r in op7_line_dedup(spark, small).collect()) == sorted(want)
    assert dedup_lines(docs_of([])).count() == 0


def test_repeated_rows_and_missing_ids(docs_of):
    x = "a line of twenty points and more"
    rows = sorted((r.doc_id or 0, r.text) for r in dedup_lines(
        docs_of([(1, x), (1, x), (2, x), (None, x)])).collect())
    assert rows == [(0, x), (1, ""), (1, ""), (2, x)]
    assert {r.text for r in dedup_lines(docs_of([(1, x), (1, x), (2, x)])).collect()} == {x}


def test_runs(docs_of):
    runs, seen = LineRuns(fan=2), {}
    for batch in range(7):
        pairs = [(batch * 10 + i, f"the line with number {(batch * i) % 5} here") for i in range(1, 6)]
        run = runs.add(hashed_lines(docs_of(pairs)))
        fresh = {t for _, t in pairs} - set(seen)
        assert run.filter("fresh").count() == len(fresh)
        for k, t in pairs:
            seen.setdefault(t, []).append(k)
    assert sorted((r.n_docs, r.last_doc) for r in runs.totals().collect()) == sorted(
        (len(v), max(v)) for v in seen.values())
    assert [len(level) for level in runs.levels] == [1, 1, 1]
    assert runs.totals().select(F.countDistinct("h1")).first()[0] == len(seen)


def test_digest():
    assert hashlib.sha256(b"").hexdigest()[:6] == "e3b0c4"
