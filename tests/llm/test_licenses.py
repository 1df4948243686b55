import duckdb

from cloakframe.llm.licenses import _MIT, KNOWN, OP9_SQL, find_licenses, known_digests, op9_licenses


def test_sql(spark, medium):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{medium}/documents.parquet'")
    want = con.execute("select doc_id, text_digest, license, n_notices, notices from (" + OP9_SQL + ")").fetchall()
    got = [tuple(r) for r in op9_licenses(spark, medium).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and any(r[3] for r in got)


def test_spellings_and_odd_rows(docs_of):
    mit = "MIT LICENCE\n\nCopyright (c) 2020 Somebody\n(c) another\n\n" + _MIT.replace(" ", "  ").replace('"', "“")
    pairs = [(1, mit), (2, "x\nreleased under THE mit licence\n\nSPDX-License-Identifier: Apache-2.0"), (3, None),
             (4, ""), (5, "no licence at all"), (6, "Copyright 2020 X"), (2, "x"), (None, "SPDX-License-Identifier: MIT"),
             (7, "Released under the MIT License.\n" * 3000), (8, "(c) X"), (8, "(c) X")]
    got = {}
    for r in find_licenses(docs_of(pairs)).collect():
        got.setdefault(r.doc_id, []).append((r.license, r.n_notices, r.notices[:20]))
    assert got[1] == [("MIT", 0, "")]
    assert sorted(got[2], key=str) == [(None, 0, ""), (None, 2, "2:MIT,4:Apache-2.0")]
    assert got[3] == got[4] == got[5] == got[6] == [(None, 0, "")] and got[8] == [(None, 0, "")] * 2
    assert got[None] == [("MIT", 1, "1:MIT")] and got[7] == [(None, 3000, "1:MIT,2:MIT,3:MIT,4:")]
    assert find_licenses(docs_of([])).count() == 0


def test_known_texts_are_unique(spark):
    digests = [r.digest for r in known_digests(spark).collect()]
    assert len(digests) == len(set(digests)) == len(KNOWN)
