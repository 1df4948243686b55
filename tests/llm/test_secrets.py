import hashlib
import random
import re

from cloakframe.llm.secrets import RULES, BlobLedger, Rule, op1_secrets, scan_secrets

ASSIGN = re.compile(r"""(?a)((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    kinds = ("assign", "access", "hex")
    s = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(out))
    n = [sum(k == i for _, k, _ in out) for i in range(3)]
    return (*n, hashlib.sha256(s.encode()).hexdigest(), s)


def rows(df):
    assert df.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_equals_brute_force(docs_of):
    rng = random.Random(4)
    parts = ["token", "Secret=", ":", '"', " ", "AKIA", "ABCDEFGHIJ", "0123456789ab", "cdef" * 3, "é😀", "api_key",
             "APIKEY", "= ", "x.y-z+/", "\n", "passwd", "PassWord", "ſecret", "toKen"]
    pairs = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for i in range(400)]
    pairs += [(900, None), (901, ""), (902, "secret=token:abcdefg"), (903, "f" * 200000), (904, "token=" * 9)]
    assert rows(scan_secrets(docs_of(pairs))) == sorted(((k, *brute(t)) for k, t in pairs), key=str)


def test_whole_table(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet").collect()
    assert rows(op1_secrets(spark, medium)) == sorted(((r.doc_id, *brute(r.text)) for r in docs), key=str)


def test_ledger_scans_only_what_is_new(spark, docs_of):
    ledger = BlobLedger(spark)
    first = [(1, "token=abcdefgh"), (2, "nothing"), (3, "token=abcdefgh"), (None, "nothing")]
    assert len(rows(scan_secrets(docs_of(first), ledger))) == 4
    assert ledger.findings().count() == 2
    second = [(1, "token=abcdefgh"), (5, "secret: 1234567")]
    assert [r[1] for r in rows(scan_secrets(docs_of(second), ledger))] == [1, 1]
    assert ledger.findings().count() == 3
    more = BlobLedger(spark, ledger.folder, (*RULES, Rule("pin", r"pin=([0-9]+)", 1, 4, ("pin=",))))
    assert scan_secrets(docs_of([(1, "pin=1234"), (2, "nothing")]), more).select("n_pin").collect()[0][0] in (0, 1)
    assert ledger.findings().count() == 5
    assert rows(scan_secrets(docs_of([]), ledger)) == []


def test_letters_are_those_of_ascii(docs_of):
    """The Kelvin sign and the long s are no k and s, wherever else a keyword stands."""
    texts = {1: "to\u212aen=abcdefgh", 2: "\u017fecret=abcdefgh", 3: "token \u017fecret=abcdefgh to\u212aen=abcdefgh", 4: "TOKEN=abcdefgh"}
    found = {r.doc_id: r.n_assign for r in scan_secrets(docs_of(texts.items())).collect()}
    assert found == {1: 0, 2: 0, 3: 0, 4: 1}
