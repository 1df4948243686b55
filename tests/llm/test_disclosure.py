import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from cloakframe.llm.disclosure import find_personal_data, op5_personal_data, sanitise


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def brute(pairs, window=5, least=2, part=0.9):
    found = {k: base(t) for k, t in pairs}
    texts = {k: t or "" for k, t in pairs}
    near, df, term_docs = {}, {}, {}
    for k, t in texts.items():
        for w in set(re.findall(r"[^\W\d_]{2,}", t.lower())):
            term_docs.setdefault(w, set()).add(k)
        for s, kind, e in found[k]:
            entity = (kind, t[s:e].lower())
            df.setdefault(entity, set()).add(k)
            lo, hi = max(s - 100, 0), min(e + 100, len(t))
            words = [(lo + m.start(), lo + m.end()) for m in re.finditer(r"[^\W\d_]{2,}", t[lo:s])]
            words = [w for w in words if not (w[0] == lo and lo > 0)][-window:]
            after = [(e + m.start(), e + m.end()) for m in re.finditer(r"[^\W\d_]{2,}", t[e:hi])]
            after = [w for w in after if not (w[1] == e + 100 and e + 100 < len(t))][:window]
            for a, b in words + after:
                if not any(y > a and x < b for x, _, y in found[k]):
                    near.setdefault((entity, t[a:b].lower()), []).append((k, a, b))
    spans = {k: list(v) for k, v in found.items()}
    for (entity, term), places in near.items():
        docs = {k for k, _, _ in places}
        info = math.log2(len(texts) / len(df[entity]))
        if len(docs) >= least and len({texts[k] for k in docs}) > 1 and info > 0:
            if info + math.log2(len(docs) / max(len(docs), len(term_docs.get(term, ())))) >= part * info - 1e-12:
                spans_of = {(k, a, b) for k, a, b in places}
                for k, a, b in spans_of:
                    if (a, 4, b) not in spans[k]:
                        spans[k].append((a, 4, b))
    return {k: sorted(v) for k, v in spans.items()}, found


def text_of(spans):
    return ",".join(f"{('email', 'ip', 'card', 'phone', 'term')[k]}:{a}:{b}" for a, k, b in spans)


@pytest.fixture(scope="module")
def mixed():
    rng = random.Random(6)
    parts = ["a@b.co", "_m@d.ef", "x@", "@y.z", "1.2.3.4", "300.1.1.1", "0001.2.3.255", "1.2.3", ".", "4111 1111 1111 1111",
             "4111-1111-1111-1112", "+1 (017) 555-7713", "+1", "+12345678901234567", "é😀", " ", " ", "\n", "12345678", "-", "9"]
    pairs = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for i in range(300)]
    names = ["Alice", "bob", "carol", "Dora"]
    for i in range(300, 420):
        who = rng.randrange(4)
        filler = " ".join(rng.choice(["the", "of", "and", "on", "zu"]) + str(rng.randrange(9)) for _ in range(rng.randint(0, 30)))
        pairs.append((i, f"{filler} {names[who]} wrote to {names[who].lower()}.{who}@mail.example.com, so {filler} and the"))
    pairs += [(i, "the wrote and so of to " * 3) for i in range(420, 500)]
    return pairs + [(900, None), (901, ""), (902, "1" * 60000), (903, "a." * 30000 + "@"), (904, "1 " * 20000)]


def test_equals_brute_force(docs_of, mixed):
    want, found = brute(mixed)
    rows = find_personal_data(docs_of(mixed)).collect()
    got = {r.doc_id: sorted([(s.start, s.kind, s.end) for s in r.found] + [(s.start, s.kind, s.end) for s in r.terms or []])
           for r in rows}
    assert got == want and len(rows) == len(mixed)
    assert any(k == 4 for v in want.values() for _, k, _ in v)


def test_query(spark, medium):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{medium}/documents.parquet").collect()]
    want, found = brute(docs)
    for r in op5_personal_data(spark, medium).collect():
        counts = [sum(k == i for _, k, _ in found[r.doc_id]) for i in range(4)]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts
        assert r.base_sha256 == hashlib.sha256(text_of(found[r.doc_id]).encode()).hexdigest()
        assert r.spans == text_of(want[r.doc_id])


def test_odd_rows_and_sanitised_texts(docs_of):
    pairs = [(1, "Anna has a@b.co here"), (2, "call Anna a@b.co now"), (3, "no"), (3, "no"), (None, "x@y.zz"), (4, None)]
    pairs += [(i, f"other words {i}") for i in range(10, 30)]
    got = {r.doc_id: r.text for r in sanitise(docs_of(pairs)).collect()}
    assert got[1] == "[NAME] has [EMAIL] here" and got[2] == "call [NAME] [EMAIL] now"
    assert got[None] == "[EMAIL]" and got[3] == "no" and got[4] == ""
    assert find_personal_data(docs_of([])).count() == 0
    assert find_personal_data(docs_of(pairs)).select(F.sum(F.size("found"))).first()[0] == 3
