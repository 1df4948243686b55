"""Encrypted trees: round trip, and frames that were changed, swapped, moved or cut."""

import hashlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cloakframe.operators import frames
from cloakframe.plans import jobs
from cloakframe.sources import files

CONTENTS = {"a.txt": b"short", "sub/b.bin": bytes(range(256)) * 20, "sub/empty": b"", "exact": b"x" * 200, "é ü.txt": "ä".encode() * 333}


@pytest.fixture(scope="module")
def sealed(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("plain")
    for name, content in CONTENTS.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)
    out = str(tmp_path_factory.mktemp("sealed") / "frames")
    frames.encrypt_files(spark, str(root), "password", chunk=100, rounds=1000).write.parquet(out)
    return spark.read.parquet(out)


def status(sealed, password="password"):
    rows = frames.frame_status(frames.decrypt_frames(sealed, password, 1000)).collect()
    return {r.rel_path: r.status for r in rows}


def test_round_trip(spark, sealed, tmp_path):
    opened = frames.decrypt_frames(sealed, "password", 1000)
    told = {r.rel_path: r for r in frames.restore_files(opened, str(tmp_path / "back")).collect()}
    assert {k: (r.frames, r.size, r.status) for k, r in told.items()} == {
        k: (max(1, -(-len(c) // 100)), len(c), "OK") for k, c in CONTENTS.items()}
    back = {r.rel_path: r.digest for r in jobs.manifest(spark, str(tmp_path / "back"), True).collect()}
    assert back == {k: hashlib.sha256(c).hexdigest() for k, c in CONTENTS.items()}
    assert tuple(frames.encryption_summary(frames.frame_status(opened)).first()) == (5, 0)


def test_nonces_and_tags(sealed):
    rows = sealed.filter("rel_path = 'exact'").collect()
    blobs = [bytes(r.blob) for r in rows]
    assert len(blobs) == 2 and all(len(b) == 12 + 100 + 16 for b in blobs)
    assert len({b[:12] for b in blobs}) == 2 and blobs[0][12:112] != blobs[1][12:112]
    assert "password" not in sealed._jdf.queryExecution().toString()


def test_harmed_frames_fail(spark, sealed, tmp_path):
    good = dict.fromkeys(CONTENTS, "OK")
    assert status(sealed) == good
    assert status(sealed, "another") == dict.fromkeys(CONTENTS, "FAILED")
    b = "sub/b.bin"
    own = sealed.filter(F.col("rel_path") == b)
    rest = sealed.filter(F.col("rel_path") != b)
    two = F.when(F.col("number") == 3, 4).when(F.col("number") == 4, 3).otherwise(F.col("number"))
    harmed = {
        "changed": own.withColumn("blob", F.when(F.col("number") == 7, F.overlay("blob", F.lit(b"zz"), F.lit(20))).otherwise(F.col("blob"))),
        "swapped": own.withColumn("number", two.cast("int")),
        "cut": own.filter("not last"),
        "cut and closed": own.filter("number < 5").withColumn("last", F.col("number") == 4),
        "one missing": own.filter("number != 2"),
        "repeated": own.union(own.filter("number = 1")),
    }
    for what, rows in harmed.items():
        assert status(rest.unionByName(rows)) == good | {b: "FAILED"}, what
    moved = rest.filter("rel_path != 'exact'").unionByName(own.filter("number < 2").withColumn("rel_path", F.lit("exact")))
    assert status(moved)["exact"] == "FAILED"
    told = frames.restore_files(frames.decrypt_frames(rest.unionByName(harmed["cut"]), "password", 1000), str(tmp_path / "part"))
    assert {r.rel_path for r in told.filter("status = 'OK'").collect()} == set(CONTENTS) - {b}
    assert not (tmp_path / "part" / b).exists()


def test_empty_folder(spark, tmp_path):
    sealed = frames.encrypt_files(spark, str(tmp_path), "password", rounds=10)
    assert frames.decrypt_frames(sealed, "password", 10).count() == 0


def test_a_large_folder_is_listed_in_batches(tmp_path, monkeypatch):
    class Places:
        def mapInPandas(self, run, schema):
            return run

    monkeypatch.setattr(files, "_ROWS", 3, raising=False)
    for name, count in (("a", 7), ("b", 2), ("c", 0)):
        (tmp_path / name).mkdir()
        for i in range(count):
            (tmp_path / name / f"f{i}").write_text("x")
    places = pd.DataFrame({"path": [str(tmp_path / name) for name in "abc"]})
    frames = list(files._listed(Places())(iter([places])))
    assert [len(f) for f in frames] == [3, 3, 1, 2]
    assert sum(f["length"].sum() for f in frames) == 9
