import hashlib
import random

import pytest
from pyspark.sql import functions as F

from cloakframe.functions.digests import digest
from cloakframe.functions.formatting import format_size
from cloakframe.operators import fingerprint as prints
from cloakframe.operators.expected import maybe_expected
from cloakframe.operators.spread import spread_join
from cloakframe.plans import catalog, jobs
from cloakframe.sources import files, tables


@pytest.mark.parametrize("algorithm", ["sha256", "sha512", "sha1", "md5"])
def test_digests(spark, algorithm):
    values = ["", "abc", "é日𝟗", "x" * 5000]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    rows = df.select("v", digest(F.col("v"), algorithm).alias("d")).collect()
    assert all(r.d == hashlib.new(algorithm, r.v.encode()).hexdigest() for r in rows)


def test_unknown_algorithm():
    with pytest.raises(ValueError):
        digest(None, "crc32")


def test_verify(spark):
    right = hashlib.sha256(b"one").hexdigest()
    df = spark.createDataFrame([("a", "one"), ("b", "two"), ("c", "three"), ("d", "x")],
                               "k string, text string")
    expected = spark.createDataFrame([
        ("a", f"  {right.upper()}\n"), ("b", hashlib.md5(b"two").hexdigest()),
        ("c", "f" * 40), ("d", hashlib.sha512(b"x").hexdigest()), ("e", right),
    ], "k string, expected string")
    rows = {r.k: r for r in prints.verify(df, ["k"], "text", expected).collect()}
    assert {k: r.status for k, r in rows.items()} == {
        "a": "MATCH", "b": "MATCH", "c": "MISMATCH", "d": "MATCH", "e": "MISSING"
    }
    actual = hashlib.sha1(b"three").hexdigest()
    assert rows["c"].first_difference == next(i for i, x in enumerate(actual) if x != "f")
    asked = prints.verify(df, ["k"], "text", expected, algorithm="sha1").collect()
    assert {r.algorithm for r in asked} == {"sha1"}


def test_compare(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "cc"), (4, "d")], "k int, t string")
    right = spark.createDataFrame([(1, "a"), (2, "x"), (3, "c"), (5, "e")], "k int, t string")
    rows = prints.compare(left, right, ["k"], "t").collect()
    assert {r.k: r.status for r in rows} == {
        1: "IDENTICAL", 2: "DIFFERENT", 3: "DIFFERENT", 4: "LEFT_ONLY", 5: "RIGHT_ONLY"
    }


def test_nulls_and_repeated_keys(spark):
    left = spark.createDataFrame([(1, None), (2, "a"), (2, "b"), (3, "c"), (3, "c")], "k int, t string")
    right = spark.createDataFrame([(1, None), (2, "a"), (3, "c"), (4, None)], "k int, t string")
    rows = prints.compare(left, right, ["k"], "t").collect()
    assert sorted((r.k, r.status) for r in rows) == [
        (1, "IDENTICAL"), (2, "REPEATED"), (3, "IDENTICAL"), (4, "RIGHT_ONLY")
    ]
    both = left.union(right).withColumn("id", F.monotonically_increasing_id())
    assert {r.copies for r in prints.identical_groups(both, "id", "t").collect()} == {2, 3}
    assert prints.identical_members(both, "id", "t").count() == 5


def test_hot_group_of_copies_is_spread(spark):
    df = spark.range(6000).select(
        "id", F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("t")
    )
    rows = prints.identical_groups(df, "id", "t").collect()
    assert [(r.copies, r.first_id) for r in rows] == [(2000, 0)]
    assert prints.identical_members(df, "id", "t").count() == 2000


def test_spread_join_splits_a_hot_key(spark):
    old = {k: spark.conf.get(k) for k in
           ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        many = spark.range(4000).select(F.lit("hot").alias("k"), "id")
        one = spark.createDataFrame([("hot", 7), ("cold", 8)], "k string, v int")
        out = spread_join(many, one, ["k"], "inner")
        sizes = [r["count"] for r in
                 out.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 4000 and len(sizes) >= 4 and max(sizes) < 2500
        assert out.select("v").distinct().collect()[0].v == 7
        missing = spread_join(many, one.filter("v = 8"), ["k"], "left")
        assert missing.filter("v is null").count() == 4000
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def _python_size(n):
    for unit in ("B", "KB", "MB", "GB"):
        if n < 1024:
            return f"{n:.1f} {unit}"
        n /= 1024
    return f"{n:.1f} TB"


def test_format_size(spark):
    rng = random.Random(1)
    sizes = [0, 1, 1023, 1024, 1280, 1792, 1049, 1024**2 - 1, 1024**2, 1024**4, 1024**5 + 7]
    sizes += [rng.randrange(2 ** rng.randint(1, 50)) for _ in range(500)]
    sizes += [256 * k + 1024 for k in range(40)]
    df = spark.createDataFrame([(n,) for n in sizes], "n bigint")
    for row in df.select("n", format_size("n").alias("s")).collect():
        assert row.s == _python_size(row.n)


def test_format_sizes_beyond_64_bits(spark, tmp_path):
    keys = [(1, 2), (9_000_000, 900_000), (10**9, 10**8), (-5, 3), (None, 1), (7, None)]
    spark.createDataFrame(keys, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.o_orderkey: r.size_text for r in catalog.format_sizes(spark, str(tmp_path)).collect()}
    for key, customer in keys[:3]:
        tenths, rest = divmod(key * key * customer * 640, 1024**4)
        tenths += rest * 2 > 1024**4 or (rest * 2 == 1024**4 and tenths % 2)
        assert got[key] == (f"{tenths // 10}.{tenths % 10} TB" if key > 1 else "128.0 B")
    assert got[-5] and got[None] is None and got[7] is None


def _write(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content)


def test_manifest_of_files(spark, tmp_path):
    folder = tmp_path / "tree"
    contents = {"a.txt": b"one", "b/c.bin": bytes(range(256)), "b/d e.txt": b"", "z.log": b"x\r\n"}
    for name, content in contents.items():
        _write(folder / name, content)
    rows = jobs.manifest(spark, str(folder), recursive=True).collect()
    assert [(r.rel_path, r.length, r.digest) for r in rows] == [
        (n, len(c), hashlib.sha256(c).hexdigest()) for n, c in sorted(contents.items())
    ]
    assert [r.rel_path for r in jobs.manifest(spark, str(folder)).collect()] == ["a.txt", "z.log"]
    out = str(tmp_path / "manifest")
    tables.write_manifest(jobs.manifest(spark, str(folder), True), out, directory=str(folder))
    read = {r.rel_path: r.digest for r in tables.read_manifest(spark, out).collect()}
    assert read == {n: hashlib.sha256(c).hexdigest() for n, c in contents.items()}
    header = "".join(p.read_text() for p in (tmp_path / "manifest/header").glob("part-*"))
    assert header.startswith("# SHA256 manifest\n# Directory: ") and "# Files: 4" in header


def test_compare_folders(spark, tmp_path):
    for name, content in {"same": b"11", "size": b"1", "text": b"ab", "left": b"l"}.items():
        _write(tmp_path / "l" / name, content)
    for name, content in {"same": b"11", "size": b"12", "text": b"ax", "right": b"r"}.items():
        _write(tmp_path / "r" / name, content)
    rows = jobs.compare_files(spark, str(tmp_path / "l"), str(tmp_path / "r")).collect()
    assert {r.rel_path: r.status for r in rows} == {
        "same": "IDENTICAL", "size": "DIFFERENT", "text": "DIFFERENT", "left": "LEFT_ONLY",
        "right": "RIGHT_ONLY",
    }


def test_block_by_block_digest(spark, tmp_path):
    content = bytes(range(256)) * 9000
    _write(tmp_path / "big one.bin", content)
    found = files.file_inventory(spark, str(tmp_path))
    row = files.digest_files(found, algorithm="sha1").first()
    assert (row.length, row.digest) == (len(content), hashlib.sha1(content).hexdigest())


def test_verify_hashes_only_expected_rows_of_the_expected_size(spark):
    """Hashing is counted: a content that must not be hashed would stop the job."""
    rows = [(i, f"text {i}") for i in range(2000)]
    df = spark.createDataFrame(rows, "id bigint, text string")
    wanted = [(i, hashlib.sha256(f"text {i}".encode()).hexdigest() if i % 2 else "0" * 64) for i in range(0, 2000, 97)]
    expected = spark.createDataFrame([*wanted, (9999, "0" * 64)], "id bigint, expected string")
    got = {r.id: r for r in prints.verify(df, ["id"], "text", expected).collect()}
    assert {k: r.status for k, r in got.items()} == {k: "MATCH" if k % 2 else "MISMATCH" for k, _ in wanted} | {9999: "MISSING"}
    assert got[0].first_difference is not None and got[97].first_difference is None
    passed = maybe_expected(df, expected, ["id"]).count()
    assert len(wanted) <= passed <= len(wanted) + 5
    plan = prints.verify(df, ["id"], "text", expected)._jdf.queryExecution().optimizedPlan().toString()
    assert "getbit" in plan or "bit_get" in plan
    sized = spark.createDataFrame([(k, e, len(f"text {k}") + (k % 3 == 0)) for k, e in wanted], "id bigint, expected string, length int")
    for r in prints.verify(df, ["id"], "text", sized).collect():
        if r.id % 3 == 0:
            assert (r.status, r.actual, r.first_difference) == ("MISMATCH", None, None)
        else:
            assert r.status == ("MATCH" if r.id % 2 else "MISMATCH") and r.actual
    assert maybe_expected(df, expected.limit(0), ["id"]).count() == 0
    assert prints.verify(df.limit(0), ["id"], "text", expected).filter("status != 'MISSING'").count() == 0


def test_verify_files_by_manifest(spark, tmp_path):
    contents = {"a.txt": b"one", "d/b.txt": b"two", "d/c.txt": b"", "big": b"x" * 300_000}
    for name, content in contents.items():
        _write(tmp_path / "tree" / name, content)
    folder, out = str(tmp_path / "tree"), str(tmp_path / "manifest")
    tables.write_manifest(jobs.manifest(spark, folder, True), out, directory=folder)
    assert {r.rel_path: r.status for r in jobs.verify_manifest(spark, folder, out).collect()} == dict.fromkeys(contents, "MATCH")
    _write(tmp_path / "tree/a.txt", b"onE")
    (tmp_path / "tree/d/b.txt").unlink()
    _write(tmp_path / "tree/new", b"nobody expects")
    rows = {r.rel_path: r for r in jobs.verify_manifest(spark, folder, out).collect()}
    assert {k: r.status for k, r in rows.items()} == {"a.txt": "MISMATCH", "d/b.txt": "MISSING", "d/c.txt": "MATCH", "big": "MATCH"}
    sized = spark.createDataFrame([("big", "0" * 64, 5), ("d/c.txt", hashlib.md5(b"").hexdigest(), 0), ("a.txt", "zz", 3)],
                                  "rel_path string, expected string, length bigint")
    rows = {r.rel_path: r for r in jobs.verify_files(spark, folder, sized).collect()}
    assert (rows["big"].status, rows["big"].actual) == ("MISMATCH", None)  # another size: not read
    assert (rows["d/c.txt"].status, rows["d/c.txt"].algorithm) == ("MATCH", "md5")


def test_identity_in_stages_reads_little(spark, tmp_path):
    big = b"h" * 5000
    contents = {"one": b"1", "two": b"22", "p": big + b"same", "q": big + b"same", "r": big + b"else", "s": b"x" + big + b"sam",
                "e1": b"", "e2": b"", "sub/k": b"tiny", "sub/l": b"tiny", "sub/m": b"Tiny"}
    for name, content in contents.items():
        _write(tmp_path / name, content)
    got = jobs.identical_files(spark, str(tmp_path), head=1000).collect()
    groups = {}
    for r in got:
        assert r.digest == hashlib.sha256(contents[r.path.split(f"{tmp_path}/")[1]]).hexdigest()
        groups.setdefault((r.digest, r.copies, r.first_path.split(f"{tmp_path}/")[1]), set()).add(r.path.split(f"{tmp_path}/")[1])
    assert sorted(map(sorted, groups.values())) == [["e1", "e2"], ["p", "q"], ["sub/k", "sub/l"]]
    assert {k[1:] for k in groups} == {(2, "e1"), (2, "p"), (2, "sub/k")}
    # p and q: head and whole; r: the same head, so whole too but in no group; s: head only
    assert {r.bytes_read for r in got} == {0, 4, 1000 + 5004}
    heads = files.digest_files(files.file_inventory(spark, str(tmp_path)), head=1000).collect()
    assert {r.path.split("/")[-1]: (r.length, r.bytes_read) for r in heads if r.path.split("/")[-1] in ("s", "two")} == {
        "s": (None, 1000), "two": (2, 2)}


def test_stats_and_errors(spark, tmp_path):
    _write(tmp_path / "f.txt", b"abc")
    (tmp_path / "f.txt").chmod(0o640)
    paths = spark.createDataFrame([(str(tmp_path / "f.txt"),), (str(tmp_path / "gone"),)], "path string")
    rows = {r.path.split("/")[-1]: r for r in files.stat_files(paths).collect()}
    assert rows["f.txt"].permissions == "640" and rows["f.txt"].accessed and rows["f.txt"].error is None
    assert rows["gone"].error == "No such file or directory" and rows["gone"].accessed is None
    props = jobs.file_properties(spark, str(tmp_path)).collect()
    assert {r.key for r in props} == {"File Size", "Last Modified", "Last Accessed", "Created", "Permissions"}
