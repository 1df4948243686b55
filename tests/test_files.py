import json

from pyspark.sql import functions as F

from cloakframe.functions import fixed_values as fixed
from cloakframe.operators import detect
from cloakframe.plans import jobs
from cloakframe.sources import files, ranges, tables


def _tree(root):
    contents = {
        "a.txt": "mail é a@b.co\nip 1.2.3.4".encode(),
        "latin.LOG": "mail é c@d.org".encode("latin-1"),
        "crlf.csv": b"x\r\n10.0.0.1\r\ny\r",
        "empty.md": b"",
        "sub/deep/n.json": b'{"mail": "e@f.net"}',
        "sub/image.png": b"1.2.3.4 \xff",
        "noext": b"5.6.7.8",
        "_hidden.txt": b"h@i.org",
        ".env": b"j@k.org",
    }
    for name, content in contents.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    return contents


def _names(df, root, column="path"):
    return [r[0].split(str(root) + "/")[1] for r in df.select(column).collect()]


def test_inventory(spark, tmp_path):
    contents = _tree(tmp_path)
    rows = files.file_inventory(spark, str(tmp_path), recursive=True)
    assert _names(rows, tmp_path) == sorted(contents)
    assert {r.length for r in rows.collect()} == {len(c) for c in contents.values()}
    flat = files.file_inventory(spark, f"file:{tmp_path}")
    assert _names(flat, tmp_path) == sorted(n for n in contents if "/" not in n)
    twice = files.file_inventory(spark, [str(tmp_path / "a.txt")] * 2)
    assert twice.count() == 1
    logs = files.file_inventory(spark, str(tmp_path), True, [".log", ".json"], True)
    assert _names(logs, tmp_path) == [".env", "latin.LOG", "noext", "sub/deep/n.json"]
    assert files.file_inventory(spark, str(tmp_path / "missing")).count() == 0


def test_texts_and_lines(spark, tmp_path):
    _tree(tmp_path)
    texts = {r.file.split("/")[-1]: r.text for r in files.read_texts(spark, str(tmp_path)).collect()}
    assert texts["latin.LOG"] == "mail é c@d.org"
    assert texts["crlf.csv"] == "x\n10.0.0.1\ny\n"
    lines = ranges.read_text_lines(spark, str(tmp_path / "crlf.csv")).orderBy("line_no").collect()
    assert [(r.line_no, r.line) for r in lines] == [(1, "x"), (2, "10.0.0.1"), (3, "y"), (4, "")]
    logs = files.read_log_lines(spark, str(tmp_path / "a.txt")).collect()
    assert [r.line for r in logs] == ["mail é a@b.co", "ip 1.2.3.4"]


def test_scan_files(spark, tmp_path):
    _tree(tmp_path)
    found = jobs.scan_files(spark, str(tmp_path), recursive=True).collect()
    assert sorted((r.file.split("/")[-1], r.value, r.line) for r in found) == [
        ("_hidden.txt", "h@i.org", 1), ("a.txt", "1.2.3.4", 2), ("a.txt", "a@b.co", 1), ("crlf.csv", "10.0.0.1", 2),
        ("latin.LOG", "c@d.org", 1), ("n.json", "e@f.net", 1),
    ]
    row = jobs.scan_files_summary(spark, str(tmp_path), recursive=True).first()
    assert (row.files_found, row.files_scanned, row.files_with_pii, row.total_findings) == (9, 6, 5, 6)


def test_odd_folders(spark, tmp_path):
    for name in ("a.txt", "k=1/e.txt", "x[1]/b.txt", "plain/c.txt.gz"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"mail " + name[:1].encode() + b"@b.co")
    (tmp_path / "plain/up").symlink_to(tmp_path)
    assert files.file_inventory(spark, str(tmp_path), True).count() == 4
    assert _names(files.read_texts(spark, str(tmp_path)), tmp_path, "file") == ["a.txt"]
    assert _names(files.read_texts(spark, str(tmp_path / "x[1]")), tmp_path, "file") == ["x[1]/b.txt"]
    texts = {r.file.split("/")[-1]: r.text for r in files.read_texts(spark, str(tmp_path), True).collect()}
    assert texts == {"a.txt": "mail a@b.co", "e.txt": "mail k@b.co", "b.txt": "mail x@b.co",
                     "c.txt.gz": "mail p@b.co"}


def test_sanitize_files(spark, tmp_path):
    _tree(tmp_path / "in")
    out = str(tmp_path / "out")
    row = jobs.sanitize_files(spark, str(tmp_path / "in"), out, recursive=True).first()
    assert row.type_counts == {"EMAIL": 5, "IPV4": 3}
    written = {r.output_name.split("/in/")[1]: r.text for r in spark.read.parquet(out).collect()}
    assert set(written) == {
        "a_sanitized.txt", "crlf_sanitized.csv", "latin_sanitized.LOG", "noext_sanitized.log",
        "sub/deep/n_sanitized.json", "_hidden_sanitized.txt", ".env_sanitized.log",
    }
    assert "@" not in "".join(written.values())


def test_findings_json(spark, tmp_path):
    df = spark.createDataFrame([(1, "1.2.3.4 and jo@b.co")], "id int, text string")
    found, summary = detect.scan_text(df, "text"), detect.scan_summary(df, "text")
    tables.write_findings_json(found, summary, str(tmp_path / "masked"))
    tables.write_findings_json(found, summary, str(tmp_path / "raw"), include_raw=True)

    def rows(part):
        return [json.loads(line) for p in (tmp_path / part).glob("part-*")
                for line in p.read_text().splitlines()]

    assert "jo@b.co" not in json.dumps(rows("masked/findings"))
    raw = {r["type"]: r for r in rows("raw/findings")}
    assert raw["EMAIL"]["value"] == "jo@b.co" and raw["EMAIL"]["value_masked"] == "j***@b.co"
    assert rows("masked/summary")[0]["types_found"] == {"EMAIL": 1, "IP_ADDRESS": 1}


def test_csv(spark, tmp_path):
    source = tmp_path / "people.csv"
    source.write_text('id,name,note\n007,Jo,"a ""q"", x"\n008,,NA\n')
    df = tables.read_csv_strings(spark, str(source), na_values=["NA"])
    assert tables.column_names(df) == ["id", "name", "note"]
    assert [tuple(r) for r in df.orderBy("id").collect()] == [
        ("007", "Jo", 'a "q", x'), ("008", None, None)
    ]
    plan = jobs.anonymize_csv(spark, str(source), str(tmp_path / "out"))
    assert plan == {"name": "name"}
    rows = tables.read_csv_strings(spark, str(tmp_path / "out")).orderBy("id").collect()
    assert rows[0].id == "007" and rows[0].name not in (None, "Jo") and rows[1].name is None
    assert rows[0].note == 'a "q", x'


def test_extensions(spark):
    names = {"a.TXT": ".txt", "d/a.tar.gz": ".gz", ".env": "", "x/.b.c": ".c", "noext": "", "e.": ""}
    df = spark.createDataFrame([(n,) for n in names], "p string")
    got = {r.p: r.e for r in df.select("p", files.extension(F.col("p")).alias("e")).collect()}
    assert got == names
    assert len(fixed.SCANNABLE_EXTENSIONS) == 22
