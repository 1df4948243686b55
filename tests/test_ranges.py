"""Reading by byte ranges equals reading whole files, wherever the cuts are."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from cloakframe.plans import jobs
from cloakframe.sources import ranges, tables


def reader(content):
    return lambda position, count: content[position:position + count]


def cuts(length, size):
    return [(b, min(b + size, length)) for b in range(0, max(length, 1), size)]


def decode(content):
    try:
        text = content.decode()
    except UnicodeDecodeError:
        text = content.decode("latin-1")
    return text.replace("\r\n", "\n").replace("\r", "\n")


ALPHABETS = [b"ab\r\n", b"\r\n", "aé漢😀\n\r".encode(), b"a\x80\xc3\xa9\xf0\x9f\x98\x80\xe6\n"]


@pytest.mark.parametrize("block", [2, 3, 1 << 20])
def test_lines_and_encoding_of_any_cut(monkeypatch, block):
    monkeypatch.setattr(ranges, "_BLOCK", block)
    rng = random.Random(block)
    for _ in range(600):
        signs = rng.choice(ALPHABETS)
        content = bytes(rng.choice(signs) for _ in range(rng.randint(0, 30)))
        if rng.random() < 0.5:
            content = "".join(rng.choice("aé漢😀\n\r") for _ in range(rng.randint(0, 12))).encode()
        read, n = reader(content), len(content)
        for size in (1, 2, 3, 5, 100):
            lines, counts, valid = [], [], []
            for begin, end in cuts(n, size):
                own = [line for block_ in ranges.lines_in(read, begin, end, n) for line in block_]
                assert len(own) == ranges.line_begins(read, begin, end, n), (content, size, begin)
                lines += own
                valid.append(ranges.valid_utf8(read, begin, end, n))
            text = b"\n".join(lines).decode("utf-8" if all(valid) else "latin-1")
            assert text == decode(content), (content, size)
            try:
                content.decode()
                assert all(valid), (content, size)
            except UnicodeDecodeError:
                assert not all(valid), (content, size)


@pytest.mark.parametrize("block", [1, 2, 1 << 20])
def test_records_of_any_cut(monkeypatch, block):
    monkeypatch.setattr(ranges, "_BLOCK", block)
    rng = random.Random(block)
    for _ in range(500):
        content = "".join(rng.choice(['"', ",", "\n", "\r", "a", '""', '"\n', ',"']) for _ in range(rng.randint(0, 20))).encode()
        read, n = reader(content), len(content)
        whole = list(ranges._rows(content, True)) if content.count(b'"') % 2 == 0 else None
        for size in (1, 2, 3, 7, 100):
            state, got, states = ranges.OUTSIDE, [], []
            for begin, end in cuts(n, size):
                scan = ranges.QuoteScan(state, content[begin - 1:begin] if begin else b"")
                for piece in ranges._blocks(read, begin, end):
                    scan.feed(piece)
                states.append(state)
                state = scan.state
            for (begin, end), before in zip(cuts(n, size), states):
                got += list(ranges.records_in(read, begin, end, n, before))
            assert b"".join(got) == content, (content, size)
            if whole is not None and state != ranges.INSIDE:
                rows = [row for records in got for row in ranges._rows(records, True)]
                assert rows == whole, (content, size)


def _tree(root):
    contents = {
        "a.txt": "é a@b.co\n\nip 1.2.3.4\r\nlast".encode(), "latin.log": "é\rc@d.org\n".encode("latin-1"),
        "empty.txt": b"", "one.txt": b"\n", "late.log": b"x" * 200 + b"\n" + b"\xff", "long.txt": ("漢" * 150).encode(),
        "sub/k.log": b"".join(b"line %d key AKIA%016d end\n" % (i, i) for i in range(40))}
    for name, content in contents.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)
    return {name: decode(content) for name, content in contents.items()}


@pytest.mark.parametrize("size", [64, 1 << 20])
def test_trees(spark, tmp_path, size):
    texts = _tree(tmp_path)
    pieces = ranges.read_text_pieces(spark, str(tmp_path), True, range_bytes=size, piece_bytes=size)
    got = {}
    for r in sorted(pieces.collect(), key=lambda r: r.first_line):
        got.setdefault(r.file.split(f"{tmp_path}/")[1], []).append((r.first_line, r.text))
    assert {k: "\n".join(t for _, t in v) for k, v in got.items()} == texts
    for own in got.values():
        assert all(b[0] == a[0] + a[1].count("\n") + 1 for a, b in zip(own, own[1:])) and own[0][0] == 1
    lines = ranges.read_text_lines(spark, str(tmp_path), True, range_bytes=size, piece_bytes=size).collect()
    assert sorted((r.file.split(f"{tmp_path}/")[1], r.line_no, r.line) for r in lines) == sorted(
        (k, i, line) for k, text in texts.items() for i, line in enumerate(text.split("\n"), 1))


def test_several_tasks_per_file(spark, tmp_path):
    (tmp_path / "big.txt").write_bytes(b"0123456789abcdef\n" * 20000)
    pieces = ranges.read_text_pieces(spark, str(tmp_path), range_bytes=1 << 12)
    parts = pieces.select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts > 4 and ranges.read_text_pieces(spark, str(tmp_path / "none")).count() == 0


def test_small_ranges_share_tasks(spark):
    cores = spark.sparkContext.defaultParallelism

    def tasks(count, size, asked):
        rows = spark.range(count).selectExpr("'f' AS path", f"id * {size} AS begin", f"(id + 1) * {size} AS `end`")
        return ranges.dealt(rows, asked).rdd.getNumPartitions()

    assert tasks(5000, 1 << 16, 1 << 16) == max(cores, 5)  # 5000 tasks would cost more than their work
    assert tasks(20 * cores, ranges.RANGE, 1 << 16) == 20 * cores  # large files still ask for more tasks
    assert tasks(3, 10, 10) == min(3, cores)



def test_file_beyond_two_gigabytes(spark, tmp_path):
    """A sparse file of 3 GB: lines behind 2 GB are found with their numbers."""
    path = tmp_path / "huge.log"
    with open(path, "wb") as out:
        for at in range(0, 3 << 30, 64 << 20):
            out.seek(at)
            out.write(b"\nmail u%d@a.org\n" % (at >> 20))
        out.truncate(3 << 30)
    ranges_ = ranges.byte_ranges(ranges.file_inventory(spark, str(path)))
    assert ranges_.count() == 48 and ranges_.agg(F.sum(F.col("end") - F.col("begin"))).first()[0] == 3 << 30
    read = lambda position, count: _at(path, position, count)
    begin, end = 40 * ranges.RANGE, 41 * ranges.RANGE
    assert ranges.line_begins(read, begin, end, 3 << 30) == 2
    first = next(iter(ranges.lines_in(read, begin, begin + 100, 3 << 30)))
    assert first[0] == b"mail u2560@a.org"


def _at(path, position, count):
    with open(path, "rb") as opened:
        opened.seek(position)
        return opened.read(count)


@pytest.mark.parametrize("size", [50, 1 << 20])
def test_jobs_do_not_depend_on_cuts(spark, tmp_path, size):
    texts = _tree(tmp_path / "in")
    found = jobs.scan_files(spark, str(tmp_path / "in"), True, range_bytes=size).collect()
    assert sorted((r.file.split("/in/")[1], r.line, r.column, r.value) for r in found) == [
        ("a.txt", 1, 3, "a@b.co"), ("a.txt", 3, 4, "1.2.3.4"), ("latin.log", 2, 1, "c@d.org")]
    row = jobs.scan_files_summary(spark, str(tmp_path / "in"), True, range_bytes=size).first()
    assert (row.files_found, row.files_scanned, row.files_with_pii, row.total_findings) == (7, 7, 2, 3)
    out = str(tmp_path / "out")
    stats = jobs.sanitize_files(spark, str(tmp_path / "in"), out, True, range_bytes=size).first()
    assert stats.total_lines == sum(t.count("\n") + 1 for t in texts.values())
    assert (stats.lines_modified, stats.type_counts) == (43, {"EMAIL": 2, "IPV4": 1, "AWS_KEY": 40})
    assert stats == jobs.sanitize_files(spark, str(tmp_path / "in"), None, True, range_bytes=size).first()
    clean = {}
    for r in sorted(spark.read.parquet(out).collect(), key=lambda r: r.first_line):
        clean.setdefault(r.output_name.split("/in/")[1], []).append(r.text)
    assert set(clean) == {"a_sanitized.txt", "latin_sanitized.log", "sub/k_sanitized.log"}
    assert "\n".join(clean["sub/k_sanitized.log"]).count("[AWS_KEY_") == 40


@pytest.mark.parametrize("size", [33, 1 << 20])
def test_csv(spark, tmp_path, size):
    rng = random.Random(size)
    rows = [[str(i), rng.choice(["", "plain", 'q"uote', "two\nlines", "a,b", "cr\r\nlf", " outer ", "漢字", '"', "\n\n"]),
             rng.choice([None, "x", "é"])] for i in range(60)]
    text = io.StringIO(newline="")
    csv.writer(text, quoting=csv.QUOTE_NOTNULL).writerows([["id", "note", "more"], *rows])
    (tmp_path / "utf.csv").write_text(text.getvalue(), encoding="utf-8", newline="")
    got = tables.read_csv_strings(spark, str(tmp_path / "utf.csv"), range_bytes=size)
    assert got.columns == ["id", "note", "more"]
    assert sorted(map(list, got.collect()), key=lambda r: int(r[0])) == rows


def test_csv_encodings_and_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("name,n\nJürgen,1\n\nshort\n".encode("latin-1"))
    (tmp_path / "b.csv").write_bytes("﻿name,n\r\nJürgen,\"\"\r\n".encode())
    (tmp_path / "_SUCCESS").write_bytes(b"")
    (tmp_path / ".a.csv.crc").write_bytes(b"\x00crc\xff")
    (tmp_path / "c.csv").write_bytes(b"")
    for size in (4, 1 << 20):
        got = tables.read_csv_strings(spark, str(tmp_path), na_values=["NA"], range_bytes=size).collect()
        assert sorted(map(tuple, got), key=repr) == [("Jürgen", ""), ("Jürgen", "1"), ("short", None)]
    (tmp_path / "d.csv").write_bytes(b"other,n\n1,2\n")
    with pytest.raises(ValueError, match="different headers"):
        tables.read_csv_strings(spark, str(tmp_path))
    (tmp_path / "e").mkdir()
    (tmp_path / "e/long.csv").write_bytes(b"a,b\n1,2,3\n")
    with pytest.raises(Exception, match="3 values under 2 names"):
        tables.read_csv_strings(spark, str(tmp_path / "e")).collect()
    (tmp_path / "f").mkdir()
    (tmp_path / "f/x.csv").write_bytes(b"\n\r\n\na,,A,a`b\n1,2,3,4\n")
    for size in (2, 3, 1000):
        df = tables.read_csv_strings(spark, str(tmp_path / "f"), range_bytes=size)
        assert df.columns == ["a0", "_c1", "A2", "a`b"] and [tuple(r) for r in df.collect()] == [("1", "2", "3", "4")]
    assert tables.read_csv_strings(spark, str(tmp_path / "c.csv")).columns == []
    import gzip
    (tmp_path / "g.csv.gz").write_bytes(gzip.compress(b"a,b\n1,2\n"))
    assert [tuple(r) for r in tables.read_csv_strings(spark, str(tmp_path / "g.csv.gz")).collect()] == [("1", "2")]
