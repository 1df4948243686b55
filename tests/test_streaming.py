from cloakframe.operators import anonymize as anon, detect, sanitize as san
from cloakframe.plans import catalog
from cloakframe.streaming import streams


def _run(spark, stream, path):
    streams.run_available(stream, f"{path}/out", f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/out")


def test_streams_equal_tables(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    stream = streams.table_stream(spark, small, docs.schema, "documents.parquet")
    cases = {
        "sanitize": (streams.sanitize_stream(stream, "text", "all"), san.sanitize(docs, "text", "all")),
        "scan": (streams.scan_stream(stream, "text", keep=["doc_id"]),
                 detect.scan_text(docs, "text", keep=["doc_id"])),
        "anonymize": (streams.anonymize_stream(stream, {"source": "company"}),
                      anon.anonymize(docs, {"source": "company"})),
    }
    for name, (streamed, table) in cases.items():
        got = _run(spark, streamed, tmp_path / name)
        assert got.count() == table.count() > 0
        assert got.exceptAll(table).count() == 0


def test_log_stream_goes_on(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.log").write_text("ip 10.0.0.1\n")
    stream = streams.sanitize_stream(streams.text_stream(spark, str(logs)), "value")
    _run(spark, stream, tmp_path)
    (logs / "b.log").write_text("ip 10.0.0.1\nclean\n")
    rows = [r.value for r in _run(spark, stream, tmp_path).collect()]
    assert len(rows) == 3 and len(set(rows)) == 2 and "10.0.0.1" not in "".join(rows)


def test_stream_query_reads_a_folder_of_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, "ip 10.0.0.1\nplain"), (2, None), (3, "")], "doc_id long, text string")
    for name, parts in (("one", 1), ("several", 3)):
        rows.repartition(parts).write.parquet(f"{tmp_path}/{name}/documents.parquet")
    rows.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    part = next((tmp_path / "one" / "documents.parquet").glob("part-*"))
    (tmp_path / "file").mkdir()
    (tmp_path / "file" / "documents.parquet").write_bytes(part.read_bytes())
    want = san.sanitize(rows, "text", "all")
    for name in ("one", "several", "file"):
        got = catalog.sanitize_stream(spark, f"{tmp_path}/{name}")
        assert got.count() == 3 and got.exceptAll(want).count() == 0
    assert catalog.sanitize_stream(spark, f"{tmp_path}/none").columns == ["doc_id", "text"]
