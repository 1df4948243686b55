"""Private key blocks over the lines and batches of a stream."""

import random

import pytest
from pyspark.sql import functions as F

from cloakframe.operators import sanitize as san
from cloakframe.streaming.key_blocks import Holder, sanitize_key_blocks

KEY_LINES = ["-----BEGIN RSA PRIVATE KEY-----", "abc", "def", "-----END RSA PRIVATE KEY-----"]


def test_holder_equals_whole_texts(spark):
    rng = random.Random(4)
    parts = ["x", "", "a " + KEY_LINES[0], KEY_LINES[1], KEY_LINES[3] + " b", KEY_LINES[3], KEY_LINES[0],
             "".join(KEY_LINES), KEY_LINES[3] + KEY_LINES[0], "-----END"]
    texts = ["\n".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    whole = {r.id: r.text for r in san.sanitize(df, "text", "private_key", mode="document").collect()}
    for i, text in enumerate(texts):
        holder, out = Holder([], 1000, None), []
        for place, line in enumerate(text.split("\n")):
            out += holder.feed(place, line)
        out += holder.give_up()
        assert "\n".join(x for _, x in out) == whole[i], text
        assert [p for p, _ in out] == sorted(p for p, _ in out)


def test_a_block_without_end_passes_after_so_many_lines():
    holder = Holder([], 3, None)
    out = [holder.feed(i, x) for i, x in enumerate([KEY_LINES[0], "1", "2", "3", "4"])]
    assert [len(x) for x in out] == [0, 0, 0, 4, 1]


@pytest.mark.parametrize("key", ["", "a secret key"])
def test_block_over_two_batches_and_a_restart(spark, tmp_path, key):
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    lines = ["start", *KEY_LINES, "after", "10.0.0.1", KEY_LINES[0], "never ends"]

    def add(first, last):
        rows = [(name, i, lines[i]) for name in ("one", "two") for i in range(first, last)]
        spark.createDataFrame(rows, "host string, n bigint, line string").repartition(3).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema("host string, n bigint, line string").parquet(source)
        made = sanitize_key_blocks(stream, "host", "n", "line", key, timeout=None)
        san.sanitize(made, "line").writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination(60)

    add(0, 3)  # the block begins in this batch
    run()
    assert {(r.host, r.n, r.line) for r in spark.read.parquet(out).collect()} == {("one", 0, "start"), ("two", 0, "start")}
    add(3, 9)  # and ends in one of a restarted query
    run()
    got = {}
    for r in spark.read.parquet(out).orderBy("n").collect():
        got.setdefault(r.host, []).append((r.n, r.line))
    block = spark.createDataFrame([("\n".join(KEY_LINES),)], "text string")
    wanted = san.sanitize(block, "text", "private_key", key, mode="document").first().text
    ip = san.sanitize(spark.createDataFrame([("10.0.0.1",)], "line string"), "line").first().line
    assert got["one"] == got["two"] == [(0, "start"), (1, wanted), (5, "after"), (6, ip)]
    if key:
        files = [p for p in (tmp_path / "checkpoint").rglob("*") if p.is_file()]
        assert files and not any(key.encode() in p.read_bytes() for p in files)


def test_a_late_end_gives_the_lines_back(spark, tmp_path):
    import time

    source = str(tmp_path / "in")
    spark.createDataFrame([("h", 0, KEY_LINES[0]), ("h", 1, "held")], "host string, n bigint, line string").write.parquet(source)
    stream = spark.readStream.schema("host string, n bigint, line string").option("maxFilesPerTrigger", 1).parquet(source)
    query = sanitize_key_blocks(stream, "host", "n", "line", timeout="1 second").writeStream.format("memory").queryName(
        "late").start()
    try:
        end = time.time() + 30
        while time.time() < end and spark.table("late").count() < 2:
            time.sleep(0.5)
        assert [(r.n, r.line) for r in spark.table("late").orderBy("n").collect()] == [(0, KEY_LINES[0]), (1, "held")]
    finally:
        query.stop()
