"""Encrypted file trees of any size: files in frames, each sealed with its place.

A file is cut into chunks.  Every chunk is encrypted by itself (AES-256-GCM, a random nonce and a
tag each) and authenticated together with the file's random mark, its name, the number of the
chunk and whether it is the last, so frames that are changed, swapped, repeated, moved to another
file or cut off do not pass.  Files are read and written by the executors, chunk by chunk; none has to
fit into a task.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cloakframe.functions import fixed_values as fixed
from cloakframe.operators.crypto import derive_key
from cloakframe.sources.files import file_inventory, file_system_of
from cloakframe.sources.scratch import materialized

CHUNK = 1 << 20
_KEY = "_frame_key"


def _sealed_place() -> Column:
    """What a frame is authenticated with besides its content."""
    return F.concat_ws(":", F.hex("file_mark"), F.col("number").cast("string"), F.col("last").cast("string"), F.col("rel_path"))


def _with_key(df: DataFrame, password: str, salt: bytes, rounds: int) -> DataFrame:
    key = bytearray(derive_key(password, salt, rounds))
    return df.withColumn(_KEY, df.sparkSession.createDataFrame([(key,)], "key binary").scalar())


def _marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.assign(file_mark=[secrets.token_bytes(16) for _ in range(len(batch))])


def _chunks():
    resolve = file_system_of()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, where = resolve(row["path"])
                with system.open_input_file(where) as opened:
                    row["content"] = opened.read_at(row["end"] - row["begin"], row["begin"])
                if len(row["content"]) != row["end"] - row["begin"]:
                    raise OSError(f"{row['path']} ends before byte {row['end']}")
                yield pa.RecordBatch.from_pylist([row], pa.schema([*batch.schema, ("content", pa.binary())]))

    return run


def encrypt_files(spark: SparkSession, folder: str, password: str, recursive: bool = True, chunk: int = CHUNK,
                  rounds: int = fixed.KDF_ROUNDS) -> DataFrame:
    """Frames of all files of a folder: rel_path, file_mark, number, last, salt, blob.

    One random salt for the tree.  Nonces are random, so write the frames before reading them more than
    once.  An empty file is one empty frame.
    """
    salt = secrets.token_bytes(fixed.SALT_BYTES)
    found = file_inventory(spark, folder, recursive).select(
        "path", F.substring("path", len(folder.rstrip("/")) + 2, 2**31 - 1).alias("rel_path"), "length")
    marked = materialized(found.mapInPandas(
        _marked, "path string, rel_path string, length bigint, file_mark binary"), "file-marks")
    begins = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("length") - 1, F.lit(0).cast("bigint")), F.lit(chunk).cast("bigint"))
    places = marked.select("*", F.posexplode(begins).alias("number", "begin")).withColumn(
        "end", F.least(F.col("begin") + chunk, F.col("length"))).withColumn("last", F.col("end") == F.col("length"))
    spread = places.repartition(4 * spark.sparkContext.defaultParallelism, "path", "number")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spread.schema)
    frames = _with_key(spread.mapInArrow(_chunks(), f"{fields}, content binary"), password, salt, rounds)
    blob = F.aes_encrypt("content", _KEY, F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), _sealed_place())
    return frames.select("rel_path", "file_mark", "number", "last", F.lit(bytearray(salt)).alias("salt"), blob.alias("blob"))


def decrypt_frames(frames: DataFrame, password: str, rounds: int = fixed.KDF_ROUNDS) -> DataFrame:
    """rel_path, file_mark, number, last and content, null where a frame does not pass.

    The salts of the frames (one per encrypted tree) are collected; they are not secret.
    """
    salts = [bytes(r.salt) for r in frames.select("salt").distinct().collect()]
    out = None
    for salt in salts:
        own = _with_key(frames.filter(F.col("salt") == F.lit(bytearray(salt))), password, salt, rounds)
        content = F.try_aes_decrypt("blob", _KEY, F.lit("GCM"), F.lit("DEFAULT"), _sealed_place().cast("binary"))
        rows = own.select("rel_path", "file_mark", "number", "last", content.alias("content"))
        out = rows if out is None else out.union(rows)
    if out is None:
        out = frames.select("rel_path", "file_mark", "number", "last", F.col("blob").alias("content"))
    return out


def frame_status(opened: DataFrame) -> DataFrame:
    """rel_path, frames, size and status of each file: OK if all its frames passed, once each, to the last."""
    told = opened.groupBy("rel_path").agg(
        F.count("*").alias("frames"), F.countDistinct("number").alias("_numbers"), F.max("number").alias("_highest"),
        F.max(F.when(F.col("last"), F.col("number"))).alias("_end"), F.min("file_mark").alias("_mark"),
        F.max("file_mark").alias("_other"), F.count_if(F.col("content").isNull()).alias("_failed"),
        F.sum(F.octet_length("content")).cast("bigint").alias("size"))
    good = (F.col("_failed") == 0) & (F.col("frames") == F.col("_numbers")) & (F.col("_highest") == F.col("frames") - 1) & (
        F.col("_end") == F.col("_highest")) & (F.col("_mark") == F.col("_other"))
    status = F.when(F.coalesce(good, F.lit(False)), "OK").otherwise("FAILED")
    return told.select("rel_path", "frames", "size", status.alias("status"))


def _restored(folder: str):
    resolve = file_system_of()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = resolve(folder)
        stream, name, files = None, None, 0
        for batch in batches:
            for place, content in zip(batch.column("rel_path"), batch.column("content")):  # one frame at a time
                if place.as_py() != name:
                    if stream:
                        stream.close()
                    name, files = place.as_py(), files + 1
                    where = f"{root.rstrip('/')}/{name}"
                    system.create_dir(where.rpartition("/")[0], recursive=True)
                    stream = system.open_output_stream(where, compression=None)
                stream.write(content.as_py())
        if stream:
            stream.close()
        yield pa.RecordBatch.from_pydict({"files": pa.array([files], pa.int64())})

    return run


def restore_files(opened: DataFrame, folder: str) -> DataFrame:
    """Write the files whose status is OK below ``folder``; the status of all of them.

    One task writes a file, frame after frame in order, and holds one at a time.
    """
    status = materialized(frame_status(opened), "frame-status")
    good = opened.join(status.filter("status = 'OK'").select("rel_path"), "rel_path", "left_semi")
    tasks = 4 * opened.sparkSession.sparkContext.defaultParallelism
    ordered = good.select("rel_path", "number", "content").repartition(tasks, "rel_path").sortWithinPartitions("rel_path", "number")
    ordered.mapInArrow(_restored(folder), "files bigint").agg(F.sum("files")).collect()
    return status


def encryption_summary(status: DataFrame) -> DataFrame:
    """One row: files that succeeded and failed."""
    return status.agg(F.count_if(F.col("status") == "OK").alias("succeeded"),
                      F.count_if(F.col("status") != "OK").alias("failed"))
