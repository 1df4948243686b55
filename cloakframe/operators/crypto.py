"""Authenticated encryption of columns with password-derived keys.

A blob is salt, nonce, ciphertext and tag.  Encryption and decryption run inside
the JVM; Python only derives keys, once per salt.  Keys travel in small tables,
not as literals, so they show up neither in plans nor in event logs.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cloakframe.functions import fixed_values as fixed
from cloakframe.operators.spread import heavy_join
from cloakframe.sources.scratch import materialized

_HEAD = fixed.SALT_BYTES
_SMALLEST = fixed.SALT_BYTES + fixed.NONCE_BYTES + fixed.TAG_BYTES


def derive_key(password: str, salt: bytes, rounds: int = fixed.KDF_ROUNDS) -> bytes:
    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt, rounds, fixed.KEY_BYTES)


def derive_keys(salts: DataFrame, salt: str, password: str,
                rounds: int = fixed.KDF_ROUNDS) -> DataFrame:
    """Table of the given salts, which are distinct, and their keys; executors do the work."""

    size = fixed.KEY_BYTES

    # Plain closure: workers need not have this package installed.
    def derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_pylist()
            keys = [
                hashlib.pbkdf2_hmac("sha256", password.encode(), v, rounds, size) for v in values
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(values, pa.binary()), pa.array(keys, pa.binary())], ["salt", "key"]
            )

    return salts.select(F.col(salt).cast("binary").alias("salt")).mapInArrow(derive, "salt binary, key binary")


def encrypt(df: DataFrame, column: str, password: str, salt: bytes | None = None,
            n_salts: int = 1, rounds: int = fixed.KDF_ROUNDS) -> DataFrame:
    """Encrypt a string or binary column in place.

    One random salt for the whole table by default; ``n_salts`` spreads the rows
    over several keys, which the executors derive.  Rows are joined with the keys by a hash of their
    content; the optimizer broadcasts a small table.  Nonces are random, so write the result before reading it more
    than once.
    """
    if n_salts < 1:
        raise ValueError("n_salts must be at least 1")
    if salt is not None and (n_salts != 1 or len(salt) != fixed.SALT_BYTES):
        raise ValueError(f"a given salt is the only one and has {fixed.SALT_BYTES} bytes")
    spark = df.sparkSession
    rows = [(i, bytearray(salt or secrets.token_bytes(fixed.SALT_BYTES))) for i in range(n_salts)]
    slots = spark.createDataFrame(rows, "_slot bigint, _salt binary")
    tasks = min(n_salts, 4 * spark.sparkContext.defaultParallelism)
    derived = derive_keys(slots.select("_salt").repartition(tasks), "_salt", password, rounds)
    keys = slots.join(derived.select(F.col("salt").alias("_salt"), F.col("key").alias("_key")), "_salt")
    slotted = df.withColumn("_slot", F.pmod(F.xxhash64(column), F.lit(n_salts).cast("bigint")))
    joined = heavy_join(slotted, keys, ["_slot"], "inner") if n_salts > 1 else slotted.join(F.broadcast(keys), "_slot")
    blob = F.concat("_salt", F.aes_encrypt(F.col(column).cast("binary"), "_key", F.lit("GCM")))
    return joined.select(*[blob.alias(c) if c == column else F.col(c) for c in df.columns])


def decrypt(df: DataFrame, column: str, password: str, salt: bytes | None = None,
            rounds: int = fixed.KDF_ROUNDS, few_salts: bool = False) -> DataFrame:
    """Decrypt a blob column in place to binary; failures become null.

    A blob fails if it is too short, was changed, or the password is wrong.
    With a known single ``salt`` only one key is derived.  Otherwise the distinct
    salts (not secret) are written to the scratch folder and their keys joined back, by a join that stays
    balanced when most blobs share one salt; ``few_salts`` says that their keys may be broadcast.
    """
    spark = df.sparkSession
    head = F.substring(F.col(column), 1, _HEAD)
    salted = df.withColumn("_salt", F.when(F.octet_length(column) >= _SMALLEST, head))
    if salt is not None:
        row = (bytearray(salt), bytearray(derive_key(password, salt, rounds)))
        keys, few_salts = spark.createDataFrame([row], "salt binary, key binary"), True
    else:
        salts = materialized(salted.filter("_salt is not null").select("_salt").distinct(), "salts")
        tasks = max(1, min(salts.count(), 4 * spark.sparkContext.defaultParallelism))
        keys = derive_keys(salts.repartition(tasks), "_salt", password, rounds)
    keys = keys.select(F.col("salt").alias("_salt"), F.col("key").alias("_key"))
    joined = (
        salted.join(F.broadcast(keys), "_salt", "left") if few_salts
        else heavy_join(salted, keys, ["_salt"], "left")
    )
    body = F.substring(F.col(column), _HEAD + 1, 2**31 - 1 - _HEAD)
    plain = F.when(F.col("_key").isNotNull(), F.try_aes_decrypt(body, F.col("_key"), F.lit("GCM")))
    return joined.select(*[plain.alias(c) if c == column else F.col(c) for c in df.columns])


def encryption_stats(df: DataFrame, column: str) -> DataFrame:
    """One row: how many values there are and how many failed (are null)."""
    value: Column = F.col(column)
    return df.agg(
        F.count_if(value.isNotNull()).alias("succeeded"),
        F.count_if(value.isNull()).alias("failed"),
    )
