"""Where intermediate tables go."""

from __future__ import annotations

import secrets
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from cloakframe.functions.keyed import under_key
from cloakframe.functions.matching import name


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """A new path in the shared folder of the cluster, or a local one in local mode.

    Tables left there may be deleted once the results that read them are written.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="cloakframe-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def materialized(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written once and read back, for small results of costly plans used twice.

    A written table survives lost executors and cuts the lineage.  Never used for
    raw personal values.
    """
    path = scratch_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sealed(df: DataFrame, purpose: str, columns: Sequence[str]) -> DataFrame:
    """Like :func:`materialized`, with the string ``columns`` encrypted as they lie there.

    The key is random, known to this session only and in no plan; the folder holds no readable
    value of the columns.
    """
    key = secrets.token_hex(16)
    closed = under_key(df, key, lambda rows, k: rows.withColumns(
        {c: F.expr(f"aes_encrypt({name(c)}, {k})") for c in columns}))
    return under_key(materialized(closed, purpose), key, lambda rows, k: rows.withColumns(
        {c: F.expr(f"cast(aes_decrypt({name(c)}, {k}) as string)") for c in columns}))
