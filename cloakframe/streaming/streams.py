"""The row-wise operators on streams, with a run over all available input."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from cloakframe.operators.anonymize import anonymize
from cloakframe.operators.detect import scan_text
from cloakframe.operators.sanitize import sanitize


def text_stream(spark: SparkSession, path: str) -> DataFrame:
    """Lines of log files as they arrive in a folder: column ``value``."""
    return spark.readStream.text(path)


def table_stream(spark: SparkSession, path: str, schema: StructType,
                 files: str = "*.parquet") -> DataFrame:
    """Rows of parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(path)


def sanitize_stream(stream: DataFrame, column: str, types: Iterable[str] | None = None,
                    key: str = "") -> DataFrame:
    """Same expressions, same results as on a table; no state is kept."""
    return sanitize(stream, column, types, key)


def scan_stream(stream: DataFrame, column: str, types: Iterable[str] | None = None,
                keep: Sequence[str] | None = None) -> DataFrame:
    return scan_text(stream, column, types, keep)


def anonymize_stream(stream: DataFrame, plan: Mapping[str, str], key: str = "") -> DataFrame:
    """Needs a plan: columns of a stream cannot be sampled."""
    return anonymize(stream, plan, key)


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Write everything there is to parquet and stop; restarts go on where it ended."""
    query = (
        stream.writeStream.format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
