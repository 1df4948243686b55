"""Files as tables: inventory, decoded text, numbered lines, streamed digests."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cloakframe.functions.formatting import extension
from cloakframe.sources.scratch import materialized

_BLOCK = 1 << 20
#: Entries of a folder that make one batch.
_ROWS = 4096


def file_system_of() -> Callable[[str], tuple]:
    """Function from a location to its file system and path there.

    Made anew, so that it is shipped by value: workers need not have this package.
    """

    def resolve(location: str) -> tuple:
        from pyarrow import fs

        scheme, colon, rest = location.partition(":")
        if not colon or "/" in scheme:
            return fs.LocalFileSystem(), location
        if scheme == "file":
            return fs.LocalFileSystem(), "/" + rest.lstrip("/")
        authority, _, path = rest.removeprefix("//").partition("/")
        system, root = fs.FileSystem.from_uri(f"{scheme}://{authority}/")
        return system, root.rstrip("/") + "/" + path

    return resolve


def has_extension(path: Column, extensions: Iterable[str], allow_no_suffix: bool = False) -> Column:
    """Whether the file name ends in one of the extensions, in any case."""
    wanted = [e.lower() for e in extensions] + ([""] if allow_no_suffix else [])
    return extension(path).isin(*wanted)


def _listed(places: DataFrame) -> DataFrame:
    """Files among the places and entries of the directories among them."""
    resolve, columns = file_system_of(), ["path", "length", "modificationTime", "is_dir"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for frame in frames:
            for place in frame["path"]:
                rows = []
                system, where = resolve(place)
                found = system.get_file_info(where)
                if found.type == fs.FileType.Directory:
                    entries = system.get_file_info(fs.FileSelector(where))
                    if isinstance(system, fs.LocalFileSystem):  # a link may lead back up
                        entries = [e for e in entries
                                   if e.type != fs.FileType.Directory or not os.path.islink(e.path)]
                else:
                    entries = [found]
                head = place[: len(place) - len(where)] if place.endswith(where) else ""
                for e in entries:
                    if e.type != fs.FileType.NotFound:
                        is_dir = e.type == fs.FileType.Directory
                        rows.append((head + e.path, None if is_dir else e.size, e.mtime, is_dir))
                    if len(rows) == _ROWS:  # a folder of any size, some entries at a time
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    return places.mapInPandas(
        run, "path string, length bigint, modificationTime timestamp, is_dir boolean"
    )


def file_inventory(spark: SparkSession, path: str | Sequence[str], recursive: bool = False,
                   extensions: Iterable[str] | None = None,
                   allow_no_suffix: bool = False) -> DataFrame:
    """path, length and modificationTime of files, each once, ordered by path.

    Executors list the directories, level by level, and contents are not read.
    Links to directories are not followed.  Unlike Spark's file sources this keeps empty files and names that begin with
    a dot or an underscore.
    """
    roots = [path] if isinstance(path, str) else list(path)
    places = spark.createDataFrame([(r.rstrip("/") or "/",) for r in roots], "path string")
    levels: list[DataFrame] = []
    while True:
        level = materialized(_listed(places), "listing")
        levels.append(level.filter("not is_dir"))
        places = level.filter("is_dir").select("path")
        if not recursive or places.isEmpty():
            break
        places = places.repartition(spark.sparkContext.defaultParallelism)
    files = reduce(DataFrame.unionByName, levels).drop("is_dir")
    if extensions is not None:
        files = files.filter(has_extension(F.col("path"), extensions, allow_no_suffix))
    return files.dropDuplicates(["path"]).orderBy("path")


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8, else Latin-1; line ends become line feeds."""
    plain = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(
        F.decode(content, "ISO-8859-1")
    )
    return F.regexp_replace(plain, "\r\n?", "\n")


def read_texts(spark: SparkSession, path: str | Sequence[str], recursive: bool = False,
               extensions: Iterable[str] | None = None,
               allow_no_suffix: bool = False) -> DataFrame:
    """file and text, one row per file (below 2 GiB each; a larger one stops the job).

    The files are those of :func:`file_inventory`: empty ones and names that begin with
    . or _ too.  Executors read them, spread by path.
    """
    resolve = file_system_of()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place in batch.column(0).to_pylist():
                system, where = resolve(place)
                with system.open_input_stream(where, compression=None) as stream:
                    content = stream.read()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([place]), pa.array([content], pa.binary())], ["path", "content"]
                )

    found = file_inventory(spark, path, recursive, extensions, allow_no_suffix).select("path")
    spread = found.repartition(4 * spark.sparkContext.defaultParallelism, "path")
    files = spread.mapInArrow(run, "path string, content binary")
    return files.select(F.col("path").alias("file"), decoded(F.col("content")).alias("text"))


def read_log_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """file and line of UTF-8 logs of any size, split within files; no line numbers."""
    lines = spark.read.text(path if isinstance(path, str) else list(path))
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))


def digest_files(paths: DataFrame, path: str = "path", algorithm: str = "sha256",
                 head: int | None = None) -> DataFrame:
    """path, length and digest of files of any size, read block by block, and bytes_read.

    For a chosen set of files, such as same-size pairs, where reading whole
    contents into rows would be too much.  Paths are spread over the executors.  With ``head`` only that
    many first bytes are read; ``length`` is then null unless they are the whole file.
    """

    resolve, block_size = file_system_of(), _BLOCK

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for place in frame[path]:
                system, where = resolve(place)
                state, size, whole = hashlib.new(algorithm), 0, False
                with system.open_input_stream(where, compression=None) as stream:
                    while head is None or size < head:
                        block = stream.read(block_size if head is None else min(block_size, head - size))
                        if not block:
                            whole = True
                            break
                        state.update(block)
                        size += len(block)
                rows.append((place, size if whole else None, state.hexdigest(), size))
            yield pd.DataFrame(rows, columns=["path", "length", "digest", "bytes_read"]).astype({"length": "Int64"})

    hashlib.new(algorithm)
    return paths.select(path).mapInPandas(run, "path string, length bigint, digest string, bytes_read bigint")


def stat_files(paths: DataFrame, path: str = "path") -> DataFrame:
    """path, accessed, created, permissions and error of files, from the executors' view.

    Times and permissions are known for local and mounted file systems only, else null; a file that cannot
    be looked at has its error instead.
    """
    resolve = file_system_of()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for frame in frames:
            rows = []
            for place in frame[path]:
                accessed = created = permissions = error = None
                try:
                    system, where = resolve(place)
                    if isinstance(system, fs.LocalFileSystem):
                        found = os.stat(where)
                        accessed, created = (pd.Timestamp(t, unit="s", tz="UTC") for t in (found.st_atime, found.st_ctime))
                        permissions = oct(found.st_mode)[-3:]
                    elif system.get_file_info(where).type == fs.FileType.NotFound:
                        error = "not found"
                except OSError as problem:
                    error = problem.strerror or str(problem)
                rows.append((place, accessed, created, permissions, error))
            yield pd.DataFrame(rows, columns=["path", "accessed", "created", "permissions", "error"]).astype(
                {"accessed": "datetime64[us, UTC]", "created": "datetime64[us, UTC]"})

    return paths.select(path).mapInPandas(
        run, "path string, accessed timestamp, created timestamp, permissions string, error string")


def write_texts(df: DataFrame, folder: str, name: str = "name", text: str = "text") -> int:
    """Write each row's text, as UTF-8, to the file of its name below ``folder``; the number of files.

    Names may have folders in them and must differ.  Executors write; a task that runs again writes
    the same files anew.  A null text is an empty file.
    """
    resolve = file_system_of()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = resolve(folder)
        for batch in batches:
            for place, body in zip(batch.column("name"), batch.column("text")):  # one text at a time in Python
                where = f"{root.rstrip('/')}/{place.as_py()}"
                system.create_dir(where.rpartition("/")[0], recursive=True)
                with system.open_output_stream(where, compression=None) as out:
                    out.write((body.as_py() or "").encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_pydict({"files": pa.array([batch.num_rows], pa.int64())})

    rows = df.select(F.col(name).alias("name"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "files bigint").agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]
