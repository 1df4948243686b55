"""Repeated lines over the whole collection, kept in levelled sorted runs of line hashes.

A run is a table sorted by line hash with, for each hash, the number of documents that
hold the line so far and the largest of their ids.  A batch is first joined with the
runs: lines it shares with them carry on their totals, lines not in any run (the
anti-join) begin new ones; both form the batch's own run, which hides older entries
of the same hash.  After every ``fan`` runs of a level these are merged into one of
the next level, the newer anti-joined from the older.  Only hashes lie in the runs.

The main path uses built-in expressions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from cloakframe.llm.tables import keyed_texts, stored
from cloakframe.operators.spread import spread_join

_HASH = ["h1", "h2"]
_BLANKS = r"[\x20\x09-\x0D]"


def line_key(line: str) -> str:
    """SQL text of a line's key: ASCII blanks at both ends stripped, A-Z lower-cased."""
    return (f"translate(regexp_replace({line}, r'^{_BLANKS}+|{_BLANKS}++\\z', ''), "
            "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")


def hashed_lines(docs: DataFrame, least: int = 20) -> DataFrame:
    """doc_id and the distinct (h1, h2) of its lines whose keys have ``least`` code points."""
    keys = f"transform(split(text, '\n', -1), line -> {line_key('line')})"
    return keyed_texts(docs).select("doc_id", F.expr(
        f"array_distinct(transform(filter({keys}, key -> length(key) >= {int(least)}), "
        "key -> named_struct('h1', xxhash64(key), 'h2', xxhash64(key, 1))))").alias("lines"))


class LineRuns:
    """The levelled runs; ``add`` takes batches of hashed lines of different documents."""

    def __init__(self, fan: int = 4):
        self.fan = fan
        self.levels: list[list[DataFrame]] = []  # newest run last

    def _all(self) -> list[DataFrame]:
        """Newest first: a lower level is newer than a higher one."""
        return [run for level in self.levels for run in reversed(level)]

    @staticmethod
    def _sorted(run: DataFrame, name: str) -> DataFrame:
        return stored(run.repartition(*_HASH).sortWithinPartitions(*_HASH), name)

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        """The newest entry of every hash; ``runs`` are newest first."""
        return reduce(lambda new, old: new.unionByName(old.join(new, _HASH, "left_anti")), runs)

    def totals(self) -> DataFrame | None:
        """h1, h2, n_docs, last_doc over all batches so far."""
        runs = self._all()
        return self._merged(runs) if runs else None

    def add(self, lines: DataFrame) -> DataFrame:
        """Take in a batch (doc_id, lines); returns its run, with ``fresh`` for unseen lines."""
        own = lines.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("lines"))
        own = own.select("doc_id", F.inline("lines")).groupBy(*_HASH).agg(
            F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))
        before = self.totals()
        if before is None:
            run = own.withColumn("fresh", F.lit(True))
        else:
            own = stored(own, "batch")
            fresh = own.join(before, _HASH, "left_anti").withColumn("fresh", F.lit(True))
            known = own.join(before.select(*_HASH, F.col("n_docs").alias("n"), F.col("last_doc").alias("last")),
                             _HASH).select(
                *_HASH, (F.col("n_docs") + F.col("n")).alias("n_docs"),
                F.greatest("last_doc", "last").alias("last_doc"), F.lit(False).alias("fresh"))
            run = fresh.union(known)
        run = self._sorted(run, "line-run")
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(run)
        self._compact()
        return run

    def _compact(self) -> None:
        for at in range(len(self.levels)):
            if len(self.levels[at]) >= self.fan:
                merged = self._sorted(self._merged(self.levels[at][::-1]), f"line-level{at + 1}")
                self.levels[at] = []
                if at + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[at + 1].append(merged)


def drop_repeated_lines(docs: DataFrame, totals: DataFrame, lines: DataFrame,
                        least_docs: int = 3) -> DataFrame:
    """doc_id, text, rest, n_lines, n_dropped: texts without lines that ``totals`` gives to a later document.

    ``rest`` holds the other columns of ``docs`` as a struct.
    """
    repeated = totals.filter(F.col("n_docs") >= least_docs).select(*_HASH, "last_doc")
    hit = spread_join(lines.select("doc_id", F.inline("lines")), repeated, _HASH, "inner").filter(
        ~F.col("doc_id").eqNullSafe(F.col("last_doc")))
    gone = hit.groupBy("doc_id").agg(F.collect_set(F.struct(*_HASH)).alias("gone"))
    key = line_key("line")
    keep = (f"filter(split(text, '\n', -1), line -> not array_contains(gone, "
            f"named_struct('h1', xxhash64({key}), 'h2', xxhash64({key}, 1))))")
    rest = F.struct(F.lit(1).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.coalesce("text", F.lit("")).alias("text"), rest.alias("rest"))
    cut = texts.join(gone, "doc_id", "left").withColumn(
        "left", F.when(F.col("gone").isNotNull(), F.expr(keep)))
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    n_lines = n_lines.cast("long")
    return cut.select(
        "doc_id", F.coalesce(F.array_join("left", "\n"), "text").alias("text"), "rest", n_lines.alias("n_lines"),
        F.when(F.col("left").isNull(), F.lit(0)).otherwise(n_lines - F.size("left")).cast("long").alias("n_dropped"))


def _deduped(docs: DataFrame, least: int, least_docs: int, batches: int, fan: int) -> DataFrame:
    lines = stored(hashed_lines(docs, least).filter("size(lines) > 0"), "lines")
    runs = LineRuns(fan)
    for at in range(batches):
        runs.add(lines.filter(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == at))
    return drop_repeated_lines(docs, runs.totals(), lines, least_docs)


def dedup_lines(docs: DataFrame, least: int = 20, least_docs: int = 3, batches: int = 3,
                fan: int = 2) -> DataFrame:
    """doc_id, text, n_lines, n_dropped: lines found in ``least_docs`` documents stay in the last one only.

    A line's key leaves out ASCII blanks at both ends and the case of A-Z; keys
    shorter than ``least`` code points never repeat.  The last document is the one
    with the largest doc_id.  Lines end at a line feed; a null or empty text is one
    empty line.  Rows that repeat a doc_id are one document for the counts, each with
    its own text in the result.  Rows without a doc_id are one document before all others,
    and lose no line.  Other columns are ignored; an empty table gives no rows.
    """
    return _deduped(docs, least, least_docs, batches, fan).drop("rest")


def without_repeated_lines(docs: DataFrame, least: int = 20, least_docs: int = 3, batches: int = 3,
                           fan: int = 2) -> DataFrame:
    """The rows of ``docs`` with texts as in :func:`dedup_lines`; n_chars, if there, is counted anew.

    A null text becomes an empty one.
    """
    found = _deduped(docs, least, least_docs, batches, fan)
    kinds = dict(docs.dtypes)

    def column(name: str) -> Column:
        if name == "text" or name == "doc_id":
            return F.col(name)
        if name == "n_chars":
            return F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(
                F.col("rest.n_chars")).cast(kinds[name]).alias(name)
        return F.col(f"rest.`{name}`").alias(name)

    return found.select(*[column(c) for c in docs.columns])


def op7_line_dedup(spark, folder: str) -> DataFrame:
    kept = dedup_lines(spark.read.parquet(f"{folder}/documents.parquet"))
    return kept.select("doc_id", "n_lines", "n_dropped",
                       F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP7_SQL = r"""
with lines as (
    select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
           unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos
    from documents),
keyed as (
    select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from lines),
repeated as (
    select k, max(doc_id) as last_doc from keyed where length(k) >= 20
    group by k having count(distinct doc_id) >= 3)
select doc_id, count(*) as n_lines,
       count(*) filter (where last_doc is not null and last_doc <> doc_id) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos)
           filter (where last_doc is null or last_doc = doc_id), '')) as kept_sha256
from keyed left join repeated using (k) group by doc_id
"""
