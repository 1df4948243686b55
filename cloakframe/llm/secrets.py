"""Secrets in versions of texts, with a ledger of contents that were scanned before.

Every version is known by the sha256 of its content (its blob).  The ledger is a folder with two
tables: which blob was scanned with which version of the rules, and the findings of each.
A scan looks only at pairs of blob and rule version that the ledger lacks, each
blob once however often it occurs, then adds them, and joins the findings of all
blobs back to all paths that hold them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from cloakframe.llm.tables import keyed_texts
from cloakframe.operators.spread import spread_join
from cloakframe.sources.scratch import scratch_folder

_FINDINGS = "blob binary, rules string, spans array<struct<kind int, start long, end long>>"


@dataclass(frozen=True)
class Rule:
    """``group`` of at least ``least`` characters makes a match of ``pattern`` a finding.

    ``hints``: one of these occurs in the lower-cased text of every match; none: a run
    of hexadecimal digits is looked for instead.
    """

    kind: str
    pattern: str
    group: int
    least: int
    hints: tuple[str, ...]


#: In the order that sorts findings with the same start.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         2, 6, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, ("akia",)),
    Rule("hex", r"[0-9a-f]+", 0, 24, ()),
)
_HEX = bytes(1 if chr(i) in "0123456789abcdef" else 0 for i in range(256))


def rules_version(rules: tuple[Rule, ...]) -> str:
    return hashlib.sha256(f"ASCII letters {rules!r}".encode()).hexdigest()[:16]


def find(text: str, rules: tuple[Rule, ...], compiled: list) -> list[tuple[int, int, int]]:
    """(kind number, start, end) in order of start, then kind; ends are exclusive, in code points."""
    out = []
    lower = text.lower()
    digits = None
    for kind, (rule, expression) in enumerate(zip(rules, compiled)):
        if rule.hints:
            if not any(h in lower for h in rule.hints):
                continue
        else:
            if digits is None:
                digits = text.encode("utf-8", "surrogatepass").translate(_HEX)
            if b"\x01" * rule.least not in digits:
                continue
        for m in expression.finditer(text):
            if len(m[rule.group]) >= rule.least:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda x: (x[1], x[0]))


def _scan(rules: tuple[Rule, ...]):
    version = rules_version(rules)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = [regex.compile(rule.pattern, regex.ASCII) for rule in rules]  # no folding beyond A-Z
        for batch in batches:
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in find(t, rules, compiled)]
                     for t in batch["text"]]
            yield pd.DataFrame({"blob": batch["blob"], "rules": version, "spans": spans})

    return run


class BlobLedger:
    """Scanned blobs and their findings, in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str | None = None, rules: tuple[Rule, ...] = RULES):
        self.spark, self.rules = spark, rules
        self.folder = folder or scratch_folder(spark, "ledger")
        self.version = rules_version(rules)
        spark.createDataFrame([], _FINDINGS).write.mode("append").parquet(self.folder)

    def findings(self) -> DataFrame:
        """blob, rules, spans of all scans so far; blobs without findings have no spans."""
        return self.spark.read.schema(_FINDINGS).parquet(self.folder)

    def seen(self) -> DataFrame:
        return self.findings().filter(F.col("rules") == self.version).select("blob")

    def scan(self, docs: DataFrame) -> DataFrame:
        """doc_id and spans, one row per row of ``docs`` (doc_id, text); the ledger grows by what is new."""
        paths = keyed_texts(docs).withColumn("blob", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
        first = paths.groupBy("blob").agg(F.min(F.coalesce("doc_id", F.lit(-2**63))).alias("path"))
        new = first.join(self.seen(), "blob", "left_anti")
        texts = paths.withColumn("path", F.coalesce("doc_id", F.lit(-2**63))).join(new, ["blob", "path"], "left_semi")
        scanned = texts.select("blob", "text").mapInPandas(_scan(self.rules), _FINDINGS)
        # Rows that repeat a path bring the same blob more than once: one entry stays.
        scanned.dropDuplicates(["blob"]).write.mode("append").parquet(self.folder)
        known = self.findings().filter(F.col("rules") == self.version).select("blob", "spans")
        # A broken-off write may have left a blob twice; a hit list is the same each time.
        found = known.filter("size(spans) > 0").dropDuplicates(["blob"])
        return spread_join(paths.select("doc_id", "blob"), found, ["blob"], "left").select("doc_id", "spans")


def joined(spans: str, kinds: tuple[str, ...]) -> F.Column:
    """kind:start:end of each span, comma-joined; empty for none."""
    names = "array(" + ", ".join(f"'{k}'" for k in kinds) + ")"
    return F.expr(f"coalesce(array_join(transform({spans}, s -> concat_ws(':', "
                  f"{names}[s.kind], cast(s.start as string), cast(s.end as string))), ','), '')")


def scan_secrets(docs: DataFrame, ledger: BlobLedger | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: one row per row of ``docs``.

    ``spans`` are kind:start:end by start, then kind, in code points, comma-joined.  A
    null text is an empty one and has none; repeated rows are scanned once and
    reported each; a row without a doc_id is reported with null.  Other
    columns are ignored, an empty table gives no rows.
    """
    ledger = ledger or BlobLedger(docs.sparkSession)
    kinds = tuple(rule.kind for rule in ledger.rules)
    counts = {f"n_{kind}": F.coalesce(F.expr(f"size(filter(spans, s -> s.kind = {i}))"), F.lit(0)).cast("long")
              for i, kind in enumerate(kinds)}
    found = ledger.scan(docs)
    counts = {name: F.when(F.col("spans").isNull(), F.lit(0).cast("long")).otherwise(c) for name, c in counts.items()}
    text = joined("spans", kinds)
    return found.select("doc_id", *[c.alias(n) for n, c in counts.items()],
                        F.sha2(text.cast("binary"), 256).alias("base_sha256"), text.alias("spans"))


def op1_secrets(spark, folder: str) -> DataFrame:
    return scan_secrets(spark.read.parquet(f"{folder}/documents.parquet"))
