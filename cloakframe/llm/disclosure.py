"""Personal data, and the terms that give it away.

Four kinds of values are found by expression and check.  Each value is a protected entity.
The words around its mentions are weighed by what the whole collection says of
them: pointwise mutual information of entity and word, over the number of documents
each is in, against the information content of the entity.  A word that carries
more than a given part of the entity's information, with support from several different
texts, discloses it: near the mention it becomes a span of its own, generalised or removed in
sanitised texts.

Built-in expressions only.  Values, words and texts stand in intermediate tables as hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cloakframe.functions import matching
from cloakframe.llm.tables import keyed_texts, only_ids, stored
from cloakframe.operators.spread import spread_join

#: In the order that sorts spans with the same start; "term" marks disclosing words.
KINDS = ("email", "ip", "card", "phone", "term")
# A match can begin where the last one ended (\G), or at the start of a run: no other start can match.
_LOCAL, _HOST = "A-Za-z0-9._%+-", "[A-Za-z0-9-]++"
_EXPRESSIONS = (
    rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@{_HOST}(?:\.{_HOST})++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
# What any finding of a kind holds.
_HINTS = (
    "contains(text, '@')",
    r"text rlike r'[0-9]\.[0-9]++\.[0-9]++\.[0-9]'",
    r"text rlike r'[0-9](?:[\x20-]?[0-9]){13}'",
    r"text rlike r'\\+[0-9]'".replace("\\\\", "\\"),
)
_DIGITS = "regexp_replace(hit, '[^0-9]', '')"
_CHECKS = (
    "true",
    "forall(split(hit, '[.]'), p -> p rlike '^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$')",
    f"length({_DIGITS}) between 14 and 19 and luhn_check({_DIGITS})",
    f"length({_DIGITS}) between 10 and 15",
)
_WORD = r"\p{L}{2,}"
_REACH = 100


def _kind_spans(kind: int) -> str:
    """SQL text: start, kind, end, entity of the findings of one kind in the column ``text``."""
    regex = _EXPRESSIONS[kind]
    structs = (
        f"zip_with(h, {matching.starts('h', 'g')}, (hit, at) -> if({_CHECKS[kind]}, named_struct("
        f"'start', cast(at - 1 as long), 'kind', {kind}, 'end', cast(at - 1 + length(hit) as long), "
        f"'entity', xxhash64(lower(hit), {kind})), null))"
    )
    found = matching.let(matching.hits("text", regex), "h",
                         f"if(size(h) = 0, cast(array() as {_SPANS}), "
                         f"{matching.let(matching.gaps('text', regex), 'g', structs)})")
    return f"if({_HINTS[kind]}, filter({found}, s -> s is not null), cast(array() as {_SPANS}))"


_SPANS = "array<struct<start: bigint, kind: int, end: bigint, entity: bigint>>"


def mentions(docs: DataFrame) -> DataFrame:
    """doc_id, text, version (hash of the text) and ``found``: the spans of all four kinds in order."""
    every = ", ".join(_kind_spans(k) for k in range(4))
    return keyed_texts(docs).select(
        "doc_id", "text", F.xxhash64("text").alias("version"),
        F.expr(f"array_sort(concat({every}))").alias("found"))


def _nearby(found: DataFrame, window: int) -> DataFrame:
    """doc_id, version, entity, term (hash), start, end: the words around each mention."""
    around = found.filter("size(found) > 0").withColumn("n", F.length("text")).select(
        "doc_id", "version", F.expr(f"""inline(transform(found, s -> named_struct(
            'entity', s.entity, 'lefts', greatest(s.start - {_REACH}, 0L), 'rights', s.end,
            'lefttext', substring(text, int(greatest(s.start - {_REACH}, 0L) + 1), int(least(s.start, {_REACH}L))),
            'righttext', substring(text, int(s.end + 1), {_REACH}), 'whole', s.end + {_REACH} >= n,
            'taken', filter(transform(found, o -> named_struct('start', o.start, 'end', o.end)),
                            o -> o.end > s.start - {_REACH} and o.start < s.end + {_REACH}))))"""))
    for side in ("left", "right"):
        around = around.withColumn(f"{side}hits", F.expr(matching.hits(f"{side}text", _WORD))).withColumn(
            f"{side}gaps", F.expr(matching.gaps(f"{side}text", _WORD)))

    def words(side: str, cut: str, few: str) -> str:
        placed = (
            f"zip_with({side}hits, {matching.starts(f'{side}hits', f'{side}gaps')}, (w, at) -> named_struct("
            f"'term', xxhash64(lower(w)), 'start', {side}s + at - 1, 'end', {side}s + at - 1 + length(w)))")
        return few.format(f"filter({placed}, w -> not ({cut}))")

    left = words("left", "w.start = lefts and lefts > 0", f"reverse(slice(reverse({{}}), 1, {window}))")
    right = words("right", f"w.end = rights + {_REACH} and not whole", f"slice({{}}, 1, {window})")
    near = around.select("doc_id", "version", "entity", F.expr(
        f"filter(concat({left}, {right}), w -> not exists(taken, o -> o.end > w.start and o.start < w.end))"
    ).alias("words"))
    return near.select("doc_id", "version", "entity", F.inline("words")).distinct()


def disclosing(docs: DataFrame, near: DataFrame, least_texts: int = 2, part: float = 0.9) -> DataFrame:
    """entity, term: words that disclose an entity.

    Counts are documents of the whole collection.  A pair needs ``least_texts``
    documents and two different texts, and at least ``part`` of the entity's information.
    """
    pairs = near.groupBy("entity", "term", "doc_id", "version").agg(F.lit(1).alias("one"))
    together = stored(pairs.groupBy("entity", "term").agg(
        F.count("*").alias("both"), F.min("version").alias("a"), F.max("version").alias("b")
    ).filter((F.col("both") >= least_texts) & (F.col("a") != F.col("b"))).select("entity", "term", "both"), "pairs")
    entities = near.groupBy("entity", "doc_id", "version").agg(F.lit(1).alias("one")).groupBy("entity").agg(
        F.count("*").alias("n_entity"))
    wanted = stored(together.select("term").distinct(), "terms")
    words = docs.select(F.explode(F.array_distinct(F.expr(
        f"transform({matching.hits('lower(text)', _WORD)}, w -> xxhash64(w))"))).alias("term"))
    frequencies = only_ids(words, wanted, "term").groupBy("term").agg(F.count("*").alias("n_term"))
    total = docs.count()
    weighed = together.join(entities, "entity").join(frequencies, "term")
    information = F.log2(F.lit(float(max(total, 1))) / F.col("n_entity"))
    mutual = information + F.log2(F.col("both") / F.greatest("n_term", "both"))
    return weighed.filter((information > 0) & (mutual >= part * information)).select("entity", "term")


def find_personal_data(docs: DataFrame, window: int = 5, least_texts: int = 2,
                       part: float = 0.9) -> DataFrame:
    """doc_id, version, found, terms: spans of values, and of disclosing words near them.

    One row per row of ``docs``.  A null text is an empty one.  Repeated rows get the same spans
    and count each as a document; rows without a doc_id count as one document per
    different text.  Other columns are ignored; an empty table gives no rows.
    """
    spans = mentions(docs)
    found = stored(spans.drop("text"), "mentions")
    near = stored(_nearby(spans, window), "nearby")
    telling = stored(disclosing(keyed_texts(docs), near, least_texts, part), "disclosing")
    terms = spread_join(near, telling, ["entity", "term"], "inner").groupBy(
        F.col("doc_id").alias("id"), F.col("version").alias("of")).agg(
        F.sort_array(F.collect_set(F.struct("start", F.lit(4).alias("kind"), "end"))).alias("terms"))
    return found.join(terms, F.expr("version = of and doc_id <=> id"), "left").select(
        "doc_id", "version", "found", "terms")


def _all_spans() -> Column:
    own = "transform(found, s -> named_struct('start', s.start, 'kind', s.kind, 'end', s.end))"
    return F.expr(f"if(terms is null, {own}, array_sort(concat({own}, terms)))")


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """doc_id and text: values become their kind in brackets, disclosing names (capital
    first letter) become [NAME], other disclosing words are removed."""
    spans = find_personal_data(docs, **options).select(
        F.col("doc_id").alias("id"), "version", _all_spans().alias("spans")).distinct()
    joined = keyed_texts(docs).withColumn("version_", F.xxhash64("text")).join(
        spans, F.expr("version_ = version and doc_id <=> id"), "left")
    label = ("case when s.kind < 4 then concat('[', upper(array('email', 'ip', 'card', 'phone')[s.kind]), ']') "
             r"when substring(text, int(s.start + 1), 1) rlike '\\p{Lu}' then '[NAME]' else '' end")
    cut = f"""aggregate(spans, named_struct('out', '', 'at', 0L), (a, s) -> named_struct(
        'out', concat(a.out, if(s.start > a.at, substring(text, int(a.at + 1), int(s.start - a.at)), ''),
                      if(s.start >= a.at, {label}, '')), 'at', greatest(a.at, s.end)),
        a -> concat(a.out, substring(text, int(a.at + 1))))"""
    return joined.select("doc_id", F.when(F.size("spans") > 0, F.expr(cut)).otherwise(F.col("text")).alias("text"))


def _joined(spans: str) -> Column:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, s -> concat_ws(':', {names}[s.kind], "
                  "cast(s.start as string), cast(s.end as string))), ',')")


def op5_personal_data(spark, folder: str) -> DataFrame:
    found = find_personal_data(spark.read.parquet(f"{folder}/documents.parquet")).withColumn("spans", _all_spans())
    counts = [F.expr(f"size(filter(found, s -> s.kind = {i}))").cast("long").alias(f"n_{k}")
              for i, k in enumerate(KINDS[:4])]
    return found.select("doc_id", *counts, F.sha2(_joined("found").cast("binary"), 256).alias("base_sha256"),
                        _joined("spans").alias("spans"))
