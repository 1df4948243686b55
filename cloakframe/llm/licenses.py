"""Known licence texts, looked up by the digest of their canonical form.

A text is made canonical: lower case, copyright lines out, equivalent spellings made
one, everything but letters and digits one blank.  What is compared is always an
entire text: a whole document, or one of its lines, which is how short notices stand
in documents.  Both are hash-joined with the digests of the known texts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from cloakframe.llm.tables import keyed_texts, stored
from cloakframe.operators.spread import spread_join

# Spellings that count as the same word, and the wording of licences.
EQUIVALENT = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"),
    ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("organisation", "organization"),
    ("authorised", "authorized"), ("judgement", "judgment"), ("merchantibility", "merchantability"),
    ("http", "https"), ("v2", "version 2"), ("v3", "version 3"),
)
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE
USE OR PERFORMANCE OF THIS SOFTWARE."""
KNOWN = (
    ("MIT", "MIT License\n\n" + _MIT), ("MIT", _MIT), ("ISC", "ISC License\n\n" + _ISC), ("ISC", _ISC),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"), ("ISC", "SPDX-License-Identifier: ISC"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC0-1.0", "Licensed under CC0 1.0."),
)
# A line that states a copyright and nothing else.
_COPYRIGHT = r"(?m)^[ \t]*(?:copyright\b|\(c\)|©)[^\n]*$"
_OTHER = r"[^\p{L}\p{N}]+"


def canonical(text: str) -> str:
    """SQL text of the canonical form of the SQL text ``text``."""
    out = f"regexp_replace(lower({text}), r'{_COPYRIGHT}', ' ')"
    out = f"concat(' ', regexp_replace({out}, r'{_OTHER}', '  '), ' ')"
    for one, other in EQUIVALENT:
        out = f"replace({out}, ' {one} ', ' {other} ')"
    return f"trim(regexp_replace({out}, ' +', ' '))"


def known_digests(spark: SparkSession, known: Sequence[tuple[str, str]] = KNOWN) -> DataFrame:
    """digest, license: one row per canonical text; the first name of a text counts."""
    rows = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(known)],
                                 "at int, license string, text string")
    return rows.select("at", "license", F.expr(f"sha2({canonical('text')}, 256)").alias("digest")).groupBy(
        "digest").agg(F.min_by("license", "at").alias("license"))


def find_licenses(docs: DataFrame, known: DataFrame | None = None, least: int = 8) -> DataFrame:
    """doc_id, text_digest, license, n_notices, notices: one row per row of ``docs``.

    ``text_digest`` is the sha256 of the whole canonical text, ``license`` that of a known text
    equal to it (null: none), ``notices`` the lines (numbered from 1) that are known
    texts, as line:license, comma-joined in order.  Lines below ``least`` characters are
    not looked up.  A null text is an empty one, and an empty canonical text is no known one; repeated rows are
    reported each, as are rows without a doc_id.  ``known`` has one row per digest (hex).  Other
    columns are ignored; an empty table gives no rows.
    """
    known = known if known is not None else known_digests(docs.sparkSession)
    known = stored(known.filter(F.col("digest") != F.sha2(F.lit("").cast("binary"), 256)).select(
        F.unhex("digest").alias("digest"), "license"), "licenses")
    lines = (f"filter(transform(split(text, '\n', -1), (line, i) -> named_struct('line', i + 1, 'digest', "
             f"if(length(line) < {int(least)}, null, unhex(sha2({canonical('line')}, 256))))), "
             "x -> x.digest is not null)")
    digests = stored(keyed_texts(docs).select(
        "doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("blob"),
        F.expr(f"unhex(sha2({canonical('text')}, 256))").alias("digest"), F.expr(lines).alias("lines")), "digests")
    hits = spread_join(digests.select("doc_id", "blob", F.inline("lines")), known, ["digest"], "inner")
    notices = hits.groupBy(F.col("doc_id").alias("id"), "blob").agg(
        F.sort_array(F.collect_set(F.struct("line", "license"))).alias("found"))
    whole = spread_join(digests.drop("lines"), known, ["digest"], "left")
    joined = whole.alias("a").join(notices.alias("b"), F.expr("a.blob = b.blob and a.doc_id <=> b.id"), "left")
    return joined.select(
        "doc_id", F.lower(F.hex("digest")).alias("text_digest"), "license",
        F.greatest(F.size(F.coalesce("found", F.expr("cast(array() as array<struct<line int, license string>>)"))),
                   F.lit(0)).cast("long").alias("n_notices"),
        F.expr("coalesce(array_join(transform(found, x -> concat_ws(':', cast(x.line as string), x.license)), "
               "','), '')").alias("notices"))


def op9_licenses(spark, folder: str) -> DataFrame:
    return find_licenses(spark.read.parquet(f"{folder}/documents.parquet"))


def _canonical_sql(text: str) -> str:
    out = f"regexp_replace(lower({text}), '{_COPYRIGHT}', ' ', 'g')"
    out = f"' ' || regexp_replace({out}, '{_OTHER}', '  ', 'g') || ' '"
    for one, other in EQUIVALENT:
        out = f"replace({out}, ' {one} ', ' {other} ')"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


OP9_SQL = f"""
with known as (
    select sha256({_canonical_sql('t')}) as digest, arg_min(license, pos) as license
    from (values {', '.join(f"({i}, {_quoted(n)}, {_quoted(t)})" for i, (n, t) in enumerate(KNOWN))}) v(pos, license, t)
    group by 1),
d as (select doc_id, coalesce(text, '') as text from documents),
lines as (select doc_id, unnest(string_split(text, chr(10))) as line,
                 unnest(range(1, len(string_split(text, chr(10))) + 1)) as pos from d),
notices as (
    select doc_id, count(*) as n, string_agg(pos::varchar || ':' || license, ',' order by pos) as notices
    from lines join known on digest = sha256({_canonical_sql('line')}) where length(line) >= 8 group by doc_id)
select d.doc_id, sha256({_canonical_sql('text')}) as text_digest, license, coalesce(n, 0) as n_notices,
       coalesce(notices, '') as notices
from d left join known on digest = sha256({_canonical_sql('text')}) left join notices using (doc_id)
"""
