"""Every operator as a named query over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cloakframe.functions import fixed_values as fixed, formatting, masks, strength, validators
from cloakframe.functions.digests import digest
from cloakframe.functions.patterns import DETECTORS, SECRETS
from cloakframe.functions.pseudonyms import GENERATORS, pseudonym, seed
from cloakframe.functions.sqlfuncs import register_sql_functions
from cloakframe.operators import (
    anonymize as anon, codes, crypto, detect, fingerprint as prints, properties as props,
    frames, redact as red, sanitize as san, term_table, unique_fakes as unique,
)
from cloakframe.plans import inputs, jobs, oracle
from cloakframe.sources import files, ranges, tables
from cloakframe.sources.scratch import scratch_folder
from cloakframe.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# Tables of texts or log lines, where most of the work is per row.
_TEXTS = ("documents", "pages", "conversations", "events")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return tables.read_table(spark, sf, name, spread=name in _TEXTS)


def derive(spark: SparkSession, sf: str, sql: str, *names: str) -> DataFrame:
    for name in names:
        table(spark, sf, name).createOrReplaceTempView(name)
    return spark.sql(sql)


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


def texts(spark: SparkSession, sf: str) -> DataFrame:
    return derive(spark, sf, inputs.TEXTS, "documents", "pages")


def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    return derive(spark, sf, inputs.LOG_LINES, "events")


def people(spark: SparkSession, sf: str) -> DataFrame:
    return derive(spark, sf, inputs.PEOPLE, "customer")


def properties(spark: SparkSession, sf: str) -> DataFrame:
    rows = derive(spark, sf, inputs.PROPERTIES, "documents")
    return rows.withColumn("file_type", formatting.file_type(F.col("path")))


# --- text to rows ------------------------------------------------------------


@query
def explode_lines(spark, sf):
    return detect.explode_lines(documents(spark, sf), "text")


@query
def non_blank_lines(spark, sf):
    lines = detect.explode_lines(documents(spark, sf), "text")
    return lines.filter(validators.is_present(F.col("line"))).groupBy("doc_id").agg(
        F.count("*").alias("n_lines")
    )


# --- detection ---------------------------------------------------------------


@query
def scan_documents(spark, sf):
    return detect.scan_text(documents(spark, sf), "text")


@query
def scan_counts(spark, sf):
    return detect.count_by_type(detect.scan_text(texts(spark, sf), "text"))


@query
def scan_selected_types(spark, sf):
    return detect.scan_text(texts(spark, sf), "text", "email,ip_address")


@query
def scan_ssn(spark, sf):
    lines = derive(spark, sf, inputs.SSN_LINES, "customer")
    return detect.scan_text(lines, "text", ["ssn"])


def _scan_one(kind: str) -> Query:
    return lambda spark, sf: detect.scan_text(texts(spark, sf), "text", [kind])


for _kind in ("credit_card", "email", "phone", "ip_address"):
    QUERIES[f"scan_{_kind}"] = _scan_one(_kind)


@query
def scan_masked(spark, sf):
    found = detect.scan_text(texts(spark, sf), "text")
    return detect.with_masks(found).select("id", "type", "line", "column", "value_masked")


@query
def scan_masked_context(spark, sf):
    return detect.without_raw_values(detect.scan_text(texts(spark, sf), "text"))


@query
def scan_report(spark, sf):
    return detect.findings_report(detect.scan_text(texts(spark, sf), "text"), "id")


@query
def scan_file_counts(spark, sf):
    return detect.findings_counts(detect.scan_text(texts(spark, sf), "text"), "id")


@query
def scan_summary(spark, sf):
    summary = detect.scan_summary(texts(spark, sf), "text")
    return summary.select(
        "rows_scanned", "rows_with_hits", "total_findings",
        *[F.coalesce(F.try_element_at("types_found", F.lit(p.name)), F.lit(0).cast("bigint"))
          .alias(f"n_{p.name.lower()}") for p in DETECTORS],
    )


@query
def scan_by_label(spark, sf):
    found = detect.scan_text(documents(spark, sf), "text", keep=["doc_id"])
    per_doc = found.groupBy("doc_id", "type").agg(F.count("*").alias("n"))
    return per_doc.join(table(spark, sf, "labels"), "doc_id").groupBy("type", "toxic").agg(
        F.sum("n").alias("n")
    )


@query
def valid_cards(spark, sf):
    cards = derive(spark, sf, inputs.CARDS, "orders")
    return cards.select(
        "o_orderkey", validators.is_card(F.col("card")).alias("valid"),
        masks.mask_card(F.col("card")).alias("masked"),
    )


@query
def valid_ssns(spark, sf):
    rows = derive(spark, sf, inputs.SSNS, "orders")
    return rows.select(
        "o_orderkey", validators.is_ssn(F.col("ssn")).alias("valid"),
        masks.mask_ssn(F.col("ssn")).alias("masked"),
    )


@query
def valid_phones(spark, sf):
    rows = derive(spark, sf, inputs.PHONES, "orders")
    return rows.select(
        "o_orderkey", validators.is_phone(F.col("phone")).alias("valid"),
        masks.mask_phone(F.col("phone")).alias("masked"),
    )


@query
def valid_addresses(spark, sf):
    rows = derive(spark, sf, inputs.ADDRESSES, "lineitem")
    return rows.select(
        "l_orderkey", "l_linenumber", "ip", validators.is_ipv4(F.col("ip")).alias("valid")
    )


@query
def sql_functions(spark, sf):
    register_sql_functions(spark)
    rows = derive(spark, sf, inputs.PEOPLE, "customer")
    rows.createOrReplaceTempView("people_rows")
    return spark.sql(
        "SELECT c_custkey, is_ssn(code) AS ssn_ok, is_phone(line) AS phone_ok, is_ipv4(host) AS "
        "ip_ok, is_card(line) AS card_ok, mask_ssn(code) AS ssn, mask_phone(line) AS phone, "
        "mask_email(contact) AS email, mask_card(line) AS card FROM people_rows"
    )


# --- sanitizing --------------------------------------------------------------


@query
def sanitize_documents(spark, sf):
    return san.sanitize(documents(spark, sf), "text")


@query
def sanitize_all_types(spark, sf):
    return san.sanitize(documents(spark, sf), "text", "all")


@query
def sanitize_logs(spark, sf):
    return san.sanitize(log_lines(spark, sf), "line", "all")


def _sanitize_one(name: str) -> Query:
    return lambda spark, sf: san.sanitize_changed(log_lines(spark, sf), "line", [name])


for _p in SECRETS:
    QUERIES[f"sanitize_{_p.name.lower()}"] = _sanitize_one(_p.name)


@query
def sanitize_preview(spark, sf):
    return san.sanitize_preview(documents(spark, sf), "text", ["doc_id"], "all")


@query
def sanitize_log_preview(spark, sf):
    return san.sanitize_preview(log_lines(spark, sf), "line", ["event_id"], "all")


def _flat_stats(stats: DataFrame) -> DataFrame:
    return stats.select(
        "total_lines", "lines_modified", "total_replacements",
        *[F.coalesce(F.try_element_at("type_counts", F.lit(p.name)), F.lit(0).cast("bigint"))
          .alias(f"n_{p.name.lower()}") for p in SECRETS],
    )


@query
def sanitize_stats(spark, sf):
    return _flat_stats(san.sanitize_stats(documents(spark, sf), "text", "all"))


@query
def sanitize_log_stats(spark, sf):
    return _flat_stats(san.sanitize_stats(log_lines(spark, sf), "line", "all"))


@query
def sanitize_noted(spark, sf):
    noted = san.sanitize_noted(log_lines(spark, sf), "line")
    return noted.select("event_id", "line", F.size("replacements").alias("n"))


@query
def sanitize_changed(spark, sf):
    path = scratch_folder(spark, "sanitized")
    tables.write_sanitized(documents(spark, sf), "text", path, "all")
    return spark.read.parquet(path)


@query
def sanitize_stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    # The braces make it a pattern: a stream takes a single file by pattern only, a folder of files either way.
    stream = streams.table_stream(spark, f"{sf}/{{documents.parquet}}", schema, "*").select("doc_id", "text")
    stream = stream.repartition(spark.sparkContext.defaultParallelism)  # one small file
    path = scratch_folder(spark, "stream")
    streams.run_available(
        streams.sanitize_stream(stream, "text", "all"), path, path + "-checkpoint"
    )
    return spark.read.schema(stream.schema).parquet(path)


@query
def placeholders(spark, sf):
    return table(spark, sf, "supplier").select(
        "s_suppkey", san.placeholder(F.col("s_name"), "NAME").alias("placeholder")
    )


# --- anonymizing -------------------------------------------------------------


@query
def type_by_name(spark, sf):
    words = documents(spark, sf).select(
        F.explode(F.split(F.lower("text"), "[ .,\n]+")).alias("word")
    )
    return words.distinct().select("word", anon.type_by_name(F.col("word")).alias("pii_type"))


@query
def type_by_content(spark, sf):
    long = people(spark, sf).unpivot(
        ["c_custkey"], list(oracle.PEOPLE_COLUMNS), "column", "value"
    )
    return anon.types_by_content(long, "column", "value", ["c_custkey"])


@query
def column_plan(spark, sf):
    rows = people(spark, sf)
    plan = anon.infer_column_plan(rows, order_by=["c_custkey"])
    sums = [F.count(c).alias(f"{c}_as_{kind}") for c, kind in sorted(plan.items())]
    return rows.agg(*sums)


def _fake_of(kind: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = people(spark, sf)
        return rows.select(
            "c_custkey", pseudonym("c_name", kind).alias("fake"),
            pseudonym("town", kind).alias("fake_town"),
        )

    return run


for _kind in GENERATORS:
    QUERIES[f"fake_{_kind}"] = _fake_of(_kind)


@query
def pseudonym_seeds(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", seed("c_name").alias("seed"))


@query
def anonymize_people(spark, sf):
    return anon.anonymize(people(spark, sf), oracle.PEOPLE_PLAN)


@query
def anonymize_planned(spark, sf):
    plan = anon.parse_column_plan("c_name, label:company, town:city", people(spark, sf).columns)
    return anon.anonymize(people(spark, sf), plan).select("c_custkey", "c_name", "label", "town")


@query
def anonymize_inferred(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand")
    return anon.anonymize(part)


_UNIQUE_PLAN = {"c_name": "name", "contact": "email", "code": "ssn", "line": "phone", "host": "ip_address"}


@query
def unique_fakes(spark, sf):
    """Per column: values, different ones, their fakes, and whether equal means equal both ways."""
    rows = people(spark, sf)
    made = unique.anonymize_uniquely(rows, _UNIQUE_PLAN, "only for tests")
    both = rows.join(made.select("c_custkey", *[F.col(c).alias(f"new_{c}") for c in _UNIQUE_PLAN]), "c_custkey")
    pairs = both.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("old"), F.col(f"new_{c}").alias("new")) for c in _UNIQUE_PLAN])))
    per_old = pairs.groupBy("column", "old").agg(F.count("*").alias("n"), F.min("new").alias("new"), F.max("new").alias("high"))
    return per_old.groupBy("column").agg(
        F.sum("n").alias("n_values"), F.count("*").alias("n_different"), F.countDistinct("new").alias("n_fakes"),
        F.bool_and(F.col("new") == F.col("high")).alias("consistent"),
        F.count_if(F.col("new") == F.col("old")).alias("n_unchanged"))


@query
def anonymize_preview(spark, sf):
    return anon.anonymize_preview(people(spark, sf), oracle.PEOPLE_PLAN, ["c_custkey"])


@query
def anonymize_stats(spark, sf):
    return anon.anonymize_stats(people(spark, sf), oracle.PEOPLE_PLAN)


# --- redacting ---------------------------------------------------------------


@query
def redact_terms(spark, sf):
    return red.redact(documents(spark, sf), "text", oracle.REDACT_TERMS)


@query
def redact_patterns(spark, sf):
    return red.redact(documents(spark, sf), "text", patterns=oracle.REDACT_PATTERNS, fill="")


@query
def redact_pages(spark, sf):
    talks = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return red.redact(
        talks, "text", oracle.REDACT_TERMS, oracle.REDACT_PATTERNS, "turn", oracle.PAGES
    )


@query
def redact_lines(spark, sf):
    return red.redact(
        documents(spark, sf), "text", patterns=oracle.REDACT_PATTERNS, granularity="line"
    )


@query
def redact_term_table(spark, sf):
    terms = derive(spark, sf, inputs.TERMS, "benchmark")
    return term_table.redact_by_table(documents(spark, sf), ["doc_id"], "text", terms, "term")


@query
def term_hits(spark, sf):
    terms = derive(spark, sf, inputs.TERMS, "benchmark")
    found = term_table.find_terms(documents(spark, sf), ["doc_id"], "text", terms, "term")
    return found.groupBy("found").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"),
                                      F.sum("start").alias("starts"))


@query
def redact_preview(spark, sf):
    talks = table(spark, sf, "conversations")
    return red.redact_preview(
        talks, "text", oracle.REDACT_TERMS, oracle.REDACT_PATTERNS, "turn", oracle.PAGES,
        keep=["conv_id", "turn"],
    )


@query
def redact_stats(spark, sf):
    return red.redact_stats(
        table(spark, sf, "conversations"), "text", oracle.REDACT_TERMS, oracle.REDACT_PATTERNS,
        "turn", oracle.PAGES,
    )


@query
def page_filter(spark, sf):
    talks = table(spark, sf, "conversations")
    return talks.filter(red.page_filter(F.col("turn"), oracle.PAGES)).select("conv_id", "turn")


# --- fingerprints ------------------------------------------------------------


@query
def digests(spark, sf):
    text = F.col("text")
    return documents(spark, sf).select(
        "doc_id", digest(text).alias("sha256"), digest(text, "sha1").alias("sha1"),
        digest(text, "md5").alias("md5"),
        F.length(digest(text, "sha512")).cast("bigint").alias("sha512_length"),
    )


@query
def digest_rows(spark, sf):
    return prints.fingerprint(documents(spark, sf), ["doc_id"], "text", "sha1")


@query
def verify_digests(spark, sf):
    sql = inputs.EXPECTED.replace("{sha256}", "sha2(text, 256)")
    expected = derive(spark, sf, sql, "documents")
    return prints.verify(documents(spark, sf), ["doc_id"], "text", expected)


@query
def compare_texts(spark, sf):
    left = derive(spark, sf, inputs.LEFT_TEXTS, "documents")
    right = derive(spark, sf, inputs.RIGHT_TEXTS, "documents")
    return prints.compare(left, right, ["doc_id"], "text")


@query
def identical_groups(spark, sf):
    return prints.identical_groups(documents(spark, sf), "doc_id", "text")


@query
def identical_members(spark, sf):
    return prints.identical_members(documents(spark, sf), "doc_id", "text")


@query
def manifest(spark, sf):
    named = derive(spark, sf, inputs.FILE_NAMES.replace("SELECT doc_id,", "SELECT doc_id, text,", 1), "documents")
    return prints.manifest_rows(named, "path", "text")


@query
def manifest_round_trip(spark, sf):
    path = scratch_folder(spark, "manifest")
    tables.write_manifest(manifest(spark, sf), path, "sha256", "documents")
    return tables.read_manifest(spark, path)


@query
def format_sizes(spark, sf):
    wide = F.col("o_orderkey").cast("decimal(20,0)")  # the product of large keys passes 64 bits
    sizes = table(spark, sf, "orders").select("o_orderkey", (wide * wide * F.col("o_custkey") * 64).alias("size"))
    return sizes.select("o_orderkey", formatting.format_size("size").alias("size_text"))


@query
def inventory_summary(spark, sf):
    sizes = table(spark, sf, "documents").select(F.octet_length("text").alias("length"))
    return prints.inventory_summary(sizes)


# --- properties --------------------------------------------------------------


@query
def file_types(spark, sf):
    names = derive(spark, sf, inputs.FILE_NAMES, "documents")
    return names.select("doc_id", "path", formatting.file_type(F.col("path")).alias("file_type"))


@query
def page_types(spark, sf):
    pages = table(spark, sf, "pages")
    return pages.groupBy(formatting.file_type(F.col("url")).alias("file_type")).agg(
        F.count("*").alias("n")
    )


@query
def scannable_names(spark, sf):
    names = derive(spark, sf, inputs.FILE_NAMES, "documents")
    return names.filter(files.has_extension(F.col("path"), fixed.SCANNABLE_EXTENSIONS))


@query
def property_risk(spark, sf):
    return props.with_risk(properties(spark, sf)).select("path", "scope", "key", "risk")


@query
def file_risk(spark, sf):
    return props.file_risk(properties(spark, sf))


@query
def risk_summary(spark, sf):
    return props.risk_summary(properties(spark, sf))


@query
def sensitive_tags(spark, sf):
    return props.sensitive_tag_counts(properties(spark, sf))


@query
def gps_positions(spark, sf):
    rows = derive(spark, sf, inputs.COORDINATES, "orders")
    dms = F.array(*[F.col(c).cast("double") for c in ("d", "m", "s")])
    degrees = formatting.gps_decimal(dms, F.col("ref"))
    return rows.select(
        "o_orderkey", F.round(degrees, 6).alias("degrees"),
        formatting.gps_position(degrees, degrees + 1).isNotNull().alias("has_position"),
    )


@query
def render_values(spark, sf):
    text = F.col("text")
    return documents(spark, sf).select(
        "doc_id", formatting.render_value(text).alias("image"),
        formatting.render_value(text, "office").alias("office"),
        formatting.render_binary(F.encode(F.left(text, F.col("doc_id").cast("int") % 200), "UTF-8"))
        .like("<binary data, %").alias("is_long"),
    )


@query
def present_properties(spark, sf):
    return props.present_properties(properties(spark, sf)).select("path", "key", "value")


@query
def clear_properties(spark, sf):
    return props.clear_properties(properties(spark, sf)).select("path", "scope", "key", "value")


@query
def clear_stats(spark, sf):
    return props.clear_stats(properties(spark, sf))


@query
def clear_summary(spark, sf):
    return props.clear_summary(properties(spark, sf))


@query
def wipe_fields(spark, sf):
    return props.clear_all(properties(spark, sf)).select("path", "scope", "key", "value")


@query
def dirty_files(spark, sf):
    return props.still_dirty(properties(spark, sf))


@query
def wipe_summary(spark, sf):
    return props.wipe_summary(props.clear_all(properties(spark, sf)))


@query
def drop_comments(spark, sf):
    talks = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return props.drop_comments(
        talks, talks.filter("role = 'assistant'"), ["conv_id", "turn"]
    )


@query
def comment_counts(spark, sf):
    talks = table(spark, sf, "conversations").filter("role = 'assistant'")
    return props.comment_counts(talks.withColumnRenamed("conv_id", "path"))


@query
def metadata_objects(spark, sf):
    path = scratch_folder(spark, "metadata")
    tables.write_metadata_json(properties(spark, sf), path)
    objects = spark.read.schema(
        "path string, file_type string, os_metadata map<string,string>, format_metadata "
        "map<string,string>, fields map<string,struct<value:string,risk:string>>"
    ).json(path)
    return objects.select(
        "path", "file_type", F.size("os_metadata").cast("bigint").alias("n_os"),
        F.size("format_metadata").cast("bigint").alias("n_format"),
        F.try_element_at("fields", F.lit("author"))["risk"].alias("author_risk"),
        F.try_element_at("fields", F.lit("title"))["value"].alias("title"),
    )


# --- encryption and codes ----------------------------------------------------

_PASSWORD = "correct horse battery staple"


@query
def encrypt_sizes(spark, sf):
    blobs = crypto.encrypt(documents(spark, sf), "text", _PASSWORD)
    return blobs.select("doc_id", F.octet_length("text").cast("bigint").alias("blob_size"))


@query
def decrypt_round_trip(spark, sf):
    path = scratch_folder(spark, "blobs")
    crypto.encrypt(documents(spark, sf), "text", _PASSWORD, n_salts=4).write.parquet(path)
    plain = crypto.decrypt(spark.read.parquet(path), "text", _PASSWORD)
    return plain.select("doc_id", F.md5("text").alias("digest"))


@query
def decrypt_tampered(spark, sf):
    path = scratch_folder(spark, "blobs")
    crypto.encrypt(documents(spark, sf), "text", _PASSWORD).write.parquet(path)
    blob = F.col("text")
    harmed = (
        F.when(F.col("doc_id") % 3 == 0, F.substring(blob, 1, 40))
        .when(F.col("doc_id") % 3 == 1, F.concat(blob, F.unhex(F.lit("00")))).otherwise(blob)
    )
    rows = spark.read.parquet(path).withColumn("text", harmed)
    plain = crypto.decrypt(rows, "text", _PASSWORD, few_salts=False)
    return crypto.encryption_stats(plain, "text")


@query
def encrypt_tree(spark, sf):
    """Every document a file, encrypted in frames, written, decrypted, restored and hashed."""
    out, back = scratch_folder(spark, "frames"), scratch_folder(spark, "restored")
    frames.encrypt_files(spark, _named_files(spark, sf), _PASSWORD, chunk=1000).write.parquet(out)
    status = frames.restore_files(frames.decrypt_frames(spark.read.parquet(out), _PASSWORD), back)
    return status.join(jobs.manifest(spark, back, True), "rel_path").select(
        "rel_path", "frames", "size", "status", "digest")


@query
def entropy(spark, sf):
    rows = derive(spark, sf, inputs.POLICIES, "part")
    bits = strength.entropy_bits(*[F.col(c) for c in rows.columns if c != "p_partkey"])
    return rows.select(
        "p_partkey", F.round(bits, 6).alias("bits"),
        strength.strength_rating(bits).alias("rating"),
    )


@query
def issue_codes(spark, sf):
    made = codes.issue_codes(table(spark, sf, "customer"), length=20)
    path = scratch_folder(spark, "codes")
    made.select("c_custkey", "code").write.parquet(path)
    code = F.col("code")
    return spark.read.parquet(path).select(
        "c_custkey", F.length(code).alias("length"), code.rlike("[A-Z]").alias("upper"),
        code.rlike("[a-z]").alias("lower"), code.rlike("[0-9]").alias("digit"),
        code.rlike("[^A-Za-z0-9]").alias("symbol"),
    )


@query
def issue_passphrases(spark, sf):
    words = table(spark, sf, "nation").select(F.lower("n_name").alias("word"))
    made = codes.issue_passphrases(
        table(spark, sf, "customer"), words, "word", n=4, separator="/"
    )
    return made.select("c_custkey", F.size(F.split("passphrase", "/")).alias("n_words"))


@query
def issue_pins(spark, sf):
    made = codes.issue_pins(table(spark, sf, "customer"), 8)
    return made.select("c_custkey", F.col("pin").rlike(r"^[0-9]{8}\z").alias("ok"))


# --- files -------------------------------------------------------------------


#: Small byte ranges, so that files of the test tables are cut too.
_CUT = 1 << 16


def _source_files(spark: SparkSession, sf: str) -> str:
    """A tree with one text file per source: its documents in order of their ids."""
    path = scratch_folder(spark, "texts")
    docs = table(spark, sf, "documents").select("source", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs.repartition("source").sortWithinPartitions("source", "doc_id").select("source", "text").write.option(
        "mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").partitionBy("source").text(path)
    return path


def _source(file: str) -> Column:
    return F.regexp_extract(file, "source=([^/]+)/", 1).alias("source")


def _named_files(spark: SparkSession, sf: str, sql: str = "SELECT doc_id, text FROM documents") -> str:
    """A tree with a file of its own for each document, named as in ``inputs.FILE_NAMES``."""
    path = scratch_folder(spark, "tree")
    named = derive(spark, sf, f"SELECT n.path, t.text FROM ({inputs.FILE_NAMES}) n JOIN ({sql}) t ON n.doc_id = t.doc_id",
                   "documents")
    files.write_texts(named, path, "path")
    return path


def _below(root: str) -> Column:
    return F.substring("path", len(root) + 2, 2**31 - 1)


@query
def file_inventory(spark, sf):
    root = _named_files(spark, sf)
    return files.file_inventory(spark, root, True, fixed.SCANNABLE_EXTENSIONS, True).select(
        _below(root).alias("rel_path"), "length")


@query
def os_properties(spark, sf):
    root = _named_files(spark, sf)
    rows = jobs.file_properties(spark, root, True)
    known = rows.groupBy("path", "file_type").agg(
        F.max(F.when(F.col("key") == "File Size", F.col("value"))).alias("size"),
        F.count_if(F.col("key").isin("Last Modified", "Last Accessed", "Created", "Permissions")).alias("n_others"),
        F.count_if(F.col("key") == "Error").alias("n_errors"))
    return known.select(_below(root).alias("rel_path"), "file_type", "size", "n_others", "n_errors")


@query
def file_manifest(spark, sf):
    return jobs.manifest(spark, _named_files(spark, sf), True)


@query
def compare_files(spark, sf):
    return jobs.compare_files(spark, _named_files(spark, sf, inputs.LEFT_TEXTS), _named_files(spark, sf, inputs.RIGHT_TEXTS))


@query
def verify_files(spark, sf):
    expected = derive(spark, sf, inputs.EXPECTED.replace("{sha256}", "sha2(text, 256)"), "documents")
    named = expected.join(derive(spark, sf, inputs.FILE_NAMES, "documents"), "doc_id").select(
        F.col("path").alias("rel_path"), "expected")
    return jobs.verify_files(spark, _named_files(spark, sf, inputs.LEFT_TEXTS), named)


@query
def verify_sizes(spark, sf):
    """Expected sizes too: contents of another size are a mismatch that is not hashed."""
    rows = documents(spark, sf)
    expected = rows.filter("doc_id % 2 = 0").select(
        "doc_id", F.sha2("text", 256).alias("expected"),
        (F.octet_length("text") + F.when(F.col("doc_id") % 6 == 0, 1).otherwise(0)).alias("length"))
    return prints.verify(rows, ["doc_id"], "text", expected)


@query
def identical_files(spark, sf):
    root = _named_files(spark, sf)
    found = jobs.identical_files(spark, root, head=64)
    return found.select(_below(root).alias("rel_path"), "length", "digest", "copies",
                        F.substring("first_path", len(root) + 2, 2**31 - 1).alias("first_path"))


@query
def read_text_lines(spark, sf):
    lines = ranges.read_text_lines(spark, _source_files(spark, sf), True, [".txt"], range_bytes=_CUT, piece_bytes=1 << 12)
    return lines.select(_source("file"), "line_no", "line")


@query
def scan_files(spark, sf):
    found = jobs.scan_files(spark, _source_files(spark, sf), True, range_bytes=_CUT)
    return found.select(_source("file"), "type", "description", "value", "line", "column", "context")


@query
def scan_files_summary(spark, sf):
    summary = jobs.scan_files_summary(spark, _source_files(spark, sf), True, range_bytes=_CUT)
    return summary.select(
        (F.col("files_found") >= F.col("files_scanned")).alias("all_scanned"), "files_scanned", "files_with_pii",
        "total_findings")


@query
def sanitize_files(spark, sf):
    out = scratch_folder(spark, "clean")
    stats = jobs.sanitize_files(spark, _source_files(spark, sf), out, True, types="all", range_bytes=_CUT)
    return _flat_stats(stats)


@query
def sanitized_files(spark, sf):
    out = scratch_folder(spark, "clean")
    jobs.sanitize_files(spark, _source_files(spark, sf), out, True, types="all", range_bytes=_CUT)
    lines = detect.explode_lines(spark.read.parquet(out), "text")
    return lines.select(_source("file"), (F.col("first_line") + F.col("line_no") - 1).alias("line_no"), "line")


@query
def findings_json(spark, sf):
    path = scratch_folder(spark, "report")
    found = detect.scan_text(texts(spark, sf), "text")
    tables.write_findings_json(found, detect.scan_summary(texts(spark, sf), "text"), path)
    rows = spark.read.schema(
        "id string, type string, line int, `column` int, value_masked string"
    ).json(f"{path}/findings")
    return rows


@query
def csv_round_trip(spark, sf):
    path = scratch_folder(spark, "csv")
    tables.write_csv(people(spark, sf).select("c_custkey", "c_name", "contact", "line"), path)
    return tables.read_csv_strings(spark, path)


@query
def csv_texts(spark, sf):
    """Whole documents as values, with their line ends, read in byte ranges."""
    path = scratch_folder(spark, "csv")
    tables.write_csv(table(spark, sf, "documents").select("doc_id", "lang", "text"), path)
    return tables.read_csv_strings(spark, path, range_bytes=_CUT)


@query
def anonymize_csv(spark, sf):
    source, out = scratch_folder(spark, "csv"), scratch_folder(spark, "csv")
    tables.write_csv(people(spark, sf).select("c_custkey", "c_name", "contact", "host"), source)
    jobs.anonymize_csv(spark, source, out)
    return tables.read_csv_strings(spark, out)
