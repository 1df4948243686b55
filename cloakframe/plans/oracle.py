"""The results the catalog must give, written again as plain SQL for DuckDB.

Nothing here is shared with the Spark code but the fixed values and the derived
inputs.
"""

from __future__ import annotations

from cloakframe.functions import fixed_values as fixed, pseudonyms as fakes
from cloakframe.plans import inputs


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def q_list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def lines(sql: str, key: str, text: str = "text") -> str:
    return (
        f"SELECT {key}, generate_subscripts(l, 1)::INT AS line_no, unnest(l) AS line "
        f"FROM (SELECT {key}, string_split({text}, chr(10)) AS l FROM ({sql}))"
    )


def luhn(v: str) -> str:
    d = f"cast(substr({v}, length({v}) - i + 1, 1) AS INT)"
    return (
        f"(list_sum(list_transform(range(1, length({v}) + 1), lambda i: CASE WHEN i % 2 = 0 THEN "
        f"2 * {d} - CASE WHEN {d} > 4 THEN 9 ELSE 0 END ELSE {d} END)) % 10 = 0)"
    )


def is_card(v: str) -> str:
    bare = rf"regexp_replace({v}, '[\s\-]', '', 'g')"
    return f"(length({bare}) BETWEEN 13 AND 19 AND {luhn(bare)})"


def is_ssn(v: str) -> str:
    d = f"replace(replace({v}, '-', ''), ' ', '')"
    return (
        f"(length({d}) = 9 AND substr({d}, 1, 3) NOT IN ('000', '666') AND substr({d}, 1, 1) <> '9' "
        f"AND substr({d}, 4, 2) <> '00' AND substr({d}, 6, 4) <> '0000')"
    )


def digits(v: str) -> str:
    return rf"regexp_replace({v}, '\D', '', 'g')"


def is_phone(v: str) -> str:
    return f"(length({digits(v)}) BETWEEN 10 AND 15)"


def is_ipv4(v: str) -> str:
    return (
        f"list_bool_and(list_transform(string_split({v}, '.'), lambda p: cast(p AS INT) <= 255))"
    )


PHONE_CORE = fixed.PHONE.removeprefix(r"(?<!\d)").removesuffix(r"(?!\d)")
# Without lookaround: what stands before is matched too, what stands after is tested later.
PHONE_RE2 = rf"(?:^|\D){PHONE_CORE}"


def is_whole_phone(v: str) -> str:
    return rf"({is_phone(v)} AND NOT regexp_matches(substr(line, col + length({v}), 1), '\d'))"


DETECTORS = {
    "SSN": (fixed.SSN, is_ssn),
    "CREDIT_CARD": (fixed.CREDIT_CARD, is_card),
    "EMAIL": (fixed.EMAIL, lambda v: "true"),
    "PHONE": (PHONE_RE2, is_whole_phone),
    "IP_ADDRESS": (fixed.IPV4, is_ipv4),
}


def starts(hits: str = "hs", gaps: str = "gs") -> str:
    return (
        f"list_transform(range(1, len({hits}) + 1), lambda i: (1 + "
        f"coalesce(list_sum(list_transform({gaps}[1:i], lambda g: length(g))), 0) + "
        f"coalesce(list_sum(list_transform({hits}[1:i-1], lambda h: length(h))), 0))::INT)"
    )


def search_starts() -> str:
    """Positions by searching on from hit to hit, for a pattern that eats its neighbours."""
    at = "(a.e + instr(substr(line, a.e + 1), x.v))::INT"
    return (
        "list_reduce(list_transform(hs, lambda h: struct_pack(v := h, ps := cast([] AS INT[]), "
        "e := 0)), lambda a, x: struct_pack(v := x.v, "
        f"ps := list_append(a.ps, {at}), e := ({at} + length(x.v) - 1)::INT), "
        "struct_pack(v := '', ps := cast([] AS INT[]), e := 0)).ps"
    )


def hits_of(kind: str, pattern: str, source: str, key: str) -> str:
    group = 1 if kind == "PHONE" else 0
    place = search_starts() if kind == "PHONE" else starts()
    return (
        f"SELECT {key}, line_no, line, {q(kind)} AS type, unnest(hs) AS value, "
        f"unnest({place}) AS col FROM (SELECT *, regexp_extract_all(line, {q(pattern)}, {group}) "
        f"AS hs, regexp_split_to_array(line, {q(pattern)}) AS gs FROM ({source}) "
        f"WHERE regexp_matches(line, {q(pattern)}))"
    )


def findings(source: str, key: str, types=tuple(DETECTORS)) -> str:
    parts = []
    for kind in types:
        pattern, valid = DETECTORS[kind]
        parts.append(f"SELECT * FROM ({hits_of(kind, pattern, source, key)}) WHERE {valid('value')}")
    first = "greatest(col - 20, 1)"
    cases = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in fixed.DESCRIPTIONS.items())
    return (
        f"SELECT {key}, type, CASE type {cases} END AS description, value, line_no AS line, "
        f'col AS "column", trim(substr(line, {first}, col + length(value) + 20 - {first})) AS context '
        f"FROM ({' UNION ALL '.join(parts)})"
    )


def mask(kind: str, v: str) -> str:
    return {
        "SSN": f"'***-**-' || right({v}, 4)",
        "CREDIT_CARD": f"'****-****-****-' || right({digits(v)}, 4)",
        "EMAIL": (
            f"CASE WHEN len(string_split({v}, '@')) <> 2 THEN {v} WHEN instr({v}, '@') > 2 THEN "
            f"left({v}, 1) || '***@' || split_part({v}, '@', 2) ELSE '***@' || "
            f"split_part({v}, '@', 2) END"
        ),
        "PHONE": f"CASE WHEN length({digits(v)}) >= 4 THEN '***-***-' || right({digits(v)}, 4) "
                 f"ELSE {v} END",
    }.get(kind, v)


MASKED = "CASE type " + " ".join(
    f"WHEN {q(k)} THEN {mask(k, 'value')}" for k in DETECTORS
) + " END"

SECRETS = (
    ("JWT", fixed.JWT, "JWT"),
    ("AWS_KEY", fixed.AWS_KEY, "AWS_KEY"),
    ("BEARER_TOKEN", fixed.BEARER_TOKEN, "BEARER"),
    ("BASIC_AUTH", fixed.BASIC_AUTH, "BASIC_AUTH"),
    ("API_KEY", "(?i)" + fixed.API_KEY, "API_KEY"),
    ("PRIVATE_KEY", fixed.PRIVATE_KEY, "PRIVATE_KEY"),
    ("CONNECTION_STRING", "(?i)" + fixed.CONNECTION_STRING, "CONNECTION_STRING"),
    ("IPV4", fixed.IPV4, "IP"),
    ("IPV6", fixed.IPV6, "IPV6"),
    ("EMAIL", fixed.PLAIN_EMAIL, "EMAIL"),
    ("SESSION_ID", "(?i)" + fixed.SESSION_ID, "SESSION"),
    ("SET_COOKIE", fixed.SET_COOKIE, "COOKIE"),
    ("HEX_TOKEN", fixed.HEX_TOKEN, "TOKEN"),
)
DEFAULT = tuple(n for n, _, _ in SECRETS if n not in fixed.OPTIONAL_SECRETS)
ALL = tuple(n for n, _, _ in SECRETS)


def sanitized(source: str, types=DEFAULT) -> str:
    """Rows of ``source`` (with ``line``) plus ``t``, the new line, and ``r``, the notes."""
    ctes = [
        f"s0 AS (SELECT *, line AS t, cast([] AS STRUCT(type VARCHAR, original_length INT, "
        f"placeholder VARCHAR)[]) AS r FROM ({source}))"
    ]
    last = "s0"
    for i, (kind, pattern, prefix) in enumerate(SECRETS, 1):
        if kind not in types:
            continue
        mark = f"'[{prefix}_' || substr(md5({{}}), 1, 8) || ']'"
        ctes.append(
            f"s{i} AS (SELECT * EXCLUDE (hs, gs) REPLACE ("
            f"array_to_string(list_transform(range(1, len(gs) + 1), lambda i: gs[i] || "
            f"coalesce({mark.format('hs[i]')}, '')), '') AS t, "
            f"list_concat(r, list_transform(hs, lambda h: struct_pack(type := {q(kind)}, "
            f"original_length := length(h)::INT, placeholder := {mark.format('h')}))) AS r) "
            f"FROM (SELECT *, regexp_extract_all(t, {q(pattern)}, 0) AS hs, "
            f"regexp_split_to_array(t, {q(pattern)}) AS gs FROM {last}))"
        )
        last = f"s{i}"
    return f"WITH {', '.join(ctes)} SELECT * FROM {last}"


def stats_of(source: str, types) -> str:
    return (
        f"SELECT count(*)::BIGINT AS total_lines, "
        f"count(*) FILTER (len(r) > 0)::BIGINT AS lines_modified, "
        f"coalesce(sum(len(r)), 0)::BIGINT AS total_replacements, "
        + ", ".join(
            f"coalesce(sum(len(list_filter(r, lambda x: x.type = {q(n)}))), 0)::BIGINT "
            f"AS n_{n.lower()}" for n in types
        )
        + f" FROM ({sanitized(source, types)})"
    )


DOC_LINES = lines("SELECT doc_id, text FROM documents", "doc_id")
TEXT_LINES = lines(inputs.TEXTS, "id")
DOC_FINDINGS = findings(DOC_LINES, "doc_id")
TEXT_FINDINGS = findings(TEXT_LINES, "id")

# --- fakes -------------------------------------------------------------------


def h(v: str) -> str:
    return f"md5(lower(trim({v})))"


def s(v: str, i: int) -> str:
    return f"('0x' || substr({h(v)}, {1 + 8 * i}, 8))::BIGINT"


def pick(values, number: str) -> str:
    return f"{q_list(values)}[{number} % {len(values)} + 1]"


def dig(number: str, width: int) -> str:
    return f"lpad(({number} % {10 ** width})::VARCHAR, {width}, '0')"


def fake(kind: str, v: str) -> str:
    a, b, c = s(v, 0), s(v, 1), s(v, 2)
    body = f"('4' || {dig(a, 7)} || {dig(b, 7)})"
    made = {
        "name": f"{pick(fakes.FIRST_NAMES, a)} || ' ' || {pick(fakes.LAST_NAMES, b)}",
        "email": f"lower({pick(fakes.FIRST_NAMES, a)}) || '.' || lower({pick(fakes.LAST_NAMES, b)})"
                 f" || {dig(c, 4)} || '@example.com'",
        "phone": f"'(' || (200 + {a} % 800)::VARCHAR || ') 555-01' || {dig(b, 2)}",
        "ssn": f"'9' || {dig(a, 2)} || '-' || {dig(b, 2)} || '-' || {dig(c, 4)}",
        "address": f"(1 + {a} % 9999)::VARCHAR || ' ' || {pick(fakes.STREETS, b)}",
        "city": pick(fakes.CITIES, a),
        "state": pick(fakes.STATES, a),
        "zip": dig(a, 5),
        "company": f"{pick(fakes.COMPANY_WORDS, a)} || ' ' || {pick(fakes.COMPANY_FORMS, b)}",
        "date_of_birth": f"strftime(date '{fakes.REFERENCE_DATE}' - ({fakes.YOUNGEST_DAYS} + "
                         f"{a} % {fakes.AGE_SPAN_DAYS})::INT, '%Y-%m-%d')",
        "ip_address": f"'10.' || ({a} % 256) || '.' || ({b} % 256) || '.' || ({c} % 256)",
        "credit_card": f"{body} || list_filter(range(0, 10), lambda d: "
                       f"{luhn(f'({body} || d::VARCHAR)')})[1]::VARCHAR",
    }[kind]
    return f"CASE WHEN {v} IS NULL OR trim({v}) = '' THEN {v} ELSE {made} END"


def type_by_name(n: str) -> str:
    cases = " ".join(
        f"WHEN regexp_matches(lower(trim({n})), {q('|'.join(ps))}) THEN {q(kind)}"
        for kind, ps in fixed.COLUMN_NAME_PATTERNS.items()
    )
    return f"CASE {cases} END"


PEOPLE_PLAN = {
    "c_name": "name", "contact": "email", "code": "ssn", "line": "phone", "host": "ip_address",
    "town": "city",
}
PEOPLE_COLUMNS = ("c_name", "contact", "code", "line", "host", "town", "label")
PEOPLE_LONG = (
    "SELECT c_custkey, unnest(" + q_list(PEOPLE_COLUMNS) + ") AS \"column\", unnest(["
    + ", ".join(PEOPLE_COLUMNS) + f"]) AS value FROM ({inputs.PEOPLE})"
)
_SHARES = " ".join(
    f"WHEN count(*) FILTER (regexp_matches(value, {q(p)})) * 2 > count(*) THEN {q(kind)}"
    for kind, p in fixed.COLUMN_VALUE_PATTERNS.items()
)
CONTENT_TYPES = (
    f"SELECT \"column\", count(*)::BIGINT AS sampled, CASE {_SHARES} END AS pii_type FROM (SELECT *, "
    f"row_number() OVER (PARTITION BY \"column\" ORDER BY c_custkey) AS rank FROM ({PEOPLE_LONG}) "
    f"WHERE value IS NOT NULL) WHERE rank <= {fixed.CONTENT_SAMPLE} GROUP BY \"column\""
)

# --- redaction ---------------------------------------------------------------

REDACT_TERMS = ("tion", "The in")
REDACT_PATTERNS = (r"\b[A-Z][a-z]+ing\b", r"[a-z]+@[a-z.]+")
PAGES = (0, 2, 5, 999)


def _spans(line: str, pattern: str) -> str:
    hs, gs = f"regexp_extract_all({line}, {q(pattern)}, 0)", f"regexp_split_to_array({line}, {q(pattern)})"
    return (
        f"list_transform(range(1, len({hs}) + 1), lambda i: struct_pack(s := "
        f"{starts(hs, gs)}[i], v := ({hs})[i]))"
    )


REDACT_RE = tuple("(?i)" + t for t in REDACT_TERMS) + REDACT_PATTERNS


def redacted_lines(source: str, key: str, fill: str = "█", terms: bool | None = None) -> str:
    """Lines with every covered character replaced; terms only, patterns only, or both."""
    chosen = {None: REDACT_RE, True: REDACT_RE[: len(REDACT_TERMS)],
              False: REDACT_RE[len(REDACT_TERMS):]}[terms]
    arrays = ", ".join(
        f"regexp_extract_all(line, {q(p)}, 0) AS h{n}, regexp_split_to_array(line, {q(p)}) AS g{n}"
        for n, p in enumerate(chosen)
    )
    each = ", ".join(
        f"list_transform(list_zip({starts(f'h{n}', f'g{n}')}, h{n}), "
        f"lambda z: struct_pack(s := z[1], v := z[2]))" for n in range(len(chosen))
    )
    spans = f"SELECT *, list_concat({each}) AS spans FROM (SELECT *, {arrays} FROM ({source}))"
    covered = "list_bool_or(list_transform(spans, lambda x: x.s <= k AND k < x.s + length(x.v)))"
    return (
        f"SELECT {key}, line_no, CASE WHEN len(spans) = 0 THEN line ELSE array_to_string("
        f"list_transform(range(1, length(line) + 1), lambda k: CASE WHEN {covered} THEN {q(fill)} "
        f"ELSE substr(line, k, 1) END), '') END AS line FROM ({spans})"
    )


def joined(source: str, key: str, text: str = "text") -> str:
    return f"SELECT {key}, string_agg(line, chr(10) ORDER BY line_no) AS {text} FROM ({source}) GROUP BY {key}"


TALK_LINES = lines("SELECT conv_id, turn, text FROM conversations", "conv_id, turn")

# --- properties --------------------------------------------------------------


def extension(path: str) -> str:
    return rf"lower(regexp_extract(split_part({path}, '/', -1), '^.+(\.[^.]+)$', 1))"


def file_type(path: str) -> str:
    cases = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in fixed.FILE_TYPES.items())
    e = extension(path)
    return (
        f"CASE {e} {cases} WHEN '' THEN 'Other (no extension)' ELSE 'Other (' || {e} || ')' END"
    )


def risk(key: str, value: str) -> str:
    k = f"replace(lower({key}), ' ', '_')"
    return (
        f"CASE WHEN {value} IS NULL OR trim({value}) = '' THEN 'low' WHEN {k} IN "
        f"({', '.join(q(x) for x in fixed.HIGH_RISK_KEYS)}) THEN 'high' WHEN "
        f"regexp_matches({k}, '{'|'.join(fixed.MEDIUM_RISK_WORDS)}') THEN 'medium' ELSE 'low' END"
    )


FILE_RISK = (
    f"SELECT path, CASE max(CASE WHEN scope <> 'format' THEN 0 WHEN r = 'high' THEN 2 WHEN "
    f"r = 'medium' THEN 1 ELSE 0 END) WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS risk "
    f"FROM (SELECT *, {risk('key', 'value')} AS r FROM ({inputs.PROPERTIES})) GROUP BY path"
)
_CORE = ", ".join(q(x) for x in fixed.CORE_PROPERTIES)
_DATES = ", ".join(q(x) for x in fixed.DATE_PROPERTIES)
_PDF = ", ".join(q(x) for x in fixed.PDF_PROPERTIES)
CLEARED = (
    f"(key IN ({_CORE}) AND trim(coalesce(value, '')) <> '' OR key = 'revision' "
    f"OR key IN ({_DATES}) AND value IS NOT NULL)"
)
CLEAR_STATS = (
    f"SELECT path, count(*) FILTER ({CLEARED})::BIGINT AS properties_cleared "
    f"FROM ({inputs.PROPERTIES}) GROUP BY path"
)
DIRTY = (
    f"SELECT path, bool_or(key IN ({_PDF}) AND coalesce(value, '') <> '') AS dirty "
    "FROM ({}) GROUP BY path"
)
WIPED = (
    f"SELECT path, scope, key, CASE WHEN key IN ({_PDF}) THEN '' ELSE value END AS value "
    f"FROM ({inputs.PROPERTIES})"
)


def size_text(n: str) -> str:
    def shown(power: int) -> str:
        unit = 1024**power
        tenths = f"({n}::HUGEINT * 10)"
        down, rest = f"({tenths} // {unit})", f"({tenths} % {unit})"
        r = (f"({down} + CASE WHEN {rest} * 2 > {unit} OR ({rest} * 2 = {unit} AND {down} % 2 = 1) "
             f"THEN 1 ELSE 0 END)")
        return f"({r} // 10)::VARCHAR || '.' || ({r} % 10)::VARCHAR || ' {fixed.SIZE_UNITS[power]}'"

    cases = " ".join(f"WHEN {n} < {1024 ** (p + 1)} THEN {shown(p)}" for p in range(4))
    return f"CASE {cases} ELSE {shown(4)} END"


_CHARS = (
    f"(CASE WHEN use_upper THEN 26 ELSE 0 END + CASE WHEN use_lower THEN 26 ELSE 0 END + "
    f"CASE WHEN use_digits THEN 10 ELSE 0 END + CASE WHEN use_symbols THEN {len(fixed.SYMBOLS)} "
    f"ELSE 0 END - CASE WHEN exclude_ambiguous THEN {len(fixed.AMBIGUOUS)} ELSE 0 END)"
)
BITS = (
    f"CASE mode WHEN 'passphrase' THEN words * log2({fixed.PASSPHRASE_WORDS}.0) WHEN 'pin' THEN "
    f"length * log2(10.0) ELSE length * log2(greatest({_CHARS}, 1)::DOUBLE) END"
)
_EXPECTED = inputs.EXPECTED.replace("{sha256}", "sha256(text)")
_DEGREES = "CASE WHEN ref IN ('S', 'W') THEN -1 ELSE 1 END * (d + m / 60.0 + s / 3600.0)"


def oracles() -> dict[str, str]:
    """Query name to SQL."""
    plan = PEOPLE_PLAN
    found = {
        "explode_lines": DOC_LINES,
        "non_blank_lines": f"SELECT doc_id, count(*)::BIGINT AS n_lines FROM ({DOC_LINES}) "
                           r"WHERE regexp_matches(line, '\S') GROUP BY doc_id",
        "scan_documents": DOC_FINDINGS,
        "scan_counts": f"SELECT type, count(*)::BIGINT AS n FROM ({TEXT_FINDINGS}) GROUP BY type",
        "scan_selected_types": findings(TEXT_LINES, "id", ("EMAIL", "IP_ADDRESS")),
        "scan_ssn": findings(lines(inputs.SSN_LINES, "id"), "id", ("SSN",)),
        "scan_masked": f'SELECT id, type, line, "column", {MASKED} AS value_masked '
                       f"FROM ({TEXT_FINDINGS})",
        "scan_masked_context": f"""
            SELECT id, type, description, line, "column", {MASKED} AS value_masked,
              replace(regexp_replace(regexp_replace(replace(context, value, chr(1)),
              '[^\\s\\x01]*@[^\\s\\x01]*', '***', 'g'), '\\d', '#', 'g'), chr(1), {MASKED})
              AS context FROM ({TEXT_FINDINGS})""",
        "scan_report": f'SELECT id, type, count(*) OVER (PARTITION BY id, type)::BIGINT AS '
                       f'instances, line, "column", {MASKED} AS value_masked '
                       f"FROM ({TEXT_FINDINGS})",
        "scan_file_counts": f"SELECT id, type, count(*)::BIGINT AS instances "
                            f"FROM ({TEXT_FINDINGS}) GROUP BY id, type",
        "scan_summary": f"SELECT (SELECT count(*) FROM ({inputs.TEXTS}))::BIGINT AS rows_scanned, "
                        "count(DISTINCT id)::BIGINT AS rows_with_hits, count(*)::BIGINT AS "
                        "total_findings, " + ", ".join(
                            f"count(*) FILTER (type = {q(k)})::BIGINT AS n_{k.lower()}"
                            for k in DETECTORS) + f" FROM ({TEXT_FINDINGS})",
        "scan_by_label": f"SELECT type, toxic, count(*)::BIGINT AS n FROM ({DOC_FINDINGS}) f "
                         "JOIN labels l ON f.doc_id = l.doc_id GROUP BY type, toxic",
        "valid_cards": f"SELECT o_orderkey, {is_card('card')} AS valid, "
                       f"{mask('CREDIT_CARD', 'card')} AS masked FROM ({inputs.CARDS})",
        "valid_ssns": f"SELECT o_orderkey, {is_ssn('ssn')} AS valid, {mask('SSN', 'ssn')} AS "
                      f"masked FROM ({inputs.SSNS})",
        "valid_phones": f"SELECT o_orderkey, {is_phone('phone')} AS valid, "
                        f"{mask('PHONE', 'phone')} AS masked FROM ({inputs.PHONES})",
        "valid_addresses": f"SELECT l_orderkey, l_linenumber, ip, {is_ipv4('ip')} AS valid "
                           f"FROM ({inputs.ADDRESSES})",
        "sql_functions": f"SELECT c_custkey, {is_ssn('code')} AS ssn_ok, {is_phone('line')} AS "
                         f"phone_ok, {is_ipv4('host')} AS ip_ok, false AS card_ok, "
                         f"{mask('SSN', 'code')} AS ssn, {mask('PHONE', 'line')} AS phone, "
                         f"{mask('EMAIL', 'contact')} AS email, {mask('CREDIT_CARD', 'line')} AS "
                         f"card FROM ({inputs.PEOPLE})",
        "sanitize_logs": f"SELECT event_id, t AS line FROM ({sanitized(inputs.LOG_LINES, ALL)})",
        "sanitize_noted": f"SELECT event_id, t AS line, len(r)::INT AS n "
                          f"FROM ({sanitized(inputs.LOG_LINES)})",
        "placeholders": "SELECT s_suppkey, '[NAME_' || substr(md5(s_name), 1, 8) || ']' AS "
                        "placeholder FROM supplier",
        "type_by_name": f"SELECT word, {type_by_name('word')} AS pii_type FROM (SELECT DISTINCT "
                        r"unnest(regexp_split_to_array(lower(text), '[ .,\n]+')) AS word "
                        "FROM documents)",
        "type_by_content": CONTENT_TYPES,
        "column_plan": "SELECT " + ", ".join(
            f"count({c})::BIGINT AS {c}_as_{k}" for c, k in sorted({
                "c_name": "name", "contact": "email", "code": "ssn", "line": "phone",
                "host": "ip_address", "town": "city"}.items())
        ) + f" FROM ({inputs.PEOPLE})",
        "pseudonym_seeds": f"SELECT c_custkey, {s('c_name', 3)} AS seed FROM customer",
        "anonymize_people": "SELECT c_custkey, " + ", ".join(
            f"{fake(k, c)} AS {c}" for c, k in plan.items()
        ) + f", label FROM ({inputs.PEOPLE})",
        "anonymize_planned": f"SELECT c_custkey, {fake('name', 'c_name')} AS c_name, "
                             f"{fake('company', 'label')} AS label, {fake('city', 'town')} AS town "
                             f"FROM ({inputs.PEOPLE})",
        "anonymize_inferred": f"SELECT p_partkey, {fake('name', 'p_name')} AS p_name, p_brand "
                              "FROM part",
        "anonymize_preview": " UNION ALL ".join(
            f"(SELECT {q(c)} AS \"column\", {q(k)} AS pii_type, row_number() OVER (ORDER BY "
            f"c_custkey)::INT AS rank, {c} AS original, {fake(k, c)} AS fake FROM "
            f"({inputs.PEOPLE}) WHERE {c} IS NOT NULL ORDER BY c_custkey LIMIT 3)"
            for c, k in plan.items()),
        "anonymize_stats": f"SELECT count(*)::BIGINT AS n_rows, {len(plan)}::BIGINT AS "
                           f"columns_anonymized, ({' + '.join(f'count({c})' for c in plan)})"
                           f"::BIGINT AS values_replaced FROM ({inputs.PEOPLE})",
        "page_filter": f"SELECT conv_id, turn FROM conversations WHERE turn IN {PAGES}",
        "digests": "SELECT doc_id, sha256(text) AS sha256, sha1(text) AS sha1, md5(text) AS md5, "
                   "128::BIGINT AS sha512_length FROM documents",
        "digest_rows": "SELECT doc_id, strlen(text)::BIGINT AS length, 'sha1' AS algorithm, "
                       "sha1(text) AS digest FROM documents",
        "verify_digests": f"""
            SELECT doc_id, algorithm, expected, actual,
              CASE WHEN actual = expected THEN 'MATCH' ELSE 'MISMATCH' END AS status,
              CASE WHEN actual <> expected THEN (list_filter(range(1, least(length(actual),
                length(expected)) + 1), lambda i: substr(actual, i, 1) <> substr(expected, i, 1))[1]
                - 1)::INT END AS first_difference
            FROM (SELECT *, CASE algorithm WHEN 'md5' THEN md5(text) WHEN 'sha1' THEN sha1(text)
                ELSE sha256(text) END AS actual
              FROM (SELECT doc_id, text, lower(trim(expected)) AS expected, CASE
                length(trim(expected)) WHEN 32 THEN 'md5' WHEN 40 THEN 'sha1' ELSE 'sha256' END
                AS algorithm FROM ({_EXPECTED}) JOIN documents USING (doc_id)))""",
        "compare_texts": f"""
            SELECT doc_id, strlen(l.text)::BIGINT AS left_length, strlen(r.text)::BIGINT AS
              right_length, CASE WHEN r.text IS NULL THEN 'LEFT_ONLY' WHEN l.text IS NULL THEN
              'RIGHT_ONLY' WHEN l.text = r.text THEN 'IDENTICAL' ELSE 'DIFFERENT' END AS status
            FROM ({inputs.LEFT_TEXTS}) l FULL JOIN ({inputs.RIGHT_TEXTS}) r USING (doc_id)""",
        "identical_groups": "SELECT strlen(text)::BIGINT AS length, sha256(text) AS digest, "
                            "count(*)::BIGINT AS copies, min(doc_id) AS first_id FROM documents "
                            "GROUP BY text HAVING count(*) > 1",
        "identical_members": "SELECT doc_id, strlen(text)::BIGINT AS length, sha256(text) AS "
                             "digest, copies, first_id FROM (SELECT *, count(*) OVER (PARTITION BY "
                             "text)::BIGINT AS copies, min(doc_id) OVER (PARTITION BY text) AS "
                             "first_id FROM documents) WHERE copies > 1",
        "manifest": "SELECT path AS rel_path, strlen(text)::BIGINT AS length, 'sha256' AS "
                    f"algorithm, sha256(text) AS digest FROM ({inputs.FILE_NAMES}) JOIN documents "
                    "USING (doc_id)",
        "manifest_round_trip": f"SELECT path AS rel_path, sha256(text) AS digest FROM "
                               f"({inputs.FILE_NAMES}) JOIN documents USING (doc_id)",
        "format_sizes": f"SELECT o_orderkey, {size_text('n')} AS size_text FROM (SELECT "
                        "o_orderkey, o_orderkey * o_orderkey * o_custkey * 64 AS n FROM orders)",
        "inventory_summary": f"SELECT files, total_size, {size_text('total_size')} AS "
                             "total_size_text FROM (SELECT count(*)::BIGINT AS files, "
                             "sum(strlen(text))::BIGINT AS total_size FROM documents)",
        "file_types": f"SELECT doc_id, path, {file_type('path')} AS file_type "
                      f"FROM ({inputs.FILE_NAMES})",
        "page_types": f"SELECT {file_type('url')} AS file_type, count(*)::BIGINT AS n FROM pages "
                      "GROUP BY 1",
        "scannable_names": f"SELECT doc_id, path FROM ({inputs.FILE_NAMES}) WHERE "
                           f"{extension('path')} IN {fixed.SCANNABLE_EXTENSIONS}",
        "property_risk": f"SELECT path, scope, key, {risk('key', 'value')} AS risk "
                         f"FROM ({inputs.PROPERTIES})",
        "file_risk": FILE_RISK,
        "risk_summary": "SELECT count(*)::BIGINT AS files_scanned, count(*) FILTER (risk = "
                        "'high')::BIGINT AS high_risk, count(*) FILTER (risk = 'medium')::BIGINT "
                        "AS medium_risk, count(*) FILTER (risk = 'low')::BIGINT AS clean "
                        f"FROM ({FILE_RISK})",
        "sensitive_tags": f"SELECT path, count(DISTINCT key) FILTER (key IN "
                          f"{fixed.SENSITIVE_IMAGE_TAGS})::BIGINT AS sensitive_tags "
                          f"FROM ({inputs.PROPERTIES}) GROUP BY path",
        "gps_positions": f"SELECT o_orderkey, round({_DEGREES}, 6) AS degrees, d IS NOT NULL AS "
                         f"has_position FROM ({inputs.COORDINATES})",
        "render_values": "SELECT doc_id, CASE WHEN length(text) > 80 THEN left(text, 77) || '...' "
                         "ELSE text END AS image, CASE WHEN length(text) > 80 THEN left(text, 80) "
                         "|| '...' ELSE text END AS office, strlen(left(text, doc_id % 200)) > 100 "
                         "AS is_long FROM documents",
        "present_properties": f"SELECT path, key, value FROM ({inputs.PROPERTIES}) WHERE key IN "
                              f"({_CORE}, 'revision', {_DATES}) AND trim(coalesce(value, '')) <> ''",
        "clear_properties": f"SELECT path, scope, key, CASE WHEN NOT {CLEARED} THEN value WHEN key "
                            f"= 'revision' THEN '1' WHEN key IN ({_DATES}) THEN "
                            f"'{fixed.NEUTRAL_DATE}' ELSE '' END AS value "
                            f"FROM ({inputs.PROPERTIES})",
        "clear_stats": CLEAR_STATS,
        "clear_summary": "SELECT count(*)::BIGINT AS files_processed, count(*) FILTER "
                         "(properties_cleared > 0)::BIGINT AS files_cleaned, "
                         "sum(properties_cleared)::BIGINT AS properties_cleared "
                         f"FROM ({CLEAR_STATS})",
        "wipe_fields": WIPED,
        "dirty_files": DIRTY.format(inputs.PROPERTIES),
        "wipe_summary": "SELECT count(*)::BIGINT AS total, count(*) FILTER (NOT dirty)::BIGINT AS "
                        "cleaned, count(*) FILTER (dirty)::BIGINT AS failed "
                        f"FROM ({DIRTY.format(WIPED)})",
        "drop_comments": "SELECT conv_id, turn, role FROM conversations WHERE role <> 'assistant'",
        "comment_counts": "SELECT conv_id AS path, count(*)::BIGINT AS comments_removed FROM "
                          "conversations WHERE role = 'assistant' GROUP BY conv_id",
        "metadata_objects": f"""
            SELECT path, any_value({file_type('path')}) AS file_type,
              count(DISTINCT key) FILTER (scope = 'os' AND value IS NOT NULL)::BIGINT AS n_os,
              count(DISTINCT key) FILTER (scope = 'format' AND value IS NOT NULL)::BIGINT AS
              n_format, max({risk('key', 'value')}) FILTER (key = 'author') AS author_risk,
              max(value) FILTER (key = 'title') AS title
            FROM ({inputs.PROPERTIES}) GROUP BY path""",
        "encrypt_sizes": "SELECT doc_id, (strlen(text) + 44)::BIGINT AS blob_size FROM documents",
        "decrypt_round_trip": "SELECT doc_id, md5(text) AS digest FROM documents",
        "decrypt_tampered": "SELECT count(*) FILTER (doc_id % 3 = 2)::BIGINT AS succeeded, "
                            "count(*) FILTER (doc_id % 3 < 2)::BIGINT AS failed FROM documents",
        "entropy": f"SELECT p_partkey, round(bits, 6) AS bits, CASE WHEN bits < 40 THEN 'Weak' "
                   "WHEN bits < 60 THEN 'Fair' WHEN bits < 80 THEN 'Good' WHEN bits < 100 THEN "
                   f"'Strong' ELSE 'Excellent' END AS rating FROM (SELECT *, {BITS} AS bits FROM "
                   f"({inputs.POLICIES}))",
        "issue_codes": "SELECT c_custkey, 20 AS length, true AS upper, true AS lower, true AS "
                       "digit, true AS symbol FROM customer",
        "issue_passphrases": "SELECT c_custkey, 4 AS n_words FROM customer",
        "issue_pins": "SELECT c_custkey, true AS ok FROM customer",
        "csv_texts": "SELECT doc_id::VARCHAR AS doc_id, lang, text FROM documents",
        "csv_round_trip": f"SELECT c_custkey::VARCHAR AS c_custkey, c_name, contact, line "
                          f"FROM ({inputs.PEOPLE})",
        "anonymize_csv": f"SELECT c_custkey::VARCHAR AS c_custkey, {fake('name', 'c_name')} AS "
                         f"c_name, {fake('email', 'contact')} AS contact, "
                         f"{fake('ip_address', 'host')} AS host FROM ({inputs.PEOPLE})",
    }
    named = f"SELECT n.path AS rel_path, d.* FROM ({inputs.FILE_NAMES}) n JOIN documents d USING (doc_id)"
    wanted = ", ".join(q(e) for e in (*fixed.SCANNABLE_EXTENSIONS, ""))
    found["file_inventory"] = (
        f"SELECT rel_path, strlen(coalesce(text, ''))::BIGINT AS length FROM ({named}) WHERE {extension('rel_path')} IN ({wanted})")
    found["os_properties"] = (
        f"SELECT rel_path, {file_type('rel_path')} AS file_type, {size_text('n')} AS size, 4::BIGINT AS n_others, "
        f"0::BIGINT AS n_errors FROM (SELECT rel_path, strlen(coalesce(text, ''))::BIGINT AS n FROM ({named}))")
    found["file_manifest"] = (
        "SELECT rel_path, strlen(coalesce(text, ''))::BIGINT AS length, 'sha256' AS algorithm, "
        f"sha256(coalesce(text, '')) AS digest FROM ({named})")
    found["compare_files"] = (
        f"SELECT n.path AS rel_path, c.left_length, c.right_length, c.status FROM ({found['compare_texts']}) c "
        f"JOIN ({inputs.FILE_NAMES}) n USING (doc_id)")
    found["verify_files"] = (
        f"SELECT n.path AS rel_path, algorithm, expected, CASE WHEN here THEN actual END AS actual, "
        "CASE WHEN here THEN status ELSE 'MISSING' END AS status, CASE WHEN here THEN first_difference END AS "
        f"first_difference FROM (SELECT *, doc_id % 11 <> 0 AS here FROM ({found['verify_digests']})) v "
        f"JOIN ({inputs.FILE_NAMES}) n USING (doc_id)")
    found["verify_sizes"] = (
        "SELECT doc_id, 'sha256' AS algorithm, sha256(text) AS expected, CASE WHEN doc_id % 6 > 0 THEN sha256(text) END AS actual, "
        "CASE WHEN doc_id % 6 > 0 THEN 'MATCH' ELSE 'MISMATCH' END AS status, NULL::BIGINT AS first_difference "
        "FROM documents WHERE doc_id % 2 = 0")
    found["identical_files"] = (
        "SELECT * FROM (SELECT rel_path, strlen(text)::BIGINT AS length, sha256(text) AS digest, (count(*) OVER same)::BIGINT AS copies, "
        f"min(rel_path) OVER same AS first_path FROM ({named}) WINDOW same AS (PARTITION BY sha256(text))) WHERE copies > 1")
    terms = inputs.TERMS.replace("explode(split(text, ' '))", "unnest(string_split(text, ' '))")
    windows = (
        "SELECT doc_id, i AS s, i + k AS e, lower(substr(text, i, k)) AS found FROM (SELECT doc_id, text, k, "
        "unnest(range(1, length(text) - k + 2)) AS i FROM documents CROSS JOIN (SELECT unnest([5, 7]) AS k))")
    hits = f"SELECT w.* FROM ({windows}) w JOIN ({terms}) t ON w.found = t.term"
    found["term_hits"] = (
        f"SELECT found, count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS n_docs, sum(s)::BIGINT AS starts FROM ({hits}) GROUP BY found")
    found["redact_term_table"] = (
        f"SELECT d.doc_id, CASE WHEN h.p IS NULL THEN text ELSE (SELECT string_agg(CASE WHEN list_contains(h.p, x.i) THEN '█' ELSE "
        "substr(d.text, x.i, 1) END, '' ORDER BY x.i) FROM (SELECT unnest(range(1, length(d.text) + 1)) AS i) x) END AS text "
        f"FROM documents d LEFT JOIN (SELECT doc_id, list(DISTINCT i) AS p FROM (SELECT doc_id, unnest(range(s, e)) AS i FROM ({hits})) "
        "GROUP BY doc_id) h USING (doc_id)")
    found["encrypt_tree"] = (
        "SELECT rel_path, greatest((strlen(text) + 999) // 1000, 1)::BIGINT AS frames, strlen(text)::BIGINT AS size, 'OK' AS status, "
        f"sha256(text) AS digest FROM ({named})")
    found["unique_fakes"] = " UNION ALL ".join(
        f"SELECT {q(c)} AS \"column\", count({c})::BIGINT AS n_values, count(DISTINCT {c})::BIGINT AS n_different, "
        f"count(DISTINCT {c})::BIGINT AS n_fakes, true AS consistent, 0::BIGINT AS n_unchanged FROM ({inputs.PEOPLE})"
        for c in ("c_name", "contact", "code", "line", "host"))
    source_lines = lines(
        "SELECT source, string_agg(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), chr(10) "
        "ORDER BY doc_id) || chr(10) AS text FROM documents GROUP BY source", "source")
    source_findings = findings(source_lines, "source")
    found["read_text_lines"] = f"SELECT source, line_no::BIGINT AS line_no, line FROM ({source_lines})"
    found["scan_files"] = f"SELECT * REPLACE (line::BIGINT AS line) FROM ({source_findings})"
    found["scan_files_summary"] = (
        "SELECT true AS all_scanned, (SELECT count(DISTINCT source) FROM documents)::BIGINT AS files_scanned, "
        f"count(DISTINCT source)::BIGINT AS files_with_pii, count(*)::BIGINT AS total_findings FROM ({source_findings})"
    )
    found["sanitize_files"] = stats_of(source_lines, ALL)
    found["sanitized_files"] = (
        f"SELECT source, line_no::BIGINT AS line_no, line FROM (SELECT source, line_no, t AS line, bool_or(len(r) > 0) "
        f"OVER (PARTITION BY source) AS changed FROM ({sanitized(source_lines, ALL)})) WHERE changed"
    )
    found["findings_json"] = found["scan_masked"]
    for kind in ("CREDIT_CARD", "EMAIL", "PHONE", "IP_ADDRESS"):
        found[f"scan_{kind.lower()}"] = findings(TEXT_LINES, "id", (kind,))
    for name in ALL:
        found[f"sanitize_{name.lower()}"] = (
            f"SELECT event_id, t AS line FROM ({sanitized(inputs.LOG_LINES, (name,))}) "
            "WHERE t <> line"
        )
    for name, types in (("sanitize_documents", DEFAULT), ("sanitize_all_types", ALL)):
        rows = f"SELECT doc_id, line_no, t AS line FROM ({sanitized(DOC_LINES, types)})"
        found[name] = joined(rows, "doc_id")
    found["sanitize_stream"] = found["sanitize_all_types"]
    found["sanitize_changed"] = (
        f"SELECT c.* FROM ({found['sanitize_all_types']}) c JOIN documents d USING (doc_id) "
        "WHERE c.text <> d.text"
    )
    for name, source, key in (
        ("sanitize_preview", DOC_LINES, "doc_id"),
        ("sanitize_log_preview", f"SELECT event_id, 1 AS line_no, line FROM ({inputs.LOG_LINES})",
         "event_id"),
    ):
        found[name] = (
            f"SELECT {key}, line_no, step, x.type AS type, x.original_length AS original_length, "
            f"x.placeholder AS placeholder FROM (SELECT {key}, line_no, unnest(r) AS x, "
            f"generate_subscripts(r, 1)::INT AS step FROM ({sanitized(source, ALL)}))"
        )
    found["sanitize_stats"] = stats_of(DOC_LINES, ALL)
    found["sanitize_log_stats"] = stats_of(inputs.LOG_LINES, ALL)
    for kind in fakes.GENERATORS:
        found[f"fake_{kind}"] = (
            f"SELECT c_custkey, {fake(kind, 'c_name')} AS fake, {fake(kind, 'town')} AS fake_town "
            f"FROM ({inputs.PEOPLE})"
        )
    found["redact_terms"] = joined(redacted_lines(DOC_LINES, "doc_id", terms=True), "doc_id")
    found["redact_patterns"] = joined(
        redacted_lines(DOC_LINES, "doc_id", "", terms=False), "doc_id"
    )
    any_pattern = " OR ".join(f"regexp_matches(line, {q(p)})" for p in REDACT_PATTERNS)
    found["redact_lines"] = joined(
        f"SELECT doc_id, line_no, CASE WHEN {any_pattern} THEN repeat('█', length(line)) ELSE line "
        f"END AS line FROM ({DOC_LINES})", "doc_id"
    )
    talk = joined(redacted_lines(TALK_LINES, "conv_id, turn"), "conv_id, turn")
    found["redact_pages"] = (
        f"SELECT c.conv_id, c.turn, CASE WHEN c.turn IN {PAGES} THEN r.text ELSE c.text END AS text "
        f"FROM conversations c JOIN ({talk}) r ON c.conv_id = r.conv_id AND c.turn = r.turn"
    )
    talk_pages = f"SELECT * FROM ({TALK_LINES}) WHERE turn IN {PAGES}"
    previews = [
        f"SELECT conv_id, turn, line_no, {q(wanted)} AS wanted, unnest({_spans('line', p)}) AS x "
        f"FROM ({talk_pages})"
        for wanted, p in zip(REDACT_TERMS + REDACT_PATTERNS, REDACT_RE, strict=True)
    ]
    found["redact_preview"] = (
        "SELECT conv_id, turn, line_no, wanted, x.s AS \"column\", left(trim(x.v), 40) || CASE WHEN "
        f"length(trim(x.v)) > 40 THEN '...' ELSE '' END AS found FROM ({' UNION ALL '.join(previews)})"
    )
    n = " + ".join(f"len(regexp_extract_all(line, {q(p)}, 0))" for p in REDACT_RE)
    found["redact_stats"] = (
        "SELECT count(*)::BIGINT AS pages_processed, count(*) FILTER (n > 0)::BIGINT AS "
        "pages_with_redactions, sum(n)::BIGINT AS total_redactions FROM (SELECT conv_id, turn, "
        f"sum({n}) AS n FROM ({talk_pages}) GROUP BY conv_id, turn)"
    )
    return found
