"""Inputs the catalog derives from the tables, as SQL that Spark and DuckDB both read."""

from __future__ import annotations

_M = "md5(cast(event_id as string))"


def _num(expression: str, width: int = 0) -> str:
    value = f"cast({expression} as string)"
    return f"lpad({value}, {width}, '0')" if width else value


_Q = "chr(39)"

# Log lines, one in fourteen clean, the others with one or two secrets each.
LOG_LINES = f"""
SELECT event_id, CASE event_id % 14
  WHEN 0 THEN 'login token eyJ' || substr({_M}, 1, 12) || '.eyJ' || substr({_M}, 5, 14) || '.'
    || {_M} || ' ok'
  WHEN 1 THEN 'key AKIA' || upper(substr({_M}, 1, 16)) || ' of u' || {_num('user_id')} || '@a.org'
  WHEN 2 THEN 'Authorization: Bearer ' || {_M}
  WHEN 3 THEN 'Authorization: Basic ' || substr({_M}, 1, 12) || '=='
  WHEN 4 THEN 'API_KEY = ' || {_Q} || substr({_M}, 1, 20) || {_Q} || ' host 10.0.'
    || {_num('event_id % 300')} || '.7'
  WHEN 5 THEN '-----BEGIN RSA PRIVATE KEY-----' || {_M} || '-----END RSA PRIVATE KEY-----'
  WHEN 6 THEN 'connect mysql+pymysql://root:' || substr({_M}, 1, 6) || '@db'
    || {_num('event_id % 7')} || '/app?x=1 done'
  WHEN 7 THEN 'client 10.' || {_num('user_id % 256')} || '.0.1 and 192.168.'
    || {_num('event_id % 256')} || '.9'
  WHEN 8 THEN 'addr 2001:db8:' || substr({_M}, 1, 4) || ':' || substr({_M}, 5, 4) || ':0:0:0:'
    || substr({_M}, 9, 4) || ' up'
  WHEN 9 THEN 'mail from u' || {_num('user_id')} || '@mail.example.com to ops@example.com'
  WHEN 10 THEN 'session_id=' || substr({_M}, 1, 24)
  WHEN 11 THEN 'Set-Cookie: sid=' || {_M} || '; Path=/'
  WHEN 12 THEN 'digest ' || {_M} || ' done'
  ELSE event_type || ' finished' END AS line
FROM events"""

TEXTS = """
SELECT 'd' || cast(doc_id as string) AS id, text FROM documents
UNION ALL SELECT 'p' || cast(page_id as string) AS id, html AS text FROM pages"""

SSN_LINES = f"""
SELECT c_custkey AS id, 'number ' || {_num('c_custkey * 7 % 1000', 3)} || '-'
  || {_num('c_custkey % 100', 2)} || '-' || {_num('c_custkey * 13 % 10000', 4)} || ' of '
  || c_name AS text FROM customer"""

CARDS = f"""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0
  THEN '4' || {_num('o_orderkey * 7919 % 1000000000000000', 15)}
  WHEN o_orderkey % 3 = 1 THEN '37' || {_num('o_orderkey * 104729 % 10000000000000', 13)}
  ELSE {_num('o_orderkey % 10000', 4)} || ' 1111-2222 ' || {_num('o_custkey % 10000', 4)} END AS card
FROM orders"""

SSNS = f"""
SELECT o_orderkey, {_num('o_orderkey * 31 % 1000', 3)} || '-' || {_num('o_custkey % 100', 2)}
  || '-' || {_num('o_orderkey * 7 % 10000', 4)} AS ssn FROM orders"""

PHONES = f"""
SELECT o_orderkey, CASE o_orderkey % 4
  WHEN 0 THEN '+1 (' || {_num('200 + o_custkey % 800')} || ') 555-' || {_num('o_orderkey % 10000', 4)}
  WHEN 1 THEN {_num('o_custkey % 1000', 3)} || '.555.' || {_num('o_orderkey % 10000', 4)}
  WHEN 2 THEN '555-' || {_num('o_orderkey % 10000', 4)}
  ELSE {_num('o_orderkey', 17)} END AS phone FROM orders"""

ADDRESSES = f"""
SELECT l_orderkey, l_linenumber, {_num('l_orderkey % 300')} || '.' || {_num('l_partkey % 260')}
  || '.' || {_num('l_suppkey % 256')} || '.' || {_num('l_linenumber')} AS ip FROM lineitem"""

PEOPLE = f"""
SELECT c_custkey, c_name, 'u' || {_num('c_custkey % 500')} || '@shop.example' AS contact,
  {_num('c_custkey % 900 + 100', 3)} || '-' || {_num('c_custkey % 99 + 1', 2)} || '-'
    || {_num('c_custkey % 9999 + 1', 4)} AS code,
  '(' || {_num('c_custkey % 800 + 200')} || ') 555-' || {_num('c_custkey % 10000', 4)} AS line,
  '10.0.' || {_num('c_custkey % 256')} || '.' || {_num('c_nationkey')} AS host,
  CASE WHEN c_custkey % 5 = 0 THEN ' ' WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END
    AS town, c_mktsegment AS label
FROM customer"""

FILE_NAMES = f"""
SELECT doc_id, source || '/' || lang || '/f' || {_num('doc_id')} || CASE doc_id % 12
  WHEN 0 THEN '.txt' WHEN 1 THEN '.PDF' WHEN 2 THEN '.jpeg' WHEN 3 THEN '.docx'
  WHEN 4 THEN '.xlsx' WHEN 5 THEN '' WHEN 6 THEN '.tar.gz' WHEN 7 THEN '.Log'
  WHEN 8 THEN '.png' WHEN 9 THEN '.bmp' WHEN 10 THEN '.py' ELSE '.bin' END AS path
FROM documents"""

# Property rows: several per document, some blank, some missing.
PROPERTIES = f"""
SELECT path, scope, key, value FROM (
  SELECT doc_id, path FROM ({FILE_NAMES}) names
) files JOIN (
  SELECT doc_id AS id, 'os' AS scope, 'File Size' AS key, {_num('n_chars')} AS value FROM documents
  UNION ALL SELECT doc_id, 'format', 'author', CASE WHEN doc_id % 3 = 0 THEN lang ELSE ' ' END
    FROM documents
  UNION ALL SELECT doc_id, 'format', 'Creation Date', '2020-01-01' FROM documents
    WHERE doc_id % 4 < 2
  UNION ALL SELECT doc_id, 'format', 'title', source FROM documents WHERE doc_id % 5 > 0
  UNION ALL SELECT doc_id, 'format', 'created', '2021-02-03 04:05:06' FROM documents
    WHERE doc_id % 6 = 0
  UNION ALL SELECT doc_id, 'format', 'revision', {_num('doc_id % 9')} FROM documents
    WHERE doc_id % 2 = 0
  UNION ALL SELECT doc_id, 'format', 'Make', 'cam' FROM documents WHERE doc_id % 7 = 0
  UNION ALL SELECT doc_id, 'format', 'GPSInfo', CASE WHEN doc_id % 14 = 0 THEN NULL ELSE 'x' END
    FROM documents WHERE doc_id % 7 < 2
  UNION ALL SELECT doc_id, 'format', 'producer', 'p' FROM documents WHERE doc_id % 8 = 0
  UNION ALL SELECT doc_id, 'format', 'trapped', '' FROM documents WHERE doc_id % 8 < 4
) props ON files.doc_id = props.id"""

POLICIES = """
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'random' WHEN 1 THEN 'passphrase' ELSE 'pin' END
  AS mode, p_size AS length, p_size % 9 + 2 AS words, p_partkey % 2 = 0 AS use_upper,
  p_partkey % 5 > 0 AS use_lower, p_partkey % 7 < 4 AS use_digits, p_partkey % 11 < 6
  AS use_symbols, p_partkey % 13 < 4 AS exclude_ambiguous FROM part"""

COORDINATES = """
SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderkey % 90 END AS d,
  o_custkey % 60 AS m, o_orderkey * 7 % 60 AS s,
  CASE o_orderkey % 4 WHEN 0 THEN 'N' WHEN 1 THEN 'S' WHEN 2 THEN 'E' ELSE 'W' END AS ref
FROM orders"""

LEFT_TEXTS = "SELECT doc_id, text FROM documents WHERE doc_id % 11 <> 0"
RIGHT_TEXTS = """
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || '!' WHEN doc_id % 9 = 0 THEN
  '#' || substr(text, 2)
  ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0"""

EXPECTED = """
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN upper(md5(text)) WHEN 1 THEN sha1(text)
  WHEN 2 THEN ' ' || sha256_hex || ' ' WHEN 3 THEN substr(sha256_hex, 1, 20) || 'zz'
  || substr(sha256_hex, 23) ELSE '0' || substr(md5(text), 2) END AS expected
FROM (SELECT *, {sha256} AS sha256_hex FROM documents) d"""

# Words of five and seven letters that do not overlap themselves.
TERMS = """
SELECT DISTINCT term FROM (SELECT lower(word) AS term FROM (SELECT explode(split(text, ' ')) AS word FROM benchmark) w)
WHERE length(term) IN (5, 7) AND instr(term, chr(10)) = 0 AND left(term, 1) <> right(term, 1) AND left(term, 2) <> right(term, 2)
  AND left(term, 3) <> right(term, 3)"""
