"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

_ESC = "replace(coalesce(text, ''), '\\', '\\e')"
for _m in ("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "[ROLE]", "[/ROLE]", "[:]", "[+]"):
    _ESC = f"replace({_ESC}, '{_m}', '{('\\l' if _m[0] == '<' else '\\b') + _m[1:]}')"

OP1 = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), o AS (
  SELECT *, row_number() OVER w AS rn, lag(role) OVER w AS prev, {_ESC} AS esc
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY rn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(esc) + CASE WHEN prev = role THEN 3
    ELSE CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 16 + length(role) END END) AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id
"""

ORACLES: dict[str, str] = {"op1_chat": OP1}

_CRLF = "chr(13) || chr(10)"


def _unreference(x: str) -> str:
    for name, char in {"&nbsp;": "' '", "&lt;": "'<'", "&gt;": "'>'", "&quot;": "'\"'", "&#39;": "''''", "&apos;": "''''", "&amp;": "'&'"}.items():
        x = f"replace({x}, '{name}', {char})"
    return x


def _uuid(h: str) -> str:
    at = lambda a, n: f"substr({h}, {a}, {n})"
    return f"'<urn:uuid:' || {at(1, 8)} || '-' || {at(9, 4)} || '-5' || {at(14, 3)} || '-a' || {at(18, 3)} || '-' || {at(21, 12)} || '>'"


def _gsub(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, '{pattern}', {by}, 'g')"


_BREAKS = "p|div|br|li|ul|ol|tr|table|h[1-6]|section|article|header|footer|nav|blockquote|pre|title|main|aside|form|hr"
_TEXT = _gsub("html", "(?s)<!--.*?-->", "' '")
_TEXT = _gsub(_TEXT, r"(?is)<(?:script|style|noscript)[^>]*>.*?</(?:script|style|noscript)[ \t\r\n]*>", "' '")
_TEXT = _gsub(_TEXT, rf"(?i)</?(?:{_BREAKS})(?:[ \t\r\n/][^>]*)?>", "chr(10)")
_TEXT = _unreference(_gsub(_TEXT, "<[^>]*>", "''"))
_TEXT = _gsub(_gsub(_gsub(_TEXT, r"[ \t\r]+", "' '"), r" ?\n[ \n]*", "chr(10)"), r"^[ \n]+|[ \n]+$", "''")
_TITLE = _gsub(_unreference("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"), r"[ \t\r\n]+", "' '")
_LINKS = "list_transform(regexp_extract_all(html, '(?i)<a [^>]*href=\"([^\"]*)\"', 1), lambda x: 'outlink: ' || " + _unreference("x") + f" || {_CRLF})"

OP2 = f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
r AS (SELECT *, sha256('response' || chr(10) || coalesce(page_id::VARCHAR, '') || chr(10) || url || chr(10) || sha256(html)) AS h FROM p),
d AS (SELECT page_id, url AS target_uri, {_uuid('h')} AS refers_to, 'sha256:' || sha256(html) AS payload_digest, 'conversion' AS record_type, 'text/plain; charset=utf-8' AS ct, {_TEXT} AS block FROM r
  UNION ALL SELECT page_id, url, {_uuid('h')}, 'sha256:' || sha256(html), 'metadata', 'application/warc-fields',
    'title: ' || {_TITLE} || {_CRLF} || 'languages: ' || regexp_extract(html, '(?i)<html[^>]*lang="([^"]*)"', 1) || {_CRLF}
    || 'source-HTTP/1.1 200 OK' || {_CRLF} || 'source-Content-Type: text/html; charset=utf-8' || {_CRLF} || 'source-Content-Length: ' || strlen(html) || {_CRLF}
    || array_to_string({_LINKS}, '') FROM r),
k AS (SELECT *, sha256(record_type || chr(10) || refers_to) AS h, 'sha256:' || sha256(block) AS block_digest, CAST(strlen(block) AS BIGINT) AS content_length FROM d),
o AS (SELECT *, {_uuid('h')} AS record_id FROM k)
SELECT page_id, record_type, record_id, refers_to, target_uri, payload_digest, block_digest, content_length,
  sha256('WARC/1.1' || {_CRLF} || 'WARC-Type: ' || record_type || {_CRLF} || 'WARC-Record-ID: ' || record_id || {_CRLF} || 'WARC-Date: 2024-01-01T00:00:00Z' || {_CRLF}
    || 'WARC-Target-URI: ' || target_uri || {_CRLF} || 'WARC-Refers-To: ' || refers_to || {_CRLF} || 'WARC-Refers-To-Target-URI: ' || target_uri || {_CRLF}
    || 'WARC-Refers-To-Date: 2024-01-01T00:00:00Z' || {_CRLF} || 'WARC-Payload-Digest: ' || payload_digest || {_CRLF} || 'WARC-Block-Digest: ' || block_digest || {_CRLF}
    || 'Content-Type: ' || ct || {_CRLF} || 'Content-Length: ' || content_length || {_CRLF}) AS header_sha256
FROM o
"""

ORACLES["op2_warc"] = OP2

OP8 = """
WITH RECURSIVE
tab AS (SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
d AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size,
    xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT))),
      lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295) AS text_crc32
  FROM documents, tab),
j AS (
  SELECT id, n, CASE WHEN id < 0 THEN id::HUGEINT + 18446744073709551616 ELSE id::HUGEINT END AS k, -1::BIGINT AS b, 0::BIGINT AS j
  FROM (SELECT DISTINCT coalesce(doc_id, 0) AS id FROM documents), (VALUES (8), (9)) s(n)
  UNION ALL
  SELECT id, n, k2, j, CAST(floor((j + 1) * (2147483648::DOUBLE / (k2 // 8589934592 + 1)::DOUBLE)) AS BIGINT)
  FROM (SELECT *, (k * 2862933555777941757 + 1) % 18446744073709551616 AS k2 FROM j WHERE j < n)),
s AS (SELECT id, CAST(max(b) FILTER (n = 8) AS INT) AS shard, CAST(max(b) FILTER (n = 9) AS INT) AS grown_shard FROM j WHERE j >= n GROUP BY 1)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard
FROM d JOIN s ON s.id = coalesce(d.doc_id, 0)
"""

ORACLES["op8_sharding"] = OP8

_CRC_TABLE = "tab AS (SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i))"


def _crc(x: str) -> str:
    """The CRC-32 of a string's UTF-8 bytes, by the table of ``_CRC_TABLE``."""
    return f"""xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode({x})), '..'), lambda h: CAST('0x' || h AS BIGINT))),
      lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295)"""


OP12 = f"""
WITH RECURSIVE {_CRC_TABLE},
r AS (SELECT id, run, count(*) AS n FROM (SELECT coalesce(doc_id::VARCHAR, '') AS id,
    unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY 1, 2),
h AS (SELECT run, n, {_crc("id || ':' || run")} AS h FROM r, tab WHERE length(run) >= 6),
e AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, n FROM h),
w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM e WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
d AS MATERIALIZED (SELECT word, n, i, substr(word, 1, CAST(i AS INT)) || substr(word, CAST(i AS INT) + 2) AS rest FROM (SELECT *, unnest(range(length(word))) AS i FROM w)),
p AS (SELECT a.word, b.word AS other, b.n FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT d.word, w.word, w.n FROM d JOIN w ON d.rest = w.word UNION SELECT w.word, d.word, d.n FROM d JOIN w ON d.rest = w.word),
k AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS m FROM p GROUP BY 1),
f AS (SELECT word, CASE WHEN m >= 5 * n THEN other END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN m END AS form_n FROM w LEFT JOIN k USING (word)),
c AS (SELECT word, coalesce(form, word) AS root, form IS NOT NULL AS moved FROM f UNION ALL SELECT c.word, f.form, true FROM c JOIN f ON f.word = c.root WHERE moved AND f.form IS NOT NULL),
z AS (SELECT c.word, c.root FROM c JOIN f ON f.word = c.root WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN z USING (word)
"""

ORACLES["op12_variants"] = OP12
