"""The operators' results in DuckDB's SQL, for those that SQL can express."""

from __future__ import annotations

from . import decontamination, licenses

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _canonical(x: str) -> str:
    """Words as a list: copyright lines out, a word table, then phrases over pairs of words each in spaces of its own."""
    kept = f"array_to_string(list_filter(string_split({x}, chr(10)), lambda l: NOT regexp_matches(l, {_text(licenses.COPYRIGHT_LINE)})), chr(10))"
    words = f"list_filter(regexp_split_to_array(translate({kept}, '{UPPER}', '{LOWER}'), {_text(licenses.SEPARATORS)}), lambda w: w <> '')"
    table = "MAP {" + ", ".join(f"{_text(a)}: {_text(b)}" for a, b in licenses.WORDS.items()) + "}"
    out = f"' ' || array_to_string(list_transform({words}, lambda w: coalesce({table}[w], w)), '  ') || ' '"
    for other, one in licenses.PHRASES.items():
        out = f"replace({out}, {_text(' ' + other.replace(' ', '  ') + ' ')}, {_text(' ' + one.replace(' ', '  ') + ' ')})"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'), ' ')"


def _licences() -> str:
    known = ", ".join(f"({i}, {_text(name)}, {_text(text)})" for i, (name, text) in enumerate(licenses.CATALOGUE))
    return f"""
WITH known AS (SELECT digest, arg_min(license, i) AS license
    FROM (SELECT i, license, sha256({_canonical('text')}) AS digest FROM (VALUES {known}) k(i, license, text)) GROUP BY digest),
docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT doc_id, sha256({_canonical('line')}) AS digest
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs)),
found AS (SELECT doc_id, array_to_string(list_sort(list(DISTINCT license)), ',') AS notices, count(*) AS n
    FROM lines JOIN known USING (digest) WHERE digest <> sha256('') GROUP BY doc_id),
whole AS (SELECT doc_id, sha256({_canonical('text')}) AS canonical_sha256 FROM docs)
SELECT doc_id, canonical_sha256, CASE WHEN canonical_sha256 <> sha256('') THEN license END AS license_id,
    coalesce(notices, '') AS notices, coalesce(n, 0) AS n_notices
FROM whole LEFT JOIN found USING (doc_id) LEFT JOIN known ON digest = canonical_sha256"""


_WORDS = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_N = decontamination.WINDOW
_DECONTAMINATION = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
windows AS (SELECT DISTINCT item, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS gram
    FROM (SELECT item, ws, least({_N}, len(ws)) AS n, unnest(range(1, len(ws) - least({_N}, len(ws)) + 2)) AS i FROM items WHERE len(ws) > 0)),
docs AS (SELECT doc_id, coalesce({_WORDS}, []) AS ws FROM documents),
grams AS (SELECT doc_id, n, i, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS gram
    FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(ws) >= n)),
found AS (SELECT doc_id, i, n, item FROM grams JOIN windows USING (n, gram)),
hits AS (SELECT doc_id, count(DISTINCT word_at) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS word_at FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM found GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
    sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)"""

_EXACT = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
    sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""

#: CRC-32 by table: the table's entries by eight steps each, then one step a byte.
_SHARDING = """
WITH entries AS (SELECT list(c ORDER BY n) AS crcs FROM (
    SELECT n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT range AS n FROM range(256)))),
docs AS (SELECT doc_id, encode(coalesce(text, '')) AS raw, CAST(doc_id AS VARCHAR) AS k FROM documents),
sums AS (SELECT doc_id, k, octet_length(raw) + 1 AS size, xor(list_reduce([4294967295] || list_transform(range(0, octet_length(raw)),
    lambda i: CAST('0x' || substr(hex(raw), 2 * i + 1, 2) AS BIGINT)), lambda c, b: xor(crcs[1 + (xor(c, b) & 255)], c >> 8)), 4294967295) AS crc
    FROM docs, entries),
draws AS (SELECT doc_id, i, -ln((CAST('0x' || substr(md5(k || ':' || i), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) AS cost
    FROM docs, (SELECT range AS i FROM range(9))),
placed AS (SELECT doc_id, CAST(arg_min(i, cost) FILTER (WHERE i < 8) AS INTEGER) AS shard, CAST(arg_min(i, cost) AS INTEGER) AS grown_shard
    FROM draws GROUP BY doc_id)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'key' AS law, shard,
    row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, grown_shard
FROM sums JOIN placed USING (doc_id)"""

ORACLES: dict[str, str] = {
    "op1_license_scan": _licences(),
    "op2_decontamination": _DECONTAMINATION,
    "op7_exact_dedup": _EXACT,
    "op9_sharding": _SHARDING,
}
