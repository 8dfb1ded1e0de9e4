"""DuckDB statements for those text queries that SQL can express."""

from __future__ import annotations

from . import licenses
from .common import LOWER, UPPER, WORD_PATTERN

WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD_PATTERN}')"

_BASE = [t for t in licenses.TEMPLATES if t.base]
_OTHER = [t for t in licenses.TEMPLATES if not t.base]


def _starts(t: licenses.Template) -> str:
    """The places of a name phrase in the list w."""
    words = licenses.parse(t.markup)
    return "list_filter(range(len(w)), lambda i: " + " AND ".join(f"w[i + {k + 1}] = '{x.decode()}'" for k, x in enumerate(words)) + ")"


#: crc32 of a list of byte values, by the usual table of the reversed polynomial.
_CRC_TABLE = "(SELECT list(v ORDER BY i) FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM (SELECT unnest(range(256)) AS i)))"

ORACLES = {
    "op10_sharding": f"""
WITH t AS (SELECT {_CRC_TABLE} AS crc_table),
d AS (SELECT doc_id, source, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, md5('0:' || CAST(doc_id AS VARCHAR)) AS k,
  list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS b FROM documents),
c AS (SELECT doc_id, source, size, k, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda a, x: xor(a // 256, crc_table[xor(a % 256, x) + 1])), 4294967295) AS text_crc32 FROM d, t),
r AS (SELECT *, CAST(2 * row_number() OVER (PARTITION BY source ORDER BY k, doc_id) - 1 AS DOUBLE) / CAST(2 * count(*) OVER (PARTITION BY source) AS DOUBLE) AS f FROM c),
p AS (SELECT *, row_number() OVER (ORDER BY f, source NULLS FIRST, k, doc_id) - 1 AS place, count(*) OVER () AS n FROM r)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(place * 8 // n AS INTEGER) AS shard, CAST(place - ((place * 8 // n) * n + 7) // 8 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM p
""",
    "op1_license_scan": f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n_words, list_transform(w, lambda x: x || ' ') AS spaced, {", ".join(f'{_starts(t)} AS s_{t.label}' for t in _BASE)} FROM d),
q AS (SELECT *, flatten([{", ".join(f's_{t.label}' for t in _BASE)}]) AS starts,
  list_filter([{", ".join(f"CASE WHEN len(s_{t.label}) > 0 THEN '{t.label}' END" for t in _BASE)}], lambda x: x IS NOT NULL) AS b,
  list_filter([{", ".join(f"CASE WHEN regexp_matches(array_to_string(spaced, ''), '{licenses.pattern(t.markup)}') THEN '{t.label}' END" for t in _OTHER)}], lambda x: x IS NOT NULL) AS o FROM p)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(starts) AS BIGINT) AS n_base, CAST(list_min(starts) AS BIGINT) AS first_word, CAST(list_max(starts) AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(b), ','), '') AS base_labels, coalesce(array_to_string(list_sort(list_concat(b, o)), ','), '') AS labels,
  CASE WHEN len(o) > 0 THEN 1.0 WHEN len(b) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM q
""",
    "op2_neardup": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS shingle FROM d, LATERAL (SELECT unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 85 * (x.n + y.n - n_both)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
low AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN low USING (doc_id)
""",
    "op9_decontam": f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
b AS (SELECT item_id, {WORDS} AS w FROM benchmark),
sized AS (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS window_text FROM sized, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)),
sizes AS (SELECT DISTINCT n FROM windows),
spots AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS window_text FROM d, sizes, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)),
hits AS (SELECT doc_id, item_id, s.n, i FROM spots s JOIN windows v ON s.window_text = v.window_text AND s.n = v.n),
marked AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_text, ',' ORDER BY item_text) AS listed FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_text FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marked USING (doc_id) LEFT JOIN items USING (doc_id)
""",
}
