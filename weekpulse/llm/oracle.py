"""The queries that SQL can express, as DuckDB SQL over the same tables.

The other ones: byte substrings (1), the mixture of estimates (2), merges of a BPE vocabulary (4, 7),
keyed permutations (8) and hashed n-grams (10) are tested against plain versions in ``tests/llm``.
"""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
WORD = r"[^\x20\x09-\x0D]+"
ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(text: str) -> str:
    return f"translate({text}, '{UPPER}', '{LOWER}')"


LINE_DEDUP = f"""
WITH d AS (SELECT doc_id, str_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, u.pos, ls[u.pos] AS line FROM d, unnest(range(1, len(ls) + 1)) AS u(pos)),
k AS (SELECT *, {lower(f"trim(line, {SPACES})")} AS key FROM l),
s AS (
  SELECT key, min(doc_id) AS first_id FROM k WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
),
m AS (SELECT k.*, s.first_id IS NOT NULL AND s.first_id <> doc_id AS gone FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

NEAR_DEDUP = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({lower("coalesce(text, '')")}, '{WORD}') AS ws FROM documents
),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[u.pos : u.pos + 4], ' ') AS shingle
  FROM w, unnest(range(1, greatest(len(ws) - 3, 2))) AS u(pos) WHERE len(ws) > 0
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
),
e AS (
  SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * common >= 75 * (x.n + y.n - common)
),
r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a),
f AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT f.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, f.doc_id = component_id AS kept
FROM f LEFT JOIN n ON f.doc_id = n.doc_id
"""

DECONTAMINATION = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({lower("coalesce(text, '')")}, '{ITEM_WORD}') AS ws FROM documents
),
i AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all({lower("coalesce(text, '')")}, '{ITEM_WORD}') AS ws FROM benchmark
),
iw AS (
  SELECT DISTINCT item, least(len(ws), 10) AS size, array_to_string(ws[u.pos : u.pos + 9], ' ') AS win
  FROM i, unnest(range(1, greatest(len(ws) - 8, 2))) AS u(pos) WHERE len(ws) > 0
),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (
  SELECT doc_id, u.pos, size, array_to_string(ws[u.pos : u.pos + size - 1], ' ') AS win
  FROM d, sizes, unnest(range(1, len(ws) - size + 2)) AS u(pos)
),
h AS (SELECT doc_id, pos, dw.size, item FROM dw JOIN iw ON dw.win = iw.win AND dw.size = iw.size),
p AS (SELECT doc_id, count(DISTINCT pos + v.k) AS n_hit FROM h, unnest(range(0, size)) AS v(k) GROUP BY doc_id),
q AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN q ON q.doc_id = d.doc_id
"""

RATE_NAMES = ("word_length", "symbol_rate", "dup_line_rate", "repeat_rate")
# Spreads times the quartile distance, and the slack of each rate.
REACH = {"word_length": 150, "symbol_rate": 20, "dup_line_rate": 50, "repeat_rate": 20}


def limits(keys: str, name: str) -> str:
    """A group's limits by rate, from its merged histogram."""
    by = f"{keys}, " if keys else ""
    return f"""
{name} AS (
  SELECT {by}name, max(total) AS total,
         min(value) FILTER (100 * below >= CASE name WHEN 'word_length' THEN 25 ELSE 90 END * total) AS q1,
         min(value) FILTER (100 * below >= CASE name WHEN 'word_length' THEN 75 ELSE 99 END * total) AS q3
  FROM (
    SELECT {by}name, value, sum(n) OVER (PARTITION BY {by}name ORDER BY value) AS below,
           sum(n) OVER (PARTITION BY {by}name) AS total
    FROM (SELECT {by}name, value, sum(n) AS n FROM cells GROUP BY ALL)
  ) GROUP BY {by}name
)"""


FAILED = " ".join(
    f"WHEN '{name}' THEN r.value > l.q3 + {4 if name == 'word_length' else 1} * (l.q3 - l.q1) + {slack}"
    + (f" OR r.value < l.q1 - 4 * (l.q3 - l.q1) - {slack}" if name == "word_length" else "")
    for name, slack in REACH.items()
)

QUALITY = f"""
WITH t AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws,
         list_filter(str_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls
  FROM documents
),
win AS (
  SELECT doc_id, u.pos, array_to_string(ws[u.pos : u.pos + 4], ' ') AS g
  FROM t, unnest(range(1, len(ws) - 3)) AS u(pos)
),
rep AS (
  SELECT doc_id, count(DISTINCT pos + v.k) AS n
  FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS times FROM win), unnest(range(0, 5)) AS v(k)
  WHERE times > 1 GROUP BY doc_id
),
f AS (
  SELECT t.doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM t LEFT JOIN rep ON rep.doc_id = t.doc_id
),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f),
rates AS (
  SELECT doc_id, lang, source, base_failed, 'word_length' AS name, 100 * word_chars // greatest(n_words, 1) AS value FROM b
  UNION ALL SELECT doc_id, lang, source, base_failed, 'symbol_rate', 1000 * n_symbols // greatest(n_words, 1) FROM b
  UNION ALL SELECT doc_id, lang, source, base_failed, 'dup_line_rate', 1000 * n_dup_lines // greatest(n_lines, 1) FROM b
  UNION ALL SELECT doc_id, lang, source, base_failed, 'repeat_rate', 1000 * n_repeat_words // greatest(n_words, 1) FROM b
),
cells AS (
  SELECT lang, source, name, value - value % (1::BIGINT << greatest(length(bin(value)) - 6, 0)::BIGINT) AS value, count(*) AS n
  FROM rates WHERE NOT base_failed GROUP BY ALL
),{limits("lang, source", "by_source")},{limits("lang", "by_lang")},{limits("", "overall")},
l AS (
  SELECT s.lang, s.source, s.name,
         CASE WHEN s.total >= 100 THEN s.q1 WHEN g.total >= 100 THEN g.q1 ELSE o.q1 END AS q1,
         CASE WHEN s.total >= 100 THEN s.q3 WHEN g.total >= 100 THEN g.q3 ELSE o.q3 END AS q3
  FROM by_source s JOIN by_lang g ON s.lang IS NOT DISTINCT FROM g.lang AND s.name = g.name JOIN overall o ON s.name = o.name
),
v AS (
  SELECT r.doc_id, r.name, coalesce(CASE r.name {FAILED} END, false) AS failed
  FROM rates r LEFT JOIN l ON r.lang IS NOT DISTINCT FROM l.lang AND r.source IS NOT DISTINCT FROM l.source AND r.name = l.name
),
x AS (
  SELECT doc_id, coalesce(string_agg(name, ',' ORDER BY list_position([{", ".join(f"'{n}'" for n in RATE_NAMES)}], name)) FILTER (failed), '') AS names
  FROM v GROUP BY doc_id
)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND names = '' AS kept,
       CASE WHEN base_failed AND names <> '' THEN 'base,' || names WHEN base_failed THEN 'base' ELSE names END AS failed
FROM b JOIN x ON b.doc_id = x.doc_id
"""

COLLOCATIONS = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM lists GROUP BY lang),
grams AS (
  SELECT lang, w[u.pos : u.pos + k.k - 1] AS w, k.k, count(*) AS a
  FROM lists, (VALUES (1), (2), (3), (4)) k(k), unnest(range(1, len(w) - k.k + 2)) AS u(pos)
  GROUP BY ALL HAVING count(*) >= 30
),
cuts AS (
  SELECT g.lang, g.w, g.k, g.a, f.a AS l, r.a AS r, 2000000::HUGEINT * g.a // (f.a + r.a) AS score, c.cut
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM grams) c
  JOIN grams g ON g.lang = c.lang AND g.w = c.w
  JOIN grams f ON f.lang = g.lang AND f.w = g.w[1 : c.cut]
  JOIN grams r ON r.lang = g.lang AND r.w = g.w[c.cut + 1 :]
),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, cut) = 1),
inside AS (
  SELECT lang, w[v.pos : v.pos + m.m - 1] AS w, a, (m.m = k - 1 AND v.pos = 2)::INT AS left1, (m.m = k - 1 AND v.pos = 1)::INT AS right1
  FROM grams, (VALUES (2), (3)) m(m), unnest(range(1, k - m.m + 2)) AS v(pos)
  WHERE m.m < k
),
longer AS (SELECT lang, w, max(a) AS most, sum(left1) AS n_left, sum(right1) AS n_right FROM inside GROUP BY ALL),
kept AS (
  SELECT c.lang, array_to_string(c.w, ' ') AS phrase, c.a, c.l, c.r, c.score, coalesce(n_left, 0) AS n_left, coalesce(n_right, 0) AS n_right
  FROM lowest c LEFT JOIN longer o ON o.lang = c.lang AND o.w = c.w
  WHERE most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * c.a
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, rank, phrase, a, l, r, n, score::BIGINT AS score, n_left::BIGINT AS n_left, n_right::BIGINT AS n_right
FROM ranked r JOIN totals t ON t.lang = r.lang
WHERE rank <= 2000
"""

ORACLE = {
    "op3_line_dedup": LINE_DEDUP,
    "op5_near_dedup": NEAR_DEDUP,
    "op6_decontamination": DECONTAMINATION,
    "op9_quality_rules": QUALITY,
    "op11_collocations": COLLOCATIONS,
}
