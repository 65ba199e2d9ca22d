"""DuckDB SQL of the corpus queries that SQL can express: whole tables, whole texts."""

from __future__ import annotations

from archloom.llm.quality_rules import BOILERPLATE

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = r"[ \t\n\x0b\x0c\r]+"
#: Words of each document with their places, 1 first.
WORDS = f"""
lists AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACES}'), lambda x: x <> '') AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM lists)"""

DECONTAMINATION = f"""
WITH folded AS (
  SELECT 'd' AS kind, CAST(doc_id AS VARCHAR) AS id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents
  UNION ALL SELECT 'b', CAST(item_id AS VARCHAR), regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark
),
windows AS (
  SELECT DISTINCT id AS item, least(len(ws), 10) AS n, array_to_string(list_slice(ws, s, s + 9), ' ') AS win
  FROM (SELECT id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS s FROM folded WHERE kind = 'b' AND len(ws) > 0)
),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT id, n, s, array_to_string(list_slice(ws, s, s + n - 1), ' ') AS win FROM (SELECT id, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM folded, sizes WHERE kind = 'd' AND len(ws) >= n)),
hits AS (SELECT p.id, p.n, p.s, w.item FROM places p JOIN windows w ON w.n = p.n AND w.win = p.win),
cover AS (SELECT id, count(DISTINCT j) AS n_hit FROM (SELECT id, unnest(range(s, s + n)) AS j FROM hits) GROUP BY id),
items AS (SELECT id, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT id, item FROM hits) GROUP BY id)
SELECT CAST(f.id AS BIGINT) AS doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM folded f LEFT JOIN cover USING (id) LEFT JOIN items USING (id) WHERE kind = 'd'"""

LINES = f"""
WITH split AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT row, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM split),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM lines),
common AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT row) >= 10),
marked AS (SELECT row, doc_id, line, i, key IN (SELECT key FROM common) AS gone FROM keyed)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY row, doc_id"""

NEAR = f"""
WITH RECURSIVE lists AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SPACES}'), lambda x: x <> '') AS ws FROM documents),
shingles AS (SELECT DISTINCT doc_id, md5(array_to_string(list_slice(ws, s, s + 4), ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS s FROM lists WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingles a JOIN shingles b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.y FROM reach JOIN links ON links.x = reach.b),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM least LEFT JOIN sizes USING (doc_id)"""

SUFFIXES = """
WITH raw AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
places AS (SELECT doc_id, s, md5(substr(h, 2 * s - 1, 200)) AS w FROM (SELECT doc_id, h, unnest(range(1, greatest(length(h) // 2 - 98, 1))) AS s FROM raw)),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY w ORDER BY doc_id, s) AS r FROM places) WHERE r > 1),
bytes AS (SELECT doc_id, unnest(range(1, length(h) // 2 + 1)) AS i FROM raw),
marked AS (SELECT b.doc_id, b.i, coalesce(b.i - max(l.s) OVER (PARTITION BY b.doc_id ORDER BY b.i) < 100, false) AS gone FROM bytes b LEFT JOIN later l ON l.doc_id = b.doc_id AND l.s = b.i),
runs AS (SELECT doc_id, i, gone, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS first FROM marked),
sums AS (SELECT r.doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (first) AS n_spans, string_agg(substr(h, 2 * i - 1, 2), '' ORDER BY i) FILTER (NOT gone) AS kept FROM runs r JOIN raw USING (doc_id) GROUP BY r.doc_id)
SELECT raw.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM raw LEFT JOIN sums ON sums.doc_id = raw.doc_id"""

SUBSTRINGS = f"""
WITH {WORDS},
places AS (SELECT doc_id, s, md5(array_to_string(list_slice(ws, s, s + 34), ' ')) AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS s FROM lists WHERE len(ws) >= 35)),
twice AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY w) AS c FROM places) WHERE c > 1),
marked AS (SELECT words.doc_id, w, i, coalesce(i - max(s) OVER (PARTITION BY words.doc_id ORDER BY i) < 35, false) AS gone FROM words LEFT JOIN twice ON twice.doc_id = words.doc_id AND s = i),
sums AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(w, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM marked GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN sums ON sums.doc_id = documents.doc_id"""

QUALITY = f"""
WITH {WORDS},
grams AS (SELECT doc_id, i, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w, w2, w3) AS c FROM grams WHERE w3 IS NOT NULL) WHERE c > 1),
repeated AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, (VALUES (0), (1), (2)) AS t(o) GROUP BY doc_id),
split AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
plain AS (SELECT doc_id, i, line, trim(regexp_replace(line, '[ \\t\\x0b\\x0c\\r]+', ' ', 'g'), ' ') AS p FROM split),
sized AS (SELECT *, lower(p) AS low, CASE WHEN p = '' THEN 0 ELSE length(p) - length(replace(p, ' ', '')) + 1 END AS n FROM plain),
marked AS (
  SELECT doc_id, i, line, n, length(replace(p, ' ', '')) AS chars, n > 0 AND (
    len(regexp_extract_all(p, '[#*$%&<>]{{2,}}|[!?]{{2,}}')) * 5 >= n OR (n >= 3 AND len(regexp_extract_all(p, '(^| )[|>»·•]( |$)')) * 4 >= n)
    OR (n <= 40 AND ({" OR ".join(f"contains(low, '{b.replace("'", "''")}')" for b in BOILERPLATE)}))
  ) AS bad, n > 0 AND n < 4 AND NOT regexp_matches(p, '[[:punct:]…”»。]$') AS short FROM sized
),
judged AS (SELECT doc_id, line, n, chars, bad OR (short AND (lag(short, 1, false) OVER o OR lead(short, 1, false) OVER o)) AS bad FROM marked WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (bad) AS n_failed_lines, coalesce(sum(chars) FILTER (bad), 0) AS lost_chars, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS n_dup_lines FROM judged GROUP BY doc_id),
base AS (
  SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, n_lines, n_failed_lines, CAST(lost_chars AS BIGINT) AS lost_chars
  FROM documents d JOIN lists ON lists.doc_id = d.doc_id JOIN lines ON lines.doc_id = d.doc_id LEFT JOIN repeated r ON r.doc_id = d.doc_id
),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT *, NOT base_failed AND lost_chars * 100 <= word_chars * 50 AS kept FROM failed"""

ORACLES: dict[str, str] = {
    "op2_decontamination": DECONTAMINATION, "op3_line_dedup": LINES, "op7_near_dedup": NEAR, "op8_suffix_dedup": SUFFIXES, "op9_quality_rules": QUALITY, "op10_substring_dedup": SUBSTRINGS,
}
