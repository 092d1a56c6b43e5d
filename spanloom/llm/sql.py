"""DuckDB SQL that states the queries' results independently, where SQL can."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

MIX = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM d GROUP BY source),
r AS (SELECT *, CAST(2 * source_size AS DOUBLE) / weight AS ratio FROM s),
l AS (
  SELECT *, CAST(3 * sum(source_size) OVER () - 4 * coalesce(sum(source_size) OVER b, 0) AS DOUBLE)
            / (2.0::DOUBLE * (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))) AS level
  FROM r WINDOW b AS (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT coalesce(max(CASE WHEN level <= ratio THEN level END), max(ratio)) AS v FROM l),
t AS (SELECT source, source_size, weight, least(2.0::DOUBLE * source_size, weight * v.v) AS target FROM l, v),
q AS (
  SELECT d.doc_id, d.key, d.source, d.size, t.source_size, t.target, t.weight,
         row_number() OVER w AS seat,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source WINDOW w AS (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size)),
u AS (
  SELECT *, greatest(0, least(size, CAST(floor(target) AS BIGINT) - begins)) AS served
  FROM (SELECT q.*, turn, before + turn * source_size AS begins FROM q, (VALUES (0), (1)) AS n(turn))),
x AS (
  SELECT *, 0 AS part, CASE WHEN served > 0 THEN served ELSE size END AS words, 0 AS skipped FROM u
  UNION ALL SELECT *, 1 AS part, size - served AS words, served AS skipped FROM u WHERE served > 0 AND served < size),
p AS (
  SELECT *, sum(words) OVER (ORDER BY (begins + skipped + words) * 10 // weight, source ASC NULLS LAST, turn, key, doc_id, size, part, seat ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - words AS position
  FROM x)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(sum(greatest(0, least(words, (SELECT CAST(sum(source_size) AS BIGINT) * 3 // 2 FROM s) - position))) AS BIGINT) AS taken
FROM p GROUP BY source, seat, doc_id, size, source_size, target
"""

DECONTAMINATE = rf"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0),
bg AS (SELECT DISTINCT item, size, array_to_string(w[i : i + size - 1], ' ') AS gram FROM bi),
sizes AS (SELECT DISTINCT size FROM bg),
di AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM dw, sizes WHERE len(w) >= size),
hits AS (SELECT di.doc_id, di.i, di.size, bg.item FROM di JOIN bg ON bg.size = di.size AND bg.gram = array_to_string(di.w[di.i : di.i + di.size - 1], ' ')),
places AS (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM places GROUP BY doc_id),
owners AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN n ON n.doc_id = dw.doc_id LEFT JOIN owners ON owners.doc_id = dw.doc_id
"""

_CONTROLS = ["[INST]", "[/INST]", "</s>", "<<SYS>>", "<</SYS>>", "<|", "|>", "\\"]
_ESCAPES = " + ".join(f"CAST((length(x) - length(replace(x, '{c}', ''))) / {len(c)} AS BIGINT)" for c in _CONTROLS)

CHAT = f"""
WITH t AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS x FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(role) + 8 + length(x) + {_ESCAPES} + CASE WHEN role = 'user' THEN 15 ELSE 0 END AS size FROM t),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || x || chr(10), '' ORDER BY turn, role, x) AS turns,
         coalesce(string_agg(x, '' ORDER BY turn, role, x) FILTER (WHERE role = 'assistant'), '') AS loss, sum(size) AS size
  FROM e GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, CAST(size AS BIGINT) AS formatted_chars
FROM g
"""

_WORD = r"[^\x20\x09-\x0D]+"
_FURNITURE = "all rights reserved|click here|cookie|enable javascript|javascript|licensed under|log in|lorem ipsum|newsletter|privacy policy|read more|released under|share this|sign in|sign up|subscribe|terms of service|terms of use"

QUALITY = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines
  FROM documents),
g AS (SELECT r, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram, i FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 3)) AS p FROM again) GROUP BY r),
li AS (SELECT r, unnest(lines) AS x FROM d),
bad AS (
  SELECT r, sum(length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g'))) AS lost FROM li
  WHERE len(regexp_extract_all(x, '[#*$%&|<>{{}}\\^~=]')) > 0.1::DOUBLE * length(x)
     OR (len(regexp_extract_all(x, '[!?]+')) > 0.5::DOUBLE * len(regexp_extract_all(x, '{_WORD}')) AND len(regexp_extract_all(x, '{_WORD}')) >= 3)
     OR (len(regexp_extract_all(x, '{_WORD}')) >= 15 AND NOT regexp_matches(x, '[.,;:!?\x{{2026}}\x{{3002}}\x{{FF0C}}\x{{3001}}\x{{FF01}}\x{{FF1F}}\x{{061F}}\x{{060C}}\x{{0964}}]'))
     OR len(regexp_extract_all(x, '[|\x{{00BB}}\x{{203A}}\x{{2022}}]')) >= 3
     OR (length(x) <= 160 AND regexp_matches(x, '(?i){_FURNITURE}'))
  GROUP BY r),
m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
         coalesce(lost, 0) AS lost
  FROM d LEFT JOIN rep ON rep.r = d.r LEFT JOIN bad ON bad.r = d.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND (word_chars = 0 OR CAST(lost AS DOUBLE) / word_chars <= 0.5::DOUBLE) AS kept
FROM m
"""

ORACLES = {"op1_mix_sources": MIX, "op2_decontaminate": DECONTAMINATE, "op9_chat_format": CHAT, "op10_quality_rules": QUALITY}
