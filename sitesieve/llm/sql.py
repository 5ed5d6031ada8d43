"""DuckDB SQL with the results of the queries it can express."""

_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    "'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)

# Benchmark windows and every document stretch of a window's length, met by their words.
CONTAMINATION_CTES = f"""
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, list_slice(w, s, s + 12) AS words
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS s FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(words) AS n FROM windows),
docs AS (SELECT *, {_WORDS} AS w FROM %s),
stretches AS (
  SELECT doc_id, s, n, list_slice(w, s, s + n - 1) AS words
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM docs, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, s, n, item_id FROM stretches JOIN windows USING (words)),
places AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM hits))
  GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id),
judged AS (
  SELECT docs.*, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(ids, '') AS ids,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
  FROM docs LEFT JOIN places USING (doc_id) LEFT JOIN hit_items USING (doc_id))
"""

DECONTAMINATE = "WITH " + CONTAMINATION_CTES % "documents" + """
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_hit AS BIGINT) AS n_hit,
  CAST(n_items AS BIGINT) AS n_items, sha256(ids) AS items_sha256, contaminated
FROM judged
"""

# Sources in the order of limit over weight: the first ones, as long as their share is above, are at their limit.
MIXING = r"""
WITH docs AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5(concat_ws(':', 'mix', coalesce(CAST(doc_id AS VARCHAR), ''), md5(coalesce(text, '')))), 1, 13) AS BIGINT)
      / 4503599627370496.0::DOUBLE AS draw
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS HUGEINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM docs GROUP BY source),
behind AS (
  SELECT *, 3 * source_size AS most, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER earlier, 0) AS words,
    sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0) AS weights
  FROM sources WINDOW earlier AS (
    ORDER BY 3 * source_size * (6 // weight), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
judged AS (SELECT *, words * weight > most * weights AS above FROM behind),
level AS (
  SELECT sum(source_size) - coalesce(sum(most) FILTER (WHERE above), 0) AS words,
    sum(weight) - coalesce(sum(weight) FILTER (WHERE above), 0) AS weights FROM judged),
targets AS (
  SELECT source, source_size, CASE WHEN above THEN most::DOUBLE
    ELSE (level.words * weight)::DOUBLE / level.weights::DOUBLE END AS target
  FROM judged, level),
rated AS (
  SELECT docs.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0 END AS rate
  FROM docs JOIN targets ON docs.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
  CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rated
"""

_CRC32 = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(%s, ''), lambda x: ord(x)::BIGINT)),
    lambda a, b: list_reduce(list_concat([xor(a, b)], [0::BIGINT, 1, 2, 3, 4, 5, 6, 7]),
    lambda c, k: xor(c >> 1, 3988292384::BIGINT * (c & 1)))), 4294967295::BIGINT)"""

# Places: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. The least (cost, audit) of every place is
# carried from row to row; before each row and at the end up to two rows are inserted.
REPAIR = rf"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_CRC32 % "concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' '))"} % 20 AS fault
  FROM conversations),
ids AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id NULLS FIRST) AS c FROM (SELECT DISTINCT conv_id FROM keyed)),
after_damage AS (
  SELECT ids.c, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN fault = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM keyed JOIN ids ON keyed.conv_id IS NOT DISTINCT FROM ids.conv_id WHERE fault <> 0),
placed AS (
  SELECT c, turn, role, text, left(role, 1) AS letter, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown,
    row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, copy) AS i
  FROM after_damage),
faulty AS (
  SELECT *, CASE WHEN shown = '' THEN 1 WHEN i > min(i) OVER (PARTITION BY c, role, text) THEN 2 WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
    lag(letter) OVER (PARTITION BY c ORDER BY i) AS before
  FROM placed),
counts AS (
  SELECT c, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate,
    count(*) FILTER (WHERE fault = 3) AS truncated,
    count(*) FILTER (WHERE i > 1 AND before || letter NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY c),
inserts(place, later, cost, letters, made) AS (
  VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []),
    (0, 2, 2, 'I', ['user:']), (1, 2, 2, 'I', ['user:']), (2, 3, 2, 'I', ['assistant:']), (3, 2, 2, 'I', ['user:']),
    (0, 3, 4, 'II', ['user:', 'assistant:']), (1, 3, 4, 'II', ['user:', 'assistant:']), (3, 3, 4, 'II', ['user:', 'assistant:'])),
edits AS MATERIALIZED (
  SELECT c, i, p AS place, e.edit, e.later, e.cost, e.made
  FROM faulty, (VALUES (0), (1), (2), (3)) places(p), unnest([
    {{'edit': 'D', 'later': p, 'cost': 3, 'made': []::VARCHAR[]}},
    CASE WHEN fault IN (0, 3) THEN {{'edit': 'R', 'later': CASE p WHEN 2 THEN 3 ELSE 2 END, 'cost': CASE fault WHEN 3 THEN 3 ELSE 2 END,
      'made': [CASE p WHEN 2 THEN 'assistant:' ELSE 'user:' END || text]}} END,
    CASE WHEN fault IN (0, 3) AND ((p = 0 AND letter = 's') OR (p <> 2 AND letter = 'u') OR (p = 2 AND letter = 'a'))
      THEN {{'edit': 'K', 'later': CASE letter WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, 'cost': CASE fault WHEN 3 THEN 1 ELSE 0 END,
      'made': [role || ':' || text]}} END]) AS choices(e)
  WHERE e IS NOT NULL),
ways AS (
  SELECT c, 0::BIGINT AS i, 0 AS place, {{'cost': 0, 'audit': '', 'made': []::VARCHAR[]}} AS best FROM ids
  UNION ALL
  SELECT w.c, w.i + 1, e.later, min({{'cost': w.best.cost + n.cost + e.cost, 'audit': w.best.audit || n.letters || e.edit,
    'made': list_concat(list_concat(w.best.made, n.made), e.made)}})
  FROM ways w JOIN inserts n ON n.place = w.place JOIN edits e ON e.c = w.c AND e.i = w.i + 1 AND e.place = n.later
  GROUP BY w.c, w.i, e.later),
ends AS (
  SELECT w.c, min({{'cost': w.best.cost + n.cost, 'audit': w.best.audit || n.letters, 'made': list_concat(w.best.made, n.made)}}) AS best
  FROM ways w LEFT JOIN counts USING (c) JOIN inserts n ON n.place = w.place AND n.later IN (0, 3)
  WHERE w.i = coalesce(counts.n, 0) GROUP BY w.c)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(best.cost AS BIGINT) AS cost, best.audit AS audit,
  sha256(array_to_string(best.made, chr(10))) AS repaired_sha256
FROM ids LEFT JOIN counts USING (c) JOIN ends USING (c)
"""
