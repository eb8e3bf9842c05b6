"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op1_chat_formatting"] = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
t AS (
  SELECT *, role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS opens,
    length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) AS own,
    length(replace(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g'), chr(10), '<|im_nl|>')) AS head
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(own + CASE WHEN opens THEN 12 + head + 1 + 10 + 1 ELSE 11 END) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

ORACLES["op3_benchmark_decontamination"] = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[p:p + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS p FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
h AS (SELECT doc_id, p, dw.n, item FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n),
hw AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""

ORACLES["op4_line_dedup"] = r"""
WITH l AS (
  SELECT doc_id, t.i AS raw, t.x AS line, regexp_matches(t.x, '[^\x20\x09-\x0D]') AS solid
  FROM (SELECT doc_id, unnest(list_zip(range(len(string_split(coalesce(text, ''), chr(10)))), string_split(coalesce(text, ''), chr(10)))) AS z FROM documents),
  LATERAL (SELECT z[1] AS i, z[2] AS x) t),
s AS (SELECT doc_id, raw, line, row_number() OVER (PARTITION BY doc_id ORDER BY raw) - 1 AS n, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM l WHERE solid),
w AS (SELECT doc_id, n, 1 AS m, words, row_number() OVER (PARTITION BY line ORDER BY doc_id, n) AS k FROM s
  UNION ALL SELECT a.doc_id, a.n, 2, a.words + b.words, row_number() OVER (PARTITION BY a.line, b.line ORDER BY a.doc_id, a.n) FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.n = a.n + 1
  UNION ALL SELECT a.doc_id, a.n, 3, 51, row_number() OVER (PARTITION BY a.line, b.line, c.line ORDER BY a.doc_id, a.n) FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.n = a.n + 1 JOIN s c ON a.doc_id = c.doc_id AND c.n = a.n + 2),
bad AS (SELECT DISTINCT doc_id, unnest(range(n, n + m)) AS n FROM w WHERE k > 1 AND words > 50),
pair AS (SELECT a.doc_id, b.doc_id AS other, a.n, a.n - b.n AS diagonal, a.n - row_number() OVER (PARTITION BY a.doc_id, b.doc_id, a.n - b.n ORDER BY a.n) AS island
  FROM s a JOIN s b ON a.line = b.line AND (b.doc_id < a.doc_id OR b.doc_id = a.doc_id AND b.n < a.n)),
long AS (SELECT doc_id, max(c) AS longest FROM (SELECT doc_id, count(*) AS c FROM pair GROUP BY doc_id, other, diagonal, island) GROUP BY doc_id),
run AS (SELECT doc_id, min(n) AS n0, max(n) AS n1 FROM (SELECT doc_id, n, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS g FROM bad) GROUP BY doc_id, g),
gone AS (SELECT r.doc_id, a.raw AS raw0, b.raw AS raw1 FROM run r JOIN s a ON a.doc_id = r.doc_id AND a.n = r.n0 JOIN s b ON b.doc_id = r.doc_id AND b.n = r.n1),
stay AS (SELECT l.doc_id, raw, line FROM l WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = l.doc_id AND l.raw BETWEEN g.raw0 AND g.raw1)),
text AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY raw) AS t FROM stay GROUP BY doc_id)
SELECT d.doc_id, coalesce((SELECT count(*) FROM s WHERE s.doc_id = d.doc_id), 0) AS n_lines,
  coalesce((SELECT count(*) FROM bad WHERE bad.doc_id = d.doc_id), 0) AS n_removed,
  coalesce((SELECT count(*) FROM run WHERE run.doc_id = d.doc_id), 0) AS n_runs, coalesce((SELECT longest FROM long WHERE long.doc_id = d.doc_id), 0) AS longest_run,
  sha256(coalesce(t, '')) AS kept_sha256
FROM documents d LEFT JOIN text USING (doc_id)
"""

#: Base counts of the quality rules, then the divergence from the language's references.
ORACLES["op2_quality_rules"] = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, p, array_to_string(w[p:p + 7], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS p FROM d WHERE len(w) >= 8)),
rep AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + 8)) AS q FROM (
    SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS k FROM g) WHERE k > 1) GROUP BY doc_id),
base AS (SELECT doc_id, lang, text, w, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id)),
v AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(w) AS word FROM d) GROUP BY ALL),
tot AS (SELECT lang, sum(n) AS n_all FROM v GROUP BY lang),
top AS (SELECT lang, word, n / n_all AS p FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS r FROM v) JOIN tot USING (lang) WHERE r <= 32),
wc AS (SELECT doc_id, lang, word, count(*) AS c FROM (SELECT doc_id, lang, unnest(w) AS word FROM d) SEMI JOIN top USING (lang, word) GROUP BY ALL),
wq AS (SELECT b.doc_id, top.p, coalesce(wc.c, 0) / b.n_words AS q FROM base b JOIN top ON top.lang = b.lang AND b.n_words > 0
    LEFT JOIN wc ON wc.doc_id = b.doc_id AND wc.word = top.word),
wall AS (SELECT doc_id, p, q FROM wq UNION ALL SELECT doc_id, 1 - sum(p), greatest(0, 1 - sum(q)) FROM wq GROUP BY doc_id),
chars AS (SELECT doc_id, lang, x.k, x.c FROM (SELECT doc_id, lang, array_to_string(w, '') AS s FROM base), LATERAL (
    SELECT unnest([1, 2, 3, 4, 5, 6]) AS k, unnest([
      length(regexp_replace(s, '[^\p{Ll}]+', '', 'g')), length(regexp_replace(s, '[^\p{L}]+|\p{Ll}+', '', 'g')), length(regexp_replace(s, '[^\p{Nd}]+', '', 'g')),
      length(regexp_replace(s, '[^.,;:!?''"()\-]+', '', 'g')), length(regexp_replace(s, '[^#*$%&|<>]+', '', 'g')),
      length(regexp_replace(s, '[\p{L}\p{Nd}.,;:!?''"()\-#*$%&|<>]+', '', 'g'))]) AS c) x),
cref AS (SELECT lang, k, sum(c) / sum(sum(c)) OVER (PARTITION BY lang) AS p FROM chars GROUP BY lang, k),
call AS (SELECT doc_id, cref.p, c / sum(c) OVER (PARTITION BY doc_id) AS q FROM chars JOIN cref USING (lang, k)),
js AS (SELECT doc_id, src, sqrt(greatest(0, sum(coalesce(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) END, 0) + coalesce(CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) END, 0)) / 2)) AS js
  FROM (SELECT *, 'w' AS src FROM wall UNION ALL SELECT *, 'c' FROM call) GROUP BY doc_id, src),
bad AS (SELECT doc_id FROM js WHERE (src = 'w' AND js > 0.42) OR (src = 'c' AND js > 0.30) GROUP BY doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words, f AS base_failed,
  NOT f AND NOT (n_words >= 50 AND n_all >= 1000 AND doc_id IN (SELECT doc_id FROM bad)) AS kept
FROM (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS f FROM base) JOIN (SELECT DISTINCT doc_id FROM documents) USING (doc_id)
  LEFT JOIN tot USING (lang)
"""

#: Levels of each language's tree, then of the tree over them; a step of a path is N (alone), or L or R with the sibling on that side.
ORACLES["op13_merkle_manifest"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, v || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || t AS whole, v || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || t AS changed, bad
  FROM (SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS v, coalesce(strlen(text) || ':' || text, '-') AS t,
    xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
      lambda a, b: xor(xor(a, b) >> 1, CASE WHEN xor(a, b) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295) % 7 = 0 AS bad FROM documents)),
leaf AS (SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, sha256(whole)) - 1 AS place,
  count(*) OVER (PARTITION BY lang) AS n, sha256(whole) AS h, CASE WHEN coalesce(bad, false) THEN sha256(changed) ELSE sha256(whole) END AS told FROM d),
node(tree, level, place, n, h) AS (
  SELECT tree, 0, place, n, h FROM leaf
  UNION ALL SELECT tree, any_value(level) + 1, place // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY place)) FROM node WHERE n > 1 GROUP BY tree, place // 2),
sub AS (SELECT tree, h FROM node WHERE n = 1),
top(level, place, n, h) AS (
  SELECT 0, tree, count(*) OVER (), h FROM sub
  UNION ALL SELECT any_value(level) + 1, place // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY place)) FROM top WHERE n > 1 GROUP BY place // 2),
step AS (
  SELECT l.tree, l.place, 0 AS part, a.level, CASE WHEN b.h IS NULL THEN 'N' WHEN b.place < a.place THEN 'L' || b.h ELSE 'R' || b.h END AS s
  FROM leaf l JOIN node a ON a.tree = l.tree AND a.n > 1 AND a.place = l.place >> a.level LEFT JOIN node b ON b.tree = a.tree AND b.level = a.level AND b.place = xor(a.place, 1)
  UNION ALL
  SELECT l.tree, l.place, 1, a.level, CASE WHEN b.h IS NULL THEN 'N' WHEN b.place < a.place THEN 'L' || b.h ELSE 'R' || b.h END
  FROM leaf l JOIN top a ON a.n > 1 AND a.place = l.tree >> a.level LEFT JOIN top b ON b.level = a.level AND b.place = xor(a.place, 1)),
path AS (SELECT tree, place, list(s ORDER BY part, level) AS steps FROM step GROUP BY tree, place),
done AS (SELECT l.*, sub.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root, coalesce(steps, []) AS steps FROM leaf l JOIN sub USING (tree) LEFT JOIN path USING (tree, place))
SELECT doc_id, h AS leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda s: s[2:]), '')) AS proof_sha256, f AS folded_root, f = root AS verified
FROM (SELECT *, list_reduce(list_concat([told], steps), lambda a, s: CASE s[1] WHEN 'L' THEN sha256(s[2:] || a) WHEN 'R' THEN sha256(a || s[2:]) ELSE sha256(a) END) AS f FROM done)
"""

ORACLES["op11_ranked_search"] = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term FROM benchmark),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY ALL),
wt AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term, n_docs),
sc AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score FROM p JOIN wt USING (term) JOIN i USING (term), s GROUP BY item_id, doc_id)
SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM sc WHERE score > 0) WHERE r <= 10
"""
