"""The same results as DuckDB SQL, for the operators that SQL can express."""

SQL = {
    "op2_warc": r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS h FROM p),
g AS (SELECT h, max(page_id) AS target FROM d WHERE n >= 0 GROUP BY h)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(h, ((i // 4) * 5 + 1)::BIGINT, 5))::BIGINT >> (5 * (3 - i % 4))::BIGINT) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id < target THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < target THEN target END AS refers_to
FROM d LEFT JOIN g USING (h)
""",
    "op3_ngram_jaccard": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
classes AS (
  SELECT list_sort(s) AS s, min(doc_id) AS rep, len(any_value(s)) AS n FROM sets WHERE len(s) > 0 GROUP BY 1),
tokens AS (SELECT rep, n, unnest(s) AS t FROM classes),
links AS (
  SELECT a.rep AS a, b.rep AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
  GROUP BY 1, 2 HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
ties AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT rep AS a, rep AS b FROM classes UNION SELECT r.a, e.b FROM reach r JOIN ties e ON r.b = e.a),
component AS (SELECT a AS rep, min(b) AS component_id FROM reach GROUP BY 1)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id
FROM sets s LEFT JOIN (SELECT k.s, c.component_id FROM classes k JOIN component c ON c.rep = k.rep) c ON c.s = list_sort(s.s)
""",
    # One simulation from the first slot to the last; the chunks of the query begin to matter after 1024 slots.
    "op6_mixing": r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '(none)') AS source, md5(doc_id::VARCHAR) AS k FROM documents),
n AS (SELECT source, count(*) AS n, sqrt(count(*)) AS w FROM d GROUP BY source),
q AS (SELECT source, n, greatest(1, round(w / (SELECT sum(w) FROM n) * 1000000000))::BIGINT AS m, row_number() OVER (ORDER BY source) AS i FROM n),
p AS (SELECT list(m ORDER BY i) AS ms, sum(m)::BIGINT AS total, max(ceil((n + 15) // 16 * (SELECT sum(m) FROM q) / m)) AS slots FROM q),
run AS (
  SELECT 0::BIGINT AS slot, list_transform(ms, lambda x: 0::BIGINT) AS done, ms, total, slots, NULL::BIGINT AS pick, NULL::BIGINT AS nth FROM p
  UNION ALL
  SELECT slot + 1, list_transform(done, lambda x, j: CASE WHEN j = best THEN x + 1 ELSE x END), ms, total, slots, best, done[best] FROM (
    SELECT r.*, list_min(list_transform(ms, lambda x, j: CASE WHEN (done[j] * total) // x <= slot THEN (((done[j] + 1) * total + x - 1) // x) * 1000 + j END)) % 1000 AS best FROM run r WHERE slot < slots)),
ranked AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY k, doc_id) - 1 AS r FROM d)
SELECT doc_id, source, r // 16 AS block, run.slot - 1 AS slot, r % 16 AS place
FROM ranked JOIN q USING (source) JOIN run ON run.pick = q.i AND run.nth = r // 16
""",
    "op7_ego_join": r"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
fit AS (SELECT vec_id, e FROM v WHERE vec_id IS NOT NULL AND len(e) = 64 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda x: x * x)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM fit a JOIN fit b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
component AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM v LEFT JOIN n USING (vec_id) LEFT JOIN component USING (vec_id)
""",
    "op9_chat": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(24 + length(role) + length(regexp_replace(text, '<(\|+)', '<|\1', 'g')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
""",
    "op12_merkle": r"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) ORDER BY i) AS crc FROM range(256) r(i)),
d AS (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i,
    sha256(concat(coalesce(strlen(doc_id::VARCHAR)::VARCHAR || ':' || doc_id::VARCHAR, '-'), coalesce(strlen(source)::VARCHAR || ':' || source, '-'), coalesce(strlen(lang)::VARCHAR || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR)::VARCHAR || ':' || n_chars::VARCHAR, '-'), coalesce(strlen(text)::VARCHAR || ':' || text, '-'))) AS leaf,
    sha256(concat(coalesce(strlen(doc_id::VARCHAR)::VARCHAR || ':' || doc_id::VARCHAR, '-'), coalesce(strlen(source)::VARCHAR || ':' || source, '-'), coalesce(strlen(lang)::VARCHAR || ':' || lang, '-'), coalesce(strlen((n_chars + 1)::VARCHAR)::VARCHAR || ':' || (n_chars + 1)::VARCHAR, '-'), coalesce(strlen(text)::VARCHAR || ':' || text, '-'))) AS changed,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(doc_id::VARCHAR) + 1), lambda j: ascii(substr(doc_id::VARCHAR, j, 1))::BIGINT)), lambda c, b: xor(t.crc[(xor(c, b) & 255) + 1], c >> 8)) AS c
  FROM documents CROSS JOIN crc_table t),
nodes AS (
  SELECT lang, 0 AS level, i, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM d
  UNION ALL
  SELECT lang, level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 1) // 2) FROM nodes WHERE n > 1 GROUP BY lang, level, i // 2),
subroots AS (SELECT lang, h, level AS height, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS i FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, i, h, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 1) // 2) FROM tops WHERE n > 1 GROUP BY level, i // 2),
steps AS (
  SELECT d.lang, d.i AS leaf_i, k.level, (d.i >> k.level) % 2 AS is_right, b.h AS beside
  FROM d JOIN (SELECT DISTINCT lang, level FROM nodes WHERE n > 1) k ON d.lang IS NOT DISTINCT FROM k.lang
  LEFT JOIN nodes b ON b.lang IS NOT DISTINCT FROM d.lang AND b.level = k.level AND b.i = xor(d.i >> k.level, 1)
  UNION ALL
  SELECT d.lang, d.i, s.height + k.level, (s.i >> k.level) % 2, b.h
  FROM d JOIN subroots s ON d.lang IS NOT DISTINCT FROM s.lang CROSS JOIN (SELECT DISTINCT level FROM tops WHERE n > 1) k
  LEFT JOIN tops b ON b.level = k.level AND b.i = xor(s.i >> k.level, 1)),
fold AS (
  SELECT lang, i AS leaf_i, 0 AS level, CASE WHEN xor(c, 4294967295) % 7 = 0 THEN changed ELSE leaf END AS h FROM d
  UNION ALL
  SELECT f.lang, f.leaf_i, f.level + 1, sha256(CASE WHEN s.beside IS NULL THEN f.h WHEN s.is_right = 1 THEN s.beside || f.h ELSE f.h || s.beside END)
  FROM fold f JOIN steps s ON f.lang IS NOT DISTINCT FROM s.lang AND f.leaf_i = s.leaf_i AND f.level = s.level),
ends AS (SELECT lang, leaf_i, arg_max(h, level) AS h FROM fold GROUP BY lang, leaf_i),
proofs AS (SELECT lang, leaf_i, sha256(coalesce(string_agg(beside, '' ORDER BY level), '')) AS p FROM steps GROUP BY lang, leaf_i)
SELECT d.doc_id, d.leaf, s.h AS subroot, r.h AS root, coalesce(p.p, sha256('')) AS proof_sha256, e.h AS folded_root, e.h = r.h AS verified
FROM d JOIN subroots s ON d.lang IS NOT DISTINCT FROM s.lang JOIN ends e ON e.lang IS NOT DISTINCT FROM d.lang AND e.leaf_i = d.i
LEFT JOIN proofs p ON p.lang IS NOT DISTINCT FROM d.lang AND p.leaf_i = d.i CROSS JOIN (SELECT h FROM tops WHERE n = 1) r
""",
}
