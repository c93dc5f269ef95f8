"""DuckDB SQL for the corpus queries that SQL can express (same columns as the queries)."""

from __future__ import annotations

BLANK = r"[\x20\x09-\x0D]"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = """
WITH records AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages),
groups AS (
  SELECT payload, max(page_id) AS holder FROM records WHERE strlen(payload) >= 1000 GROUP BY payload)
SELECT page_id, CAST(strlen(r.payload) AS BIGINT) AS payload_bytes, sha1(r.payload) AS payload_digest,
       CASE WHEN holder <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN holder <> page_id THEN holder END AS refers_to
FROM records r LEFT JOIN groups g ON r.payload = g.payload"""

OP3 = rf"""
WITH texts AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '{BLANK}', '', 'g') AS plain FROM documents),
grouped AS (
  SELECT doc_id, plain, count(*) OVER (PARTITION BY plain) AS group_size,
         first_value(doc_id) OVER (PARTITION BY plain ORDER BY points DESC, doc_id) AS keep_id FROM texts)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(plain) AS text_sha256 FROM grouped"""

OP5 = rf"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE
           WHEN len(w) >= 4 THEN [array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)]
           WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM texts),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
  FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * common >= 80 * (p.n + q.n - common)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a),
components AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT c.doc_id, coalesce(n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept
FROM components c LEFT JOIN sizes s ON s.doc_id = c.doc_id"""

OP6 = """
WITH vectors AS (
  SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(CAST(x AS DOUBLE))]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id, score
FROM scored
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10"""

OP9 = rf"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM split),
keyed AS (
  SELECT doc_id, pos, line,
         {LOWER.format(f"regexp_replace(line, '^{BLANK}+|{BLANK}+$', '', 'g')")} AS k FROM lines),
shared AS (
  SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
marked AS (
  SELECT keyed.*, shared.k IS NOT NULL AS gone FROM keyed LEFT JOIN shared ON keyed.k = shared.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

OP12 = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, [CAST(x AS DOUBLE) for x in embedding] AS v,
         embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
         AND len([x for x in embedding if x <> 0]) > 0 AS usable FROM embeddings),
links AS (
  SELECT p.vec_id AS a, q.vec_id AS b
  FROM (FROM vectors WHERE usable) p JOIN (FROM vectors WHERE usable) q ON p.vec_id <> q.vec_id
  WHERE list_cosine_similarity(p.v, q.v) >= 0.9),
reach(vec_id, other) AS (
  SELECT vec_id, vec_id FROM vectors
  UNION
  SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a),
components AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
degrees AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM components LEFT JOIN degrees ON a = vec_id"""

# The hash of document and run is CRC-32 over the UTF-8 bytes, by its usual table.
OP11 = rf"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(
           range(8), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS steps),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), 'null') AS doc,
         unnest(regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
counted AS (SELECT doc, run, count(*) AS n FROM runs GROUP BY ALL),
bytes AS (
  SELECT run, n, hex(encode(doc || ':' || run)) AS x FROM counted),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(
           list_transform(range(CAST(length(x) // 2 AS BIGINT)), lambda i: CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT)),
           lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT))) AS h
  FROM bytes, crc),
words AS (
  SELECT CASE WHEN h % 97 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word,
         CAST(sum(n) AS BIGINT) AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3),
gaps AS (
  SELECT word, n, i, word[:i] || word[i + 2:] AS rest
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT DISTINCT a.word, b.word AS other, b.n
  FROM gaps a JOIN gaps b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT g.word, w.word, w.n FROM gaps g JOIN words w ON g.rest = w.word
  UNION SELECT w.word, g.word, g.n FROM gaps g JOIN words w ON g.rest = w.word),
best AS (
  SELECT word, count(*) AS n_near, max(n) AS top, arg_min(other, (-n, other)) AS other FROM near GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
         CASE WHEN top >= 2 * w.n THEN other END AS form, CASE WHEN top >= 2 * w.n THEN top END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word),
chain(word, top) AS (
  SELECT word, word FROM forms
  UNION
  SELECT c.word, f.form FROM chain c JOIN forms f ON c.top = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.top AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN chain c ON c.word = f.word JOIN forms r ON r.word = c.top AND r.form IS NULL"""

OP13 = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array({LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) AS phrase
  FROM words, (SELECT unnest([1, 2, 3, 4]) AS k)),
counts AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1 AND f >= 30),
inside AS (
  SELECT lang, a, unnest(flatten([[array_to_string(w[i:i + j - 1], ' ') for i in range(1, k - j + 2)]
                                  for j in range(2, k)])) AS phrase FROM candidates WHERE k > 2),
longer AS (SELECT lang, phrase, max(a) AS most FROM inside GROUP BY ALL),
cuts AS (
  SELECT lang, phrase, a, cut, array_to_string(w[:cut], ' ') AS head, array_to_string(w[cut + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates)),
scored AS (
  SELECT c.lang, c.phrase, a, l.f AS l, r.f AS r, CAST(CAST(a AS HUGEINT) * 2000000 // (l.f + r.f) AS BIGINT) AS score
  FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = head
              JOIN counts r ON r.lang = c.lang AND r.phrase = rest
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, cut) = 1),
kept AS (
  SELECT s.* FROM scored s LEFT JOIN longer g ON g.lang = s.lang AND g.phrase = s.phrase
  WHERE most IS NULL OR 100 * CAST(most AS HUGEINT) < 80 * CAST(a AS HUGEINT))
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank,
       phrase, a, l, r, n, score
FROM kept k JOIN totals t ON t.lang = k.lang
QUALIFY row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) <= 2000"""

ORACLES = {
    "op2_warc": OP2,
    "op3_exact_dedup": OP3,
    "op5_minhash_near_dedup": OP5,
    "op6_topk": OP6,
    "op9_line_dedup": OP9,
    "op11_spelling": OP11,
    "op12_embedding_near_dedup": OP12,
    "op13_collocations": OP13,
}
