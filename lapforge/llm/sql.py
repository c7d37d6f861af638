"""DuckDB SQL for the registered queries that SQL can express, over the whole tables."""

from __future__ import annotations

_WORDS = r"coalesce(regexp_extract_all({0}, '[^\x20\x09-\x0D]+'), [])"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NGRAM_JACCARD = f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
  s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM d),
  x AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
  l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
  e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
  r AS (SELECT doc_id AS node, doc_id AS other FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON r.other = e.a),
  c AS (SELECT node, min(other) AS component_id FROM r GROUP BY node)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM s JOIN c ON node = doc_id"""

PHRASES = f"""WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
  k AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, unnest(list_transform(range(1, len(w) - 18), lambda i: array_to_string(w[i:i + 19], ' '))) AS s FROM d WHERE len(w) >= 20),
  bad AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM k) WHERE r > 1),
  p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS word FROM d),
  g AS (SELECT p.doc_id, j, word, coalesce(max(bad.i) OVER (PARTITION BY p.doc_id ORDER BY j) >= j - 19, false) AS gone FROM p LEFT JOIN bad ON bad.doc_id = p.doc_id AND bad.i = j),
  o AS (SELECT doc_id, count(*) AS n_words, count(CASE WHEN gone THEN 1 END) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (NOT gone) AS kept FROM g GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN o USING (doc_id)"""

SUFFIXES = """WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
  k AS (SELECT doc_id, unnest(range(1, octet_length(b) - 48)) AS i, unnest(list_transform(range(1, octet_length(b) - 48), lambda i: b[i:i + 49])) AS s FROM d WHERE octet_length(b) >= 50),
  bad AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS least FROM k) WHERE least < doc_id),
  m AS (SELECT *, sum(CASE WHEN i <= q + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS q FROM bad)),
  u AS (SELECT doc_id, run, min(i) AS lo, max(i) + 49 AS hi FROM m GROUP BY doc_id, run),
  v AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY run), 0) AS last FROM u),
  o AS (SELECT v.doc_id, sum(hi - lo + 1) AS n_removed, count(*) AS n_spans, max(hi) AS hi, string_agg(hex(CASE WHEN lo - 1 > last THEN b[last + 1:lo - 1] ELSE ''::BLOB END), '' ORDER BY run) AS kept FROM v JOIN d ON d.doc_id = v.doc_id GROUP BY v.doc_id)
SELECT d.doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(CASE WHEN hi IS NULL THEN b ELSE unhex(kept || CASE WHEN hi < octet_length(b) THEN hex(b[hi + 1:octet_length(b)]) ELSE '' END) END) AS kept_sha256 FROM d LEFT JOIN o ON o.doc_id = d.doc_id"""

HARD_NEGATIVES = """WITH w AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_inner_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS BIGINT) AS score
    FROM w a JOIN w b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
  p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
  n AS (SELECT p.a, p.b, s.b AS n, p.score AS ps, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS r
    FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT a AS anchor_id, b AS positive_id, CAST(r AS INTEGER) AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE r <= 3"""

_RUNS = r"coalesce(regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(range(1, octet_length(encode(w)) + 1), lambda i: CAST('0x' || substr(hex(encode(w)), CAST(2 * i - 1 AS INTEGER), 2) AS BIGINT))),
    lambda c, b: xor(c // 256, t[CAST(xor(c, b) % 256 AS INTEGER) + 1])), 4294967295)"""

TARGET_RESAMPLING = f"""WITH k AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) r(i))),
  d AS (SELECT doc_id, {_RUNS.format(_LOWER)} AS w FROM documents),
  b AS (SELECT unnest({_RUNS.format(_LOWER)}) AS w FROM benchmark),
  f AS (SELECT doc_id, unnest(w) AS w FROM d),
  h AS (SELECT w, {_CRC} % 10000 AS bucket FROM (SELECT w FROM f UNION SELECT w FROM b) u, k),
  s AS (SELECT bucket, count(*) AS s FROM f JOIN h USING (w) GROUP BY bucket),
  t AS (SELECT bucket, count(*) AS t FROM b JOIN h USING (w) GROUP BY bucket),
  g AS (SELECT r.bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (coalesce((SELECT sum(s) FROM s), 0) + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + 10000)))) AS BIGINT) AS gain
    FROM (SELECT unnest(range(10000)) AS bucket) r LEFT JOIN s ON s.bucket = r.bucket LEFT JOIN t ON t.bucket = r.bucket),
  o AS (SELECT doc_id, count(*) AS n, sum(gain) AS gain FROM f JOIN h USING (w) JOIN g USING (bucket) GROUP BY doc_id),
  c AS (SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(CASE WHEN n > 0 THEN floor(CAST(gain AS DOUBLE) / n) ELSE 0 END AS BIGINT) AS weight,
    CAST(floor(-1000 * ln(-ln((CAST('0x' || left(sha256('2024:' || CAST(d.doc_id AS VARCHAR)), 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS noise FROM d LEFT JOIN o ON o.doc_id = d.doc_id),
  r AS (SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS r FROM c WHERE n_features >= 20)
SELECT c.doc_id, n_features, weight, weight + noise AS score, CAST(CASE WHEN r <= 10 * (SELECT count(*) FROM r) // 100 THEN r END AS BIGINT) AS rank FROM c LEFT JOIN r ON r.doc_id = c.doc_id"""

ORACLE_SQL: dict[str, str] = {"op2_ngram_jaccard": NGRAM_JACCARD, "op7_phrase_automata": PHRASES, "op10_suffix_dedup": SUFFIXES, "op11_hard_negatives": HARD_NEGATIVES, "op12_target_resampling": TARGET_RESAMPLING}
