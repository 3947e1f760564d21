"""Statements in plain SQL for the operators that SQL can express, each from the definition and not by the method."""

#: The checksum of the decimal digits of ``id`` in ``ids``, bit by bit: a byte comes in, then eight halvings follow.
_CRC32 = """
  digits(id, i, crc) AS (
    SELECT id, 0, CAST(4294967295 AS BIGINT) FROM ids
    UNION ALL
    SELECT id, i + 1, CASE WHEN mixed % 2 = 1 THEN xor(mixed // 2, 3988292384) ELSE mixed // 2 END
    FROM (
      SELECT id, i,
        CASE WHEN i % 8 = 0 THEN xor(crc, CAST(ascii(substr(CAST(id AS VARCHAR), i // 8 + 1, 1)) AS BIGINT))
             ELSE crc END AS mixed
      FROM digits WHERE i < 8 * length(CAST(id AS VARCHAR))) AS m)
"""

LANGUAGES = f"""
WITH RECURSIVE
  ids AS (SELECT DISTINCT doc_id AS id FROM documents WHERE doc_id IS NOT NULL),
  {_CRC32.strip()},
  folds AS (SELECT id, xor(crc, 4294967295) % 4 AS fold FROM digits WHERE i = 8 * length(CAST(id AS VARCHAR))),
  texts AS (
    SELECT row_number() OVER () AS r, doc_id, text, lang, coalesce(fold = 2, TRUE) AS held_out
    FROM documents LEFT JOIN folds ON id = doc_id),
  letters AS (
    SELECT r, unnest(string_split(lower(text), '')) AS c, generate_subscripts(string_split(lower(text), ''), 1) AS i
    FROM texts),
  codes AS (SELECT r, i, CASE WHEN regexp_matches(c, '\\p{{L}}') THEN CAST(unicode(c) AS BIGINT) ELSE 0 END AS code FROM letters),
  runs AS (
    SELECT r, code, lag(code, 1, 0) OVER w AS before, lead(code, 1, 0) OVER w AS after
    FROM codes WINDOW w AS (PARTITION BY r ORDER BY i)),
  grams AS (
    SELECT r, code AS gram FROM runs WHERE code > 0
    UNION ALL SELECT r, before * 2097152 + code + 4398046511104 FROM runs WHERE before > 0 OR code > 0
    UNION ALL SELECT r, code * 2097152 + 4398046511104 FROM (  -- the blank at the end of a text
      SELECT r, arg_max(code, i) AS code FROM codes GROUP BY r) AS e WHERE code > 0
    UNION ALL SELECT r, -((before * 2097152 + code) * 2097152 + after) FROM runs WHERE code > 0),
  counted AS (SELECT r, gram, count(*) AS n FROM grams GROUP BY r, gram),
  mine AS (
    SELECT r, gram, row_number() OVER (PARTITION BY r ORDER BY n DESC, gram) AS place FROM counted
    QUALIFY place <= 400),
  theirs AS (
    SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, gram) AS place
    FROM counted JOIN texts USING (r) WHERE lang IS NOT NULL AND NOT held_out GROUP BY lang, gram
    QUALIFY place <= 400),
  langs AS (SELECT DISTINCT lang FROM theirs),
  distances AS (
    SELECT m.r, l.lang, CAST(sum(coalesce(abs(m.place - t.place), 400)) AS DOUBLE) / (count(*) * 400) AS d
    FROM mine AS m CROSS JOIN langs AS l LEFT JOIN theirs AS t ON t.lang = l.lang AND t.gram = m.gram
    GROUP BY m.r, l.lang),
  nearest AS (SELECT r, lang, d FROM distances QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, lang) = 1)
SELECT t.doc_id, t.held_out, coalesce(n.lang, 'und') AS lang_pred, coalesce(1.0 - n.d, CAST(0 AS DOUBLE)) AS score
FROM texts AS t LEFT JOIN nearest AS n ON n.r = t.r
"""

PREFIX_TRIE = f"""
WITH RECURSIVE
  ids AS (SELECT DISTINCT conv_id AS id FROM conversations WHERE conv_id IS NOT NULL),
  {_CRC32.strip()},
  heads AS (
    SELECT id AS conv_id, xor(crc, 4294967295) % 4 AS h FROM digits WHERE i = 8 * length(CAST(id AS VARCHAR))),
  turns AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
      coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL),
  rebuilt AS (
    SELECT h.conv_id, t.pos, t.role, t.text FROM heads AS h JOIN turns AS t
      ON t.conv_id = h.conv_id - h.conv_id % 20 AND t.pos <= h.h
    UNION ALL
    SELECT h.conv_id, t.pos, t.role, t.text FROM heads AS h JOIN turns AS t
      ON t.conv_id = h.conv_id AND t.pos > h.h),
  places AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS depth,
      sha256(CAST(length(role) AS VARCHAR) || ':' || role || text) AS turn,
      len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words
    FROM rebuilt),
  prefixes AS (
    SELECT conv_id, depth, words, string_agg(turn, '/') OVER (PARTITION BY conv_id ORDER BY depth) AS prefix FROM places
    UNION ALL
    SELECT id, 0, 0, '' FROM ids),
  lengths AS (SELECT conv_id, max(depth) AS d FROM prefixes GROUP BY conv_id),
  nodes AS (
    SELECT p.prefix, p.depth, max(p.words) AS words, min(p.conv_id) AS conv_id, count(*) AS n_convs,
      string_agg(CASE WHEN l.d = p.depth THEN CAST(p.conv_id AS VARCHAR) END, ',' ORDER BY p.conv_id) AS ends
    FROM prefixes AS p JOIN lengths AS l ON l.conv_id = p.conv_id GROUP BY p.prefix, p.depth),
  lines AS (  -- every node with each node above it on the line of its smallest member, itself included
    SELECT a.prefix, a.depth, n.prefix AS below, n.depth AS below_depth, n.words * (n.n_convs - 1) AS saved
    FROM nodes AS n JOIN prefixes AS a ON a.conv_id = n.conv_id AND a.depth <= n.depth),
  children AS (SELECT prefix, depth, count(*) AS n FROM lines WHERE below_depth = depth + 1 GROUP BY prefix, depth),
  leaves AS (
    SELECT l.prefix, l.depth, count(*) FILTER (WHERE c.n IS NULL) AS n, sum(l.saved) AS saved
    FROM lines AS l LEFT JOIN children AS c ON c.prefix = l.below AND c.depth = l.below_depth GROUP BY l.prefix, l.depth),
  above AS (
    SELECT l.below AS prefix, l.below_depth AS depth, n.conv_id
    FROM lines AS l JOIN nodes AS n ON n.prefix = l.prefix AND n.depth = l.depth WHERE l.below_depth = l.depth + 1)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, a.conv_id AS parent_conv_id, n.n_convs,
  coalesce(c.n, 0) AS n_children, l.n AS n_leaves, CAST(l.saved AS BIGINT) AS saved_tokens,
  sha256(coalesce(n.ends, '')) AS ends_sha256
FROM nodes AS n
JOIN leaves AS l ON l.prefix = n.prefix AND l.depth = n.depth
LEFT JOIN children AS c ON c.prefix = n.prefix AND c.depth = n.depth
LEFT JOIN above AS a ON a.prefix = n.prefix AND a.depth = n.depth
"""

HARD_NEGATIVES = """
WITH
  opened AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
      generate_subscripts(embedding, 1) AS i, unnest(embedding) AS v
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL),
  parts AS (
    SELECT vec_id, label, i, CAST(floor(256 * CAST(v AS DOUBLE)) AS BIGINT) AS v FROM opened
    WHERE vec_id NOT IN (SELECT vec_id FROM opened WHERE v IS NULL OR NOT isfinite(v))),
  scores AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(sum(a.v * b.v) AS BIGINT) AS score
    FROM parts AS a JOIN parts AS b ON a.i = b.i AND a.vec_id <> b.vec_id
    WHERE a.vec_id % 100 = 0 GROUP BY a.vec_id, b.vec_id, a.label = b.label),
  positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
  s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives AS p JOIN scores AS s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) <= 10
"""
