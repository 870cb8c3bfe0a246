"""DuckDB statements of the text queries that take more than a few lines."""

MANIFEST = """
WITH RECURSIVE fields AS (
  SELECT row_number() OVER () AS id, doc_id, lang, unnest([0, 1]) AS more,
         [doc_id::VARCHAR, source, lang, NULL, text] AS said, n_chars
  FROM documents
), leaf AS (
  SELECT id, doc_id, lang, more, sha256(array_to_string(list_transform(
           [said[1], said[2], said[3], (n_chars + more)::VARCHAR, said[5]],
           lambda f: CASE WHEN f IS NULL THEN '-' ELSE strlen(f) || ':' || f END), '')) AS h
  FROM fields
), crc AS (
  SELECT id, xor(list_reduce(
           list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
           lambda s, b: list_reduce(list_concat([xor(s, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
             lambda x, _: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) AS crc
  FROM fields WHERE more = 0
), place AS (
  SELECT a.id, a.doc_id, a.lang, a.h AS leaf, coalesce(CASE WHEN crc % 7 = 0 THEN b.h END, a.h) AS seen,
         row_number() OVER (PARTITION BY a.lang ORDER BY a.doc_id NULLS FIRST, a.h) - 1 AS pos
  FROM leaf a JOIN leaf b ON a.id = b.id AND a.more = 0 AND b.more = 1 JOIN crc ON crc.id = a.id
), nodes(lang, lvl, pos, h, n) AS (
  SELECT lang, 0, pos, leaf, count(*) OVER (PARTITION BY lang) FROM place
  UNION ALL
  SELECT lang, any_value(lvl) + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 1) // 2)
  FROM nodes WHERE n > 1 GROUP BY lang, pos // 2
), subroot AS (
  SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM nodes WHERE n = 1
), tops(lvl, pos, h, n) AS (
  SELECT 0, pos, h, count(*) OVER () FROM subroot
  UNION ALL
  SELECT any_value(lvl) + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 1) // 2)
  FROM tops WHERE n > 1 GROUP BY pos // 2
), step AS (
  SELECT p.id, 0 AS part, c.lvl, (p.pos >> c.lvl) & 1 AS odd, coalesce(s.h, '') AS sibling
  FROM place p JOIN (SELECT DISTINCT lang, lvl, n FROM nodes) c ON c.lang IS NOT DISTINCT FROM p.lang AND c.n > 1
  LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM p.lang AND s.lvl = c.lvl AND s.pos = xor(p.pos >> c.lvl, 1)
  UNION ALL
  SELECT p.id, 1, c.lvl, (r.pos >> c.lvl) & 1, coalesce(s.h, '')
  FROM place p JOIN subroot r ON r.lang IS NOT DISTINCT FROM p.lang JOIN (SELECT DISTINCT lvl, n FROM tops) c ON c.n > 1
  LEFT JOIN tops s ON s.lvl = c.lvl AND s.pos = xor(r.pos >> c.lvl, 1)
), path AS (
  SELECT id, list(odd || sibling ORDER BY part, lvl) AS steps, sha256(string_agg(sibling, '' ORDER BY part, lvl)) AS proof FROM step GROUP BY id
), folded AS (
  SELECT p.*, coalesce(proof, sha256('')) AS proof, list_reduce(list_concat([seen], coalesce(steps, [])),
           lambda h, s: CASE WHEN s[1] = '1' THEN sha256(s[2:] || h) ELSE sha256(h || s[2:]) END) AS folded_root
  FROM place p LEFT JOIN path USING (id)
)
SELECT f.doc_id, f.leaf, r.h AS subroot, t.h AS root, f.proof AS proof_sha256, f.folded_root, f.folded_root = t.h AS verified
FROM folded f JOIN subroot r ON r.lang IS NOT DISTINCT FROM f.lang CROSS JOIN (SELECT h FROM tops WHERE n = 1) t
"""

COLLOCATIONS = """
WITH pieces AS (
  SELECT lang, row_number() OVER () AS piece, words
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS said
        FROM documents),
       LATERAL (SELECT list_filter(regexp_split_to_array(said, '[\\x20\\x09]+'), lambda w: w <> '') AS words)
), grams AS (
  SELECT lang, size, unnest(list_transform(range(1, len(words) - size + 2), lambda i: array_to_string(words[i:i + size - 1], ' '))) AS phrase
  FROM pieces, (SELECT unnest([1, 2, 3]) AS size) WHERE len(words) >= size
), f AS (
  SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL
), langs AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang
), cuts AS (
  SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, size)) AS k FROM f WHERE size > 1 AND f >= 10
), scored AS (
  SELECT c.lang, c.size, c.phrase, c.a, c.w, c.k, x.f AS l, y.f AS r, (1000000::HUGEINT * c.a * c.a // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ')
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, c.k) = 1
), inside AS (
  SELECT lang, phrase, max(a) AS longer
  FROM (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase FROM scored WHERE size = 3) GROUP BY ALL
), ranked AS (
  SELECT s.lang, s.phrase, s.a, s.l, s.r, s.score, row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.phrase) AS rank
  FROM scored s LEFT JOIN inside i ON i.lang = s.lang AND i.phrase = s.phrase
  WHERE i.longer IS NULL OR 100 * i.longer < 50 * s.a
)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, langs.n, r.score FROM ranked r JOIN langs ON langs.lang = r.lang WHERE r.rank <= 2000
"""
