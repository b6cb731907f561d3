"""DuckDB SQL of the registered queries of this subpackage."""

from __future__ import annotations

OP1 = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), r AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""

# The inner list is CRC-32 by its definition: reflected polynomial EDB88320, one table entry per byte value.
OP2 = r"""
WITH bits AS (
  SELECT list(list_reduce(list_prepend(b, [0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[]),
    lambda c, step: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS crc_table
  FROM (SELECT unnest(range(256)) AS b)
), t AS (
  SELECT doc_id, coalesce(text, '') AS body, strlen(coalesce(text, '')) + 16 AS size, md5(coalesce(text, '')) AS g, md5(doc_id::VARCHAR) AS d
  FROM documents
), s AS (
  SELECT *, sum(size) OVER (ORDER BY g, d) - size AS before, sum(size) OVER (PARTITION BY g) AS group_bytes,
    sum(size) OVER () AS total, max(size) OVER () AS largest
  FROM t
), p AS (
  SELECT *, CASE WHEN group_bytes * 2000 <= total OR group_bytes <= largest THEN min(before) OVER (PARTITION BY g) ELSE before END AS place FROM s
), q AS (
  SELECT *, (40 * place // total)::INT AS shard FROM p
)
SELECT doc_id, size::BIGINT AS size,
  xor(list_reduce(list_prepend(4294967295::BIGINT, [('0x' || substr(h, 2 * i + 1, 2))::BIGINT for i in range(length(h) // 2)]),
    lambda c, b: xor(crc_table[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS text_crc32,
  'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY g, d) - 1 AS slot, NULL::INT AS grown_shard
FROM (SELECT *, hex(encode(body)) AS h FROM q), bits
"""

OP7 = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, hash(array_to_string(words[i:i + least(len(words), 5) - 1], ' ')) AS shingle
  FROM (SELECT *, unnest(range(1, len(words) - least(len(words), 5) + 2)) AS i FROM t WHERE len(words) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * m >= 85 * (p.n + q.n - m)
), edges AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT doc_id, doc_id AS other FROM t UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON r.other = e.a
), least_id AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, component_id = doc_id AS kept FROM least_id LEFT JOIN n USING (doc_id)
"""

OP10 = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
  FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(words), 13) AS n, array_to_string(words[i:i + least(len(words), 13) - 1], ' ') AS run
  FROM (SELECT *, unnest(range(1, len(words) - least(len(words), 13) + 2)) AS i FROM b WHERE len(words) > 0)
), seen AS (
  SELECT doc_id, i, n, array_to_string(words[i:i + n - 1], ' ') AS run
  FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows))
), met AS (
  SELECT doc_id, i, s.n, item_id FROM seen s JOIN windows w ON s.n = w.n AND s.run = w.run
), hit AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS place FROM met) GROUP BY 1
), items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS listed FROM met GROUP BY 1
)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


OP11 = r"""
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, v.vec_id, v.label = a.label AS same, list_inner_product(a.q, v.q)::BIGINT AS score
  FROM v a, v WHERE a.vec_id % 100 = 0 AND a.vec_id <> v.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""

OP13 = r"""
WITH t AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
    regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces
  FROM documents
), p AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS words FROM (SELECT lang, unnest(pieces) AS piece FROM t)
), totals AS (
  SELECT lang, sum(len(words))::HUGEINT AS n FROM p GROUP BY 1
), seen AS (
  SELECT lang, size, array_to_string(words[i:i + size - 1], ' ') AS phrase
  FROM (SELECT lang, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM p, (SELECT unnest([1, 2, 3, 4, 5]) AS size))
), f AS (
  SELECT lang, size, phrase, count(*)::HUGEINT AS a FROM seen GROUP BY ALL HAVING count(*) >= 100
), c AS (
  SELECT lang, size, phrase, a, string_split(phrase, ' ') AS words FROM f WHERE size > 1
), cuts AS (
  SELECT lang, phrase, a, k, array_to_string(words[1:k], ' ') AS front, array_to_string(words[k + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, size)) AS k FROM c)
), scored AS (
  SELECT x.lang, x.phrase, x.a, l.a AS l, r.a AS r, n, (1000 * x.a * n) // (l.a * r.a) AS score
  FROM cuts x JOIN f l ON l.lang = x.lang AND l.phrase = x.front JOIN f r ON r.lang = x.lang AND r.phrase = x.rest JOIN totals t ON t.lang = x.lang
  QUALIFY row_number() OVER (PARTITION BY x.lang, x.phrase ORDER BY score, k) = 1
), inner_phrases AS (
  SELECT lang, array_to_string(words[i:i + n - 1], ' ') AS phrase, max(a) AS around
  FROM (SELECT *, unnest(range(1, size - n + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS n FROM c)) GROUP BY ALL
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
  a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM scored LEFT JOIN inner_phrases USING (lang, phrase)
WHERE around IS NULL OR around < a
QUALIFY rank <= 2000
"""


def all_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1, "op2_sharding": OP2, "op7_near_dup": OP7, "op10_decontamination": OP10, "op11_hard_negatives": OP11, "op13_collocations": OP13}
