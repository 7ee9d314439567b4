"""SQL that the queries of this folder are compared with, written independently of them."""

from __future__ import annotations

LINE_DEDUP = """
WITH lines AS (
  SELECT doc_id, coalesce(text, '') AS text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), shared AS (
  SELECT key, min(doc_id) AS keeper FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), judged AS (
  SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id > s.keeper AS dropped
  FROM keyed k LEFT JOIN shared s ON k.key = s.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATE = f"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS piece
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM item_words WHERE len(w) > 0)
), doc_words AS (
  SELECT row_number() OVER () AS n, doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
), hits AS (
  SELECT n, i, size, item_id
  FROM (SELECT n, i, s.size, array_to_string(w[i:i + s.size - 1], ' ') AS piece
        FROM (SELECT n, w, unnest(range(1, len(w) + 1)) AS i FROM doc_words), (SELECT DISTINCT size FROM item_windows) s
        WHERE i + s.size - 1 <= len(w))
  JOIN item_windows USING (size, piece)
), covered AS (
  SELECT n, count(DISTINCT place) AS n_hit FROM (SELECT n, unnest(range(i, i + size)) AS place FROM hits) GROUP BY n
), named AS (
  SELECT n, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM hits GROUP BY n
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN covered USING (n) LEFT JOIN named USING (n)
"""

NGRAM_JACCARD = f"""
WITH RECURSIVE doc_words AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 3) - 1], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 0) + 2)) AS i FROM doc_words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS size FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM shared JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y
  WHERE 100 * common >= 90 * (s.size + t.size - common)
), edges AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reached AS (
  SELECT x AS doc_id, y AS other FROM edges
  UNION
  SELECT r.doc_id, e.y FROM reached r JOIN edges e ON e.x = r.other
)
SELECT d.doc_id, coalesce(size, 0) AS n_shingles, least(d.doc_id, coalesce(first, d.doc_id)) AS component_id
FROM doc_words d LEFT JOIN sizes s ON s.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, min(other) AS first FROM reached GROUP BY doc_id) r ON r.doc_id = d.doc_id
"""

SUBSTRING_DEDUP = """
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS piece
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM doc_words WHERE len(w) >= 13)
), repeats AS (
  SELECT doc_id, i FROM windows JOIN (SELECT piece, min(doc_id) AS first FROM windows GROUP BY piece) USING (piece)
  WHERE first < doc_id
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS place FROM repeats
), runs AS (
  SELECT doc_id, min(place) - 1 AS a, max(place) AS b
  FROM (SELECT doc_id, place, place - row_number() OVER (PARTITION BY doc_id ORDER BY place) AS run FROM gone) GROUP BY doc_id, run
), removed AS (
  SELECT doc_id, count(*) AS n_removed, list(place) AS cut FROM gone GROUP BY doc_id
), spans AS (
  SELECT doc_id, string_agg(a || '-' || b, ',' ORDER BY a) AS spans FROM runs GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(spans, '') AS spans,
       sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(coalesce(cut, []), i)), ' ')) AS kept_sha256
FROM doc_words LEFT JOIN removed USING (doc_id) LEFT JOIN spans USING (doc_id)
"""

# CRC-32 of a text's bytes, by the reflected polynomial 0xEDB88320.
_CRC_TABLE = """
  SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)
              ORDER BY n) AS steps
  FROM range(256) r(n)
"""


def _crc32(text: str) -> str:
    byte = f"CAST('0x' || substr(hex({text}), 2 * i + 1, 2) AS BIGINT)"
    bytes_ = f"list_transform(range(strlen({text})), lambda i: {byte})"
    step = "lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce({bytes_}, {step}, 4294967295), 4294967295)"


_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)


def importance_resample(percent: int = 25, min_words: int = 20, seed: int = 7, buckets: int = 10_000) -> str:
    runs = "list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))"
    return f"""
WITH crc AS ({_CRC_TABLE}),
words AS (
  SELECT row_number() OVER () AS n, doc_id, {_WORDS} AS words FROM documents
), grams AS (
  SELECT n, unnest({runs}) AS gram FROM words
), target_grams AS (
  SELECT unnest({runs}) AS gram FROM (SELECT {_WORDS} AS words FROM benchmark)
), hashed AS (
  SELECT gram, {_crc32("gram")} % {buckets} AS bucket
  FROM (SELECT gram FROM grams UNION SELECT gram FROM target_grams), crc
), source_counts AS (
  SELECT bucket, count(*) AS s FROM grams JOIN hashed USING (gram) GROUP BY bucket
), target_counts AS (
  SELECT bucket, count(*) AS t FROM target_grams JOIN hashed USING (gram) GROUP BY bucket
), totals AS (
  SELECT (SELECT count(*) FROM grams) + {buckets}::DOUBLE AS s_all, (SELECT count(*) FROM target_grams) + {buckets}::DOUBLE AS t_all
), gains AS (
  SELECT b.bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * s_all / ((coalesce(s, 0) + 1)::DOUBLE * t_all))) AS BIGINT) AS gain
  FROM range({buckets}) b(bucket) LEFT JOIN source_counts sc ON sc.bucket = b.bucket
    LEFT JOIN target_counts tc ON tc.bucket = b.bucket, totals
), weighed AS (
  SELECT n, count(*) AS n_features, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight
  FROM grams JOIN hashed USING (gram) JOIN gains USING (bucket) GROUP BY n
), scored AS (
  SELECT doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
           (CAST('0x' || substr(sha256('{seed}:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM words LEFT JOIN weighed USING (n)
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n
  FROM scored WHERE n_words >= {min_words}
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {percent} * n // 100 THEN place END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""


def _field(value: str) -> str:
    text = f"CAST({value} AS VARCHAR)"
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({text}) || ':' || {text} END"


def _tree(name: str, leaves: str) -> str:
    """Levels of all trees of (tree, pos, n, node): two by two until one is left."""
    return f"""{name} AS (
  SELECT tree, 0 AS level, pos, n, node FROM {leaves}
  UNION ALL
  SELECT tree, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY pos))
  FROM {name} WHERE n > 1 GROUP BY tree, level, pos // 2, n
)"""


def merkle_manifest() -> str:
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    leaf = " || ".join(_field(f) for f in fields)
    changed = " || ".join(_field("(n_chars + 1)" if f == "n_chars" else f) for f in fields)
    return f"""
WITH RECURSIVE crc AS ({_CRC_TABLE}),
leaves AS (
  SELECT doc_id, coalesce(':' || lang, '-') AS tree, sha256({leaf}) AS node,
         CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN sha256({changed}) ELSE sha256({leaf}) END AS folded
  FROM documents, crc
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id, node) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n
  FROM leaves
), {_tree("low", "placed")}, roots AS (
  SELECT 'top' AS tree, tree AS of_tree, node, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n
  FROM low WHERE n = 1
), {_tree("high", "roots")}, ways AS (
  SELECT p.tree, p.pos, low.level AS step, low.pos AS at, s.node AS sibling
  FROM placed p JOIN low ON low.tree = p.tree AND low.n > 1 AND low.pos = p.pos >> low.level
  LEFT JOIN low s ON s.tree = low.tree AND s.level = low.level AND s.pos = xor(low.pos, 1)
  UNION ALL
  SELECT p.tree, p.pos, 1000 + high.level, high.pos, s.node
  FROM placed p JOIN roots r ON r.of_tree = p.tree JOIN high ON high.n > 1 AND high.pos = r.pos >> high.level
  LEFT JOIN high s ON s.level = high.level AND s.pos = xor(high.pos, 1)
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY tree, pos ORDER BY step) AS k FROM ways
), proofs AS (
  SELECT tree, pos, max(k) AS last, string_agg(sibling, '' ORDER BY k) AS siblings FROM numbered GROUP BY tree, pos
), folds AS (
  SELECT tree, pos, 0::BIGINT AS k, folded AS node FROM placed
  UNION ALL
  SELECT f.tree, f.pos, w.k,
         sha256(CASE WHEN w.at % 2 = 1 THEN w.sibling ELSE '' END || f.node
                || CASE WHEN w.at % 2 = 0 THEN coalesce(w.sibling, '') ELSE '' END)
  FROM folds f JOIN numbered w ON w.tree = f.tree AND w.pos = f.pos AND w.k = f.k + 1
)
SELECT p.doc_id, p.node AS leaf, r.node AS subroot, h.node AS root, sha256(coalesce(q.siblings, '')) AS proof_sha256,
       f.node AS folded_root, f.node = h.node AS verified
FROM placed p JOIN roots r ON r.of_tree = p.tree JOIN high h ON h.n = 1
LEFT JOIN proofs q ON q.tree = p.tree AND q.pos = p.pos
JOIN folds f ON f.tree = p.tree AND f.pos = p.pos AND f.k = coalesce(q.last, 0)
"""
