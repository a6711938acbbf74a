"""Registered queries of this subpackage and their SQL."""

import corpus_pipeline

from .decontaminate import op8_decontamination
from .language import op5_language_id
from .licenses import license_sql, op11_license_scan
from .line_dedup import op1_line_dedup
from .neighbours import op2_nearest_neighbours
from .pieces import op9_sentencepiece
from .quality import op10_quality
from .resampling import RESAMPLING_SQL, op13_importance_resampling
from .sharding import op4_sharding
from .shingle_join import op7_jaccard_join
from .spelling import SPELLING_SQL, op12_spelling_variants
from .token_files import op6_token_files
from .wordpieces import op3_token_counts

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_nearest_neighbours": op2_nearest_neighbours,
    "op3_token_counts": op3_token_counts,
    "op4_sharding": op4_sharding,
    "op5_language_id": op5_language_id,
    "op6_token_files": op6_token_files,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_decontamination": op8_decontamination,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_quality": op10_quality,
    "op11_license_scan": op11_license_scan,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_importance_resampling": op13_importance_resampling,
    "pipeline": corpus_pipeline.run,
}

ORACLE = {
    "op1_line_dedup": r"""
WITH parts AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), lines AS (
  SELECT doc_id, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS pos FROM parts
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), flagged AS (
  SELECT *, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS dropped FROM keyed
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
""",
    "op8_decontamination": r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(words), 13) AS size,
    array_to_string(words[i:i + 12], ' ') AS win
  FROM item_words, unnest(range(1, greatest(len(words) - 12, 1) + 1)) AS r(i) WHERE len(words) > 0
), sizes AS (SELECT DISTINCT size FROM windows),
spots AS (
  SELECT doc_id, size, i AS pos, array_to_string(words[i:i + size - 1], ' ') AS win
  FROM doc_words, sizes, unnest(range(1, len(words) - size + 2)) AS r(i)
), hits AS (SELECT doc_id, pos, spots.size, item_id FROM spots JOIN windows USING (size, win)),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(pos, pos + size)) AS r(p) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM doc_words LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op7_jaccard_join": r"""
WITH RECURSIVE doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), sets AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 2], ' ') AS shingle
  FROM doc_words, unnest(range(1, greatest(len(words) - 2, 1) + 1)) AS r(i) WHERE len(words) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * common >= 90 * (x.n + y.n - common)
), ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT doc_id, b FROM reached JOIN ways ON other = a
)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id
FROM reached LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
""",
    "op11_license_scan": license_sql(),
    "op12_spelling_variants": SPELLING_SQL,
    "op13_importance_resampling": RESAMPLING_SQL,
}
