from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sessionmill.llm.near_dup import near_groups
from sessionmill.llm.registry import query, table


@query("""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\\x{80}-\\x{10FFFF}]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s FROM words),
items AS (SELECT doc_id, unnest(s) AS x FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT c.a, c.b FROM common c JOIN sets p ON p.doc_id = c.a JOIN sets q ON q.doc_id = c.b WHERE n >= 0.8 * (len(p.s) + len(q.s) - n) - 1e-9
  UNION ALL SELECT p.doc_id, q.doc_id FROM sets p JOIN sets q ON p.doc_id <> q.doc_id WHERE len(p.s) = 0 AND len(q.s) = 0),
reach AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node),
classes AS (SELECT node AS doc_id, min(root) AS class_id FROM reach GROUP BY node)
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size,
       coalesce((SELECT count(*) FROM links l WHERE l.a = c.doc_id), 0) AS n_links, doc_id = class_id AS kept
FROM classes c
""")
def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "n_links", "kept")
