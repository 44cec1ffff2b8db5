from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sessionmill.llm.prefix_trie import prefix_trie
from sessionmill.llm.registry import query, table


@query("""
WITH own AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT c, xor(list_reduce([4294967295] || list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
      lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
          lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT c FROM own)
), joined AS (
  SELECT i.c, 0 AS part, pos, role, text FROM ids i JOIN own o ON o.c = i.c - i.c % 5 AND o.pos <= i.h
  UNION ALL SELECT i.c, 1, pos, role, text FROM ids i JOIN own o ON o.c = i.c AND o.pos > i.h
), turns AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS depth, md5(md5(role) || md5(text)) AS k, strlen(text) AS size FROM joined
), paths AS (
  SELECT c, depth, size, string_agg(k, '') OVER (PARTITION BY c ORDER BY depth) AS key FROM turns
  UNION ALL SELECT c, 0, 0, '' FROM ids
), nodes AS (
  SELECT key, min(c) AS c, min(depth) AS depth, count(*) AS n, min(size) AS size FROM paths GROUP BY key
), tree AS (
  SELECT a.*, b.c AS parent, (SELECT count(*) FROM nodes k WHERE k.depth = a.depth + 1 AND left(k.key, 32 * a.depth) = a.key) AS kids
  FROM nodes a LEFT JOIN nodes b ON a.depth > 0 AND b.key = left(a.key, length(a.key) - 32)
), below AS (
  SELECT p.key, sum(CASE WHEN u.kids = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((u.n - 1) * u.size)::BIGINT AS saved
  FROM tree u JOIN paths p ON p.c = u.c AND p.depth <= u.depth GROUP BY p.key
), ends AS (
  SELECT key, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS digest
  FROM (SELECT c, arg_max(key, depth) AS key FROM paths GROUP BY c) GROUP BY key
)
SELECT c AS conv_id, depth, parent AS parent_conv_id, n AS n_convs, kids AS n_children, n_leaves, saved AS saved_tokens,
       coalesce(digest, sha256('')) AS ends_sha256
FROM tree JOIN below USING (key) LEFT JOIN ends USING (key)
""")
def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))
