from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sessionmill.llm.collocations import collocations
from sessionmill.llm.registry import query, table


@query(r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), worded AS (
  SELECT lang, list_filter(string_split_regex(piece, '[ \x09]+'), lambda w: w <> '') AS ws FROM pieces
), grams AS (
  SELECT lang, 1 AS size, unnest(ws) AS phrase FROM worded
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM worded
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) FROM worded
), f AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
cand AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE size > 1 AND f >= 10),
inner_pairs AS (
  SELECT lang, ws[1] || ' ' || ws[2] AS phrase, a FROM cand WHERE size = 3
  UNION ALL SELECT lang, ws[2] || ' ' || ws[3], a FROM cand WHERE size = 3
), longer AS (SELECT lang, phrase, max(a) AS longer FROM inner_pairs GROUP BY ALL),
alone AS (
  SELECT c.* FROM cand c LEFT JOIN longer g ON c.size = 2 AND g.lang = c.lang AND g.phrase = c.phrase
  WHERE g.longer IS NULL OR 100 * g.longer < 50 * c.a
), cuts AS (
  SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS lp, array_to_string(ws[k + 1:], ' ') AS rp
  FROM alone, (VALUES (1), (2)) v(k) WHERE k < size
), scored AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, k, (1000000 * c.a::HUGEINT * c.a // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.lp JOIN f y ON y.lang = c.lang AND y.phrase = c.rp
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best b JOIN totals USING (lang) QUALIFY rank <= 2000
""")
def op13_phrase_collocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
