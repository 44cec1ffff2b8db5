from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sessionmill.llm import secret_scan as s
from sessionmill.llm.registry import query, table


def _text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_BASE = s.ASSIGN.replace("((?i)", "((?i:").replace("api_?key)", "api_?key))")

#: Positions by running sums of lengths; parts meet by a plain range join.
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
hits AS (
  SELECT rid, 'assign' AS kind, regexp_extract_all(t, {_text(_BASE)}) AS h, string_split_regex(t, {_text(_BASE)}) AS g FROM d
  UNION ALL SELECT rid, 'access', regexp_extract_all(t, 'AKIA[A-Z0-9]+'), string_split_regex(t, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL SELECT rid, 'hex', regexp_extract_all(t, '[0-9a-f]+'), string_split_regex(t, '[0-9a-f]+') FROM d
  UNION ALL SELECT rid, 'part', regexp_extract_all(t, {_text(s.PARTS)}), string_split_regex(t, {_text(s.PARTS)}) FROM d
), numbered AS (
  SELECT rid, kind, unnest(h) AS hit, unnest(g[1:len(h)]) AS gap, unnest(range(len(h))) AS i FROM hits WHERE len(h) > 0
), placed AS (
  SELECT rid, kind, hit, sum(length(gap) + length(hit)) OVER (PARTITION BY rid, kind ORDER BY i) AS e, length(hit) AS n FROM numbered
), named AS (
  SELECT rid, (e - n)::BIGINT AS s, e::BIGINT AS e, CASE
      WHEN kind = 'assign' THEN CASE WHEN length(regexp_extract(hit, {_text(_BASE)}, 2)) >= 12 THEN 0 END
      WHEN kind = 'access' THEN CASE WHEN n >= 18 THEN 1 END
      WHEN kind = 'hex' THEN CASE WHEN n >= 16 THEN 2 END
      WHEN hit[1] = chr(10) THEN -1
      WHEN regexp_matches(hit, {_text("^(?:" + s.URL + ")")}) THEN 5
      WHEN regexp_matches(hit, {_text("^(?:" + s.ID + ")")}) THEN 3
      WHEN regexp_matches(hit, {_text("^(?:" + s.HOST + ")")}) THEN 5
      WHEN regexp_matches(hit, {_text("^(?:" + s.NAMED_KEY + ")")}) THEN 4
      WHEN n <= 100 AND regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Z]') AND regexp_matches(hit, '[a-z]') THEN 4
    END AS k
  FROM placed
), base AS (SELECT * FROM named WHERE k BETWEEN 0 AND 2),
scopes AS (
  SELECT w.rid, w.s, w.e, w.k, (SELECT count(*) FROM named b WHERE b.rid = w.rid AND b.k = -1 AND b.s <= w.s) AS scope
  FROM named w
  WHERE w.k IN (0, 1) OR w.k > 2 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = w.rid AND b.s < w.e AND b.e > w.s)
), added AS (
  SELECT rid, s, e, k FROM scopes w
  WHERE k > 2 AND EXISTS (
    SELECT 1 FROM scopes o
    WHERE o.rid = w.rid AND o.scope = w.scope AND o.s <= w.e + {s.REACH} AND o.e >= w.s - {s.REACH}
      AND (w.k IN (3, 5) AND o.k IN (0, 4) OR w.k = 4 AND o.k IN (1, 3, 5)))
), spans AS (
  SELECT rid, s, k, ['assign', 'access', 'hex', 'id', 'key', 'endpoint'][k + 1] || ':' || s || ':' || e AS line
  FROM (SELECT * FROM base UNION ALL SELECT * FROM added)
), lines AS (
  SELECT rid, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
         count(*) FILTER (k > 2) AS n_linked, string_agg(line, ',' ORDER BY s, k) FILTER (k < 3) AS base_line, string_agg(line, ',' ORDER BY s, k) AS spans
  FROM spans GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base_line, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_linked, 0) AS n_linked
FROM d LEFT JOIN lines USING (rid)
"""


@query(SQL)
def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.find_secrets(table(spark, sf_dir, "documents"))
