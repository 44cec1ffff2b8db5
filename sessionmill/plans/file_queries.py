"""Queries over files as blocks of bytes: raw hashes, and what has changed in growing logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionmill.operators.ordering import durable
from sessionmill.plans.registry import query
from sessionmill.plans.run_queries import _chat_files, _conv, _folder
from sessionmill.plans.views import view
from sessionmill.sources.blocks import block_hashes, file_blocks, growth, tail_lines
from sessionmill.sources.files import list_files
from sessionmill.sources.records import content_hash
from sessionmill.sources.sinks import write_bodies

_SMALL = 512  # bytes of a block, so that files have many

_LEAVES = """
WITH bytes AS (SELECT conv_id, string_agg(raw || chr(10), '' ORDER BY line_no) AS t FROM v_records GROUP BY conv_id),
leaves AS (
  SELECT conv_id, b, strlen(t) AS size, sha256(unhex(substr(hex(encode(t)), b * 1024 + 1, 1024))) AS leaf
  FROM (SELECT conv_id, t, unnest(range(0, @big(ceil(strlen(t) / 512.0)))) AS b FROM bytes)),
groups AS (SELECT conv_id, b // 4 AS g, any_value(size) AS size, @sha256(string_agg(leaf, '' ORDER BY b)) AS part FROM leaves GROUP BY conv_id, b // 4)
SELECT conv_id, @sha256('v1/blocks' || chr(10) || @str(any_value(size)) || chr(10) || string_agg(part, '' ORDER BY g)) AS raw_hash FROM groups GROUP BY conv_id
"""


@query(_LEAVES)
def block_hashed_files(spark, sf_dir):
    """Raw hashes of session files read in blocks of 512 bytes, four to a group."""
    listing = list_files(spark, _chat_files(spark, sf_dir, _folder(spark, "blocks")), "claude-code")
    return block_hashes(file_blocks(listing, block=_SMALL), fan=4).select(_conv().alias("conv_id"), "raw_hash")


@query("""
WITH numbered AS (
  SELECT conv_id, row_number() OVER w - 1 AS line_no, count(*) OVER (PARTITION BY conv_id) AS n, raw FROM v_records WINDOW w AS (PARTITION BY conv_id ORDER BY line_no)),
now AS (
  SELECT conv_id, line_no, n, CASE WHEN conv_id % 4 = 2 AND line_no = n // 2 THEN replace(raw, '"type":"message"', '"type":"massage"') ELSE raw END AS raw FROM numbered),
placed AS (
  SELECT *, sum(strlen(raw) + 1) OVER (PARTITION BY conv_id ORDER BY line_no) AS stop, strlen(raw) + 1 AS size FROM now),
files AS (
  SELECT conv_id, max(stop) AS size, sum(size) FILTER (WHERE line_no * 2 < n) AS half, max(stop - size) FILTER (WHERE line_no = n // 2) AS changed FROM placed GROUP BY conv_id),
stated AS (
  SELECT conv_id, CASE conv_id % 4 WHEN 0 THEN 'same' WHEN 2 THEN 'rewritten' WHEN 3 THEN 'new' ELSE CASE WHEN half = size THEN 'same' ELSE 'grown' END END AS status,
    CASE conv_id % 4 WHEN 1 THEN CASE WHEN half < size THEN half END WHEN 2 THEN (changed + 10) // 512 * 512 WHEN 3 THEN 0 END AS from_byte FROM files),
begun AS (
  SELECT s.conv_id, status, from_byte, @big(count(*) FILTER (WHERE p.stop <= from_byte)) AS from_line FROM stated s JOIN placed p USING (conv_id) GROUP BY ALL),
tails AS (
  SELECT conv_id, @big(count(*)) AS n_lines, @sha256('v0.2/chunks' || chr(10) || @sha256('v0.2' || chr(10) || '[' || string_agg(raw, ',' ORDER BY line_no) || ']')) AS tail_hash
  FROM placed JOIN begun USING (conv_id) WHERE from_byte IS NOT NULL AND line_no >= from_line GROUP BY conv_id)
SELECT conv_id, status, @big(from_byte) AS from_byte, CASE WHEN from_byte IS NOT NULL THEN from_line END AS from_line, n_lines, tail_hash FROM begun LEFT JOIN tails USING (conv_id)""")
def grown_sessions(spark, sf_dir):
    """Session files told from what a run before has seen of them: half of the lines, another spelling, all or nothing.

    Only the lines from the first new byte on are parsed."""
    folder = _folder(spark, "grown")
    r = view(spark, sf_dir, "v_records").select(
        F.lit("p").alias("manifest_id"), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("session_id"), "conv_id", "line_no", "raw"
    )
    r = r.join(r.groupBy("conv_id").agg(F.count("*").alias("n")), "conv_id")
    kind = F.col("conv_id") % 4
    write_bodies(r.where((kind != 3) & ((kind != 1) | (F.col("line_no") * 2 < F.col("n")))), f"{folder}/before")
    altered = F.when((kind == 2) & (F.col("line_no") == F.floor(F.col("n") / 2)), F.replace("raw", F.lit('"type":"message"'), F.lit('"type":"massage"')))
    write_bodies(r.withColumn("raw", F.coalesce(altered, "raw")), f"{folder}/now")

    # A path names a body's folder here, as the names of its files change with every write.
    old = list_files(spark, f"{folder}/before/*/*/*.txt", "claude-code")
    new = list_files(spark, f"{folder}/now/*/*/*.txt", "claude-code").select("path", "size_bytes", _conv().alias("conv_id"))
    known = file_blocks(old, block=_SMALL).withColumn("conv_id", _conv()).drop("path").join(new.select("path", "conv_id"), "conv_id")
    known = durable(known.drop("conv_id"))
    blocks = durable(file_blocks(new, known, block=_SMALL))
    grown = durable(growth(new, blocks, known, block=_SMALL))
    tail = content_hash(tail_lines(blocks, grown, block=_SMALL), ["path"])
    return grown.join(tail, "path", "left").select(
        _conv().alias("conv_id"), "status", "from_byte", "from_line", F.col("record_count").alias("n_lines"), F.col("content_hash").alias("tail_hash")
    )
