"""Queries over session records: parsing, identity, cost and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionmill.functions import paths as P
from sessionmill.functions.hashing import is_uuid, session_uuid
from sessionmill.functions.pricing import model_vendor, price_rule, token_cost
from sessionmill.operators import identity as I
from sessionmill.operators import usage as U
from sessionmill.plans.registry import query
from sessionmill.plans.views import table, view
from sessionmill.sources.records import (
    content_hash,
    content_hash_of_text,
    explode_json_array,
    explode_ndjson,
    typed_records,
)

# The price table as SQL, for the checks.
PRICE_CASES = """
  CASE WHEN m = 'gpt-4o-mini' OR m LIKE 'gpt-4o-mini-%' THEN [0.15, 0, 0.075, 0.6]
       WHEN m = 'gpt-4o' OR m LIKE 'gpt-4o-%' THEN [2.5, 0, 1.25, 10]
       WHEN m = 'gpt-5' OR m LIKE 'gpt-5-%' THEN [12, 0, 3, 48]
       WHEN m = 'o3-mini' OR m LIKE 'o3-mini-%' THEN [1.1, 0, 0.55, 4.4]
       WHEN m = 'o4-mini' OR m LIKE 'o4-mini-%' THEN [1.1, 0, 0.275, 4.4]
       WHEN m = 'o1' OR m LIKE 'o1-%' THEN [15, 0, 7.5, 60]
       WHEN m = 'o3' OR m LIKE 'o3-%' THEN [10, 0, 2.5, 40]
       WHEN contains(m, 'opus') THEN [15, 18.75, 1.5, 75]
       WHEN contains(m, 'haiku') THEN [0.8, 1, 0.08, 4]
       ELSE [3, 3.75, 0.3, 15] END::DOUBLE[]"""
VENDOR_CASES = """
  CASE WHEN contains(lower({0}), 'claude') THEN 'anthropic'
       WHEN contains(lower({0}), 'gpt') OR lower({0}) LIKE 'o1%' OR lower({0}) LIKE 'o3%' THEN 'openai'
       WHEN contains(lower({0}), 'gemini') THEN 'google' END"""

# Facts per chat line, straight from the construction of the lines.
_FACTS = f"""
WITH facts AS (
  SELECT path, turn, role, conv_id,
    CASE WHEN ts_json LIKE '"%' THEN trim(ts_json, '"') END AS ts,
    CASE WHEN model = '' THEN 'unknown' ELSE model END AS label, lower(model) AS m,
    CASE WHEN input_json LIKE '"%' THEN 0 ELSE CAST(input_json AS BIGINT) END AS i,
    output_tokens AS o, cache_creation_tokens AS cw, cache_read_tokens AS cr
  FROM v_lines),
priced AS (
  SELECT *, {PRICE_CASES} AS p FROM facts),
costs AS (
  SELECT *, CASE WHEN role = 'assistant' THEN (i * p[1] + cw * p[2] + cr * p[3] + o * p[4]) / 1000000 ELSE 0 END AS cost
  FROM priced),
models AS (
  SELECT path, label, sum(i) AS i, sum(o) AS o, sum(cw) AS cw, sum(cr) AS cr, sum(cost) AS cost, min(turn) AS first_turn
  FROM costs WHERE role = 'assistant' GROUP BY path, label),
totals AS (
  SELECT path, sum(i) AS i, sum(o) AS o, sum(cw) AS cw, sum(cr) AS cr, sum(cost) AS cost,
    arg_max(label, (i + o + cw + cr) * 1000 - first_turn) AS primary_model
  FROM models GROUP BY path),
sessions AS (
  SELECT path, count(*) FILTER (WHERE role = 'user') AS turns, min(ts) AS started, max(ts) AS ended,
    bool_or(role = 'assistant') AS answered
  FROM costs GROUP BY path)
"""

_CODEX = f"""
WITH ev AS (
  SELECT path, event_id, k, event_type, @str(ts_ms) AS ts,
    CASE WHEN event_id % 5 <> 0 THEN event_id * 10000 + k * 1000 END AS inp,
    CASE WHEN event_id % 7 <> 0 THEN k * 3000 END AS cached,
    CASE WHEN event_id % 3 <> 0 THEN event_id * 1000 END AS outp,
    k * 1000 AS reason,
    CASE WHEN event_id % 2 = 0 THEN 0 ELSE event_id * 20000 END AS total,
    CASE event_id % 4 WHEN 0 THEN 'gpt-5' WHEN 1 THEN 'gpt-4o-mini-2026' WHEN 2 THEN 'o3' END AS model
  FROM v_events),
agg AS (
  SELECT path,
    count(*) FILTER (WHERE event_type = 'purchase') > 0 AS observed,
    coalesce(arg_max(inp, event_id) FILTER (WHERE event_type = 'purchase' AND inp IS NOT NULL), 0) AS all_input,
    coalesce(arg_max(cached, event_id) FILTER (WHERE event_type = 'purchase' AND cached IS NOT NULL), 0) AS cached,
    coalesce(arg_max(outp, event_id) FILTER (WHERE event_type = 'purchase' AND outp IS NOT NULL), 0) AS outp,
    coalesce(arg_max(reason, event_id) FILTER (WHERE event_type = 'purchase'), 0) AS reason,
    coalesce(arg_max(total, event_id) FILTER (WHERE event_type = 'purchase'), 0) AS total,
    coalesce(arg_min(model, event_id) FILTER (WHERE event_type = 'signup' AND model IS NOT NULL), 'unknown') AS model,
    count(*) FILTER (WHERE event_type = 'click') AS turns,
    min(ts) FILTER (WHERE event_type <> 'error') AS started, max(ts) FILTER (WHERE event_type <> 'error') AS ended,
    bool_or(event_type = 'view') AS answered
  FROM ev GROUP BY path),
usage AS (
  SELECT *, greatest(0, all_input - cached) AS fresh, lower(model) AS m FROM agg),
priced AS (SELECT *, {PRICE_CASES} AS p FROM usage)
"""


def _chat(spark, sf_dir):
    return typed_records(view(spark, sf_dir, "v_records", heavy=True).drop("conv_id"))


def _codex(spark, sf_dir):
    return typed_records(view(spark, sf_dir, "v_codex", heavy=True))


def _money(name):
    return F.round(name, 6).alias(name)


def _count(name):
    return F.col(name).cast("bigint").alias(name)


@query(_FACTS + """
SELECT s.path, round(coalesce(t.cost, 0), 6) AS total_cost_usd,
  CASE WHEN round(coalesce(t.cost, 0), 6) < 0.01 THEN 'excluded'
       WHEN round(coalesce(t.cost, 0), 6) < 10 THEN 'metadata' ELSE 'full' END AS tier,
  @big(s.turns) AS turn_count, t.primary_model
FROM sessions s LEFT JOIN totals t USING (path)
WHERE s.answered
""")
def session_cost_and_tier(spark, sf_dir):
    """Cost and tier of every answered session, most expensive first."""
    m = U.session_metrics(_chat(spark, sf_dir)).where("has_answer")
    m = m.withColumn("total_cost_usd", F.round("total_cost_usd", 6))
    return (
        U.with_tier(m)
        .select("path", "total_cost_usd", "tier", "turn_count", "primary_model")
        .orderBy(F.col("total_cost_usd").desc(), "path")
    )


@query(_FACTS + f"""
SELECT s.path, round(coalesce(t.cost, 0), 6) AS total_cost_usd,
  @big(coalesce(t.i + t.o + t.cw + t.cr, 0)) AS total_tokens, @big(coalesce(t.i, 0)) AS input_tokens,
  @big(coalesce(t.o, 0)) AS output_tokens, @big(coalesce(t.cw, 0)) AS cache_creation_tokens,
  @big(coalesce(t.cr, 0)) AS cache_read_tokens, @big(s.turns) AS turn_count,
  s.started AS started_at, s.ended AS ended_at, t.primary_model,
  {VENDOR_CASES.format('t.primary_model')} AS model_provider
FROM sessions s LEFT JOIN totals t USING (path)
""")
def session_metrics(spark, sf_dir):
    m = U.message_metrics(_chat(spark, sf_dir))
    return m.select(
        "path", _money("total_cost_usd"), _count("total_tokens"), _count("input_tokens"),
        _count("output_tokens"), _count("cache_creation_tokens"), _count("cache_read_tokens"),
        "turn_count", "started_at", "ended_at", "primary_model", "model_provider",
    )


@query(_FACTS + """
SELECT path, label AS model, @big(i) AS input_tokens, @big(o) AS output_tokens,
  @big(cw) AS cache_creation_tokens, @big(cr) AS cache_read_tokens, round(cost, 6) AS cost_usd
FROM models
""")
def session_model_usage(spark, sf_dir):
    m = U.session_model_usage(_chat(spark, sf_dir))
    return m.select(
        "path", "model", _count("input_tokens"), _count("output_tokens"),
        _count("cache_creation_tokens"), _count("cache_read_tokens"), _money("cost_usd"),
    )


@query(_FACTS + "SELECT path, round(sum(cost), 6) AS total_cost_usd FROM costs GROUP BY path")
def session_cost(spark, sf_dir):
    return U.session_cost(_chat(spark, sf_dir)).select("path", _money("total_cost_usd"))


@query(_FACTS + f"""
SELECT label AS model, {VENDOR_CASES.format('label')} AS vendor, @big(count(*)) AS records,
  round(sum(cost), 6) AS cost_usd, round(max(cost), 6) AS max_cost_usd
FROM costs WHERE role = 'assistant' GROUP BY label
""")
def model_pricing(spark, sf_dir):
    r = _chat(spark, sf_dir).where("role = 'assistant' AND has_usage")
    r = r.withColumn("cost", U.record_cost(r)).withColumn("m", F.coalesce("model", F.lit("unknown")))
    return r.groupBy(F.col("m").alias("model")).agg(
        F.min(model_vendor(F.col("m"))).alias("vendor"),
        F.count("*").alias("records"),
        F.round(F.sum("cost"), 6).alias("cost_usd"),
        F.round(F.max("cost"), 6).alias("max_cost_usd"),
    )


@query("""
WITH names AS (
  SELECT CASE p_partkey % 13 WHEN 0 THEN 'GPT-4o-mini' WHEN 1 THEN 'gpt-4o-2024' WHEN 2 THEN 'gpt-4' WHEN 3 THEN 'o3-mini-high'
    WHEN 4 THEN 'o4-mini' WHEN 5 THEN 'o4' WHEN 6 THEN 'o1-preview' WHEN 7 THEN 'o3' WHEN 8 THEN 'o3x' WHEN 9 THEN 'claude-3-opus'
    WHEN 10 THEN 'HAIKU' WHEN 11 THEN 'gpt-5' ELSE p_name END AS model, p_size FROM part),
priced AS (SELECT model, p_size, lower(model) AS m FROM names)
SELECT model, @big(count(*)) AS n, round(sum(p_size * 1000 * p[1] + p_size * 2000 * p[2] + p_size * 3000 * p[3] + p_size * 4000 * p[4]) / 1000000, 6) AS cost_usd,
  any_value(vendor) AS vendor
FROM (SELECT *, """ + PRICE_CASES + " AS p, " + VENDOR_CASES.format("model") + """ AS vendor FROM priced)
GROUP BY model
""")
def price_lookup(spark, sf_dir):
    names = ["GPT-4o-mini", "gpt-4o-2024", "gpt-4", "o3-mini-high", "o4-mini", "o4", "o1-preview",
             "o3", "o3x", "claude-3-opus", "HAIKU", "gpt-5"]
    slot = (F.col("p_partkey") % 13).cast("int")
    model = F.coalesce(F.get(F.array(*[F.lit(n) for n in names]), slot), F.col("p_name"))
    size = F.col("p_size").cast("double")
    p = table(spark, sf_dir, "part").select(model.alias("model"), size.alias("s"))
    cost = token_cost(F.col("model"), F.col("s") * 1000, F.col("s") * 2000, F.col("s") * 3000, F.col("s") * 4000)
    return p.groupBy("model").agg(
        F.count("*").alias("n"),
        F.round(F.sum(cost), 6).alias("cost_usd"),
        F.min(model_vendor(F.col("model"))).alias("vendor"),
    )


@query(_FACTS + """
SELECT s.path, round(coalesce(t.cost, 0), 6) AS total_cost_usd
FROM sessions s LEFT JOIN totals t USING (path)
WHERE s.path LIKE '%worktrees%' OR (s.answered AND coalesce(t.cost, 0) >= 2.5)
""")
def answered_and_costly(spark, sf_dir):
    """Trivial and cheap sessions dropped; worktree sessions stand in for unchanged ones."""
    m = U.message_metrics(_chat(spark, sf_dir)).withColumn(
        "kind", F.when(F.contains("path", F.lit("worktrees")), "unchanged").otherwise("new")
    )
    return U.drop_cheap(U.drop_trivial(m), 2.5).select("path", _money("total_cost_usd"))


@query(_CODEX + f"""
SELECT path,
  CASE WHEN observed THEN round((fresh * p[1] + cached * p[3] + outp * p[4]) / 1000000, 6) ELSE 0 END AS total_cost_usd,
  @big(CASE WHEN observed THEN coalesce(nullif(total, 0), fresh + cached + outp) ELSE 0 END) AS total_tokens,
  @big(CASE WHEN observed THEN fresh ELSE 0 END) AS input_tokens,
  @big(CASE WHEN observed THEN outp ELSE 0 END) AS output_tokens,
  @big(CASE WHEN observed THEN cached ELSE 0 END) AS cache_read_tokens,
  @big(CASE WHEN observed THEN reason ELSE 0 END) AS reasoning_tokens,
  @big(turns) AS turn_count, started AS started_at, ended AS ended_at,
  CASE WHEN observed THEN model END AS primary_model,
  CASE WHEN observed THEN {VENDOR_CASES.format('model')} END AS model_provider, answered AS has_answer
FROM priced
""")
def codex_session_metrics(spark, sf_dir):
    m = U.codex_metrics(_codex(spark, sf_dir))
    return m.select(
        "path", _money("total_cost_usd"), _count("total_tokens"), _count("input_tokens"),
        _count("output_tokens"), _count("cache_read_tokens"), _count("reasoning_tokens"),
        "turn_count", "started_at", "ended_at", "primary_model", "model_provider", "has_answer",
    )


@query("""
WITH ev AS (
  SELECT path, event_id,
    CASE WHEN event_type = 'purchase' AND event_id % 5 <> 0 THEN event_id * 10000 + k * 1000 END AS inp,
    CASE WHEN event_type = 'purchase' AND event_id % 7 <> 0 THEN k * 3000 END AS cached
  FROM v_events)
SELECT path, @big(event_id + 1) AS line_no,
  @big(last_value(inp IGNORE NULLS) OVER w) AS running_input, @big(last_value(cached IGNORE NULLS) OVER w) AS running_cached
FROM ev WINDOW w AS (PARTITION BY path ORDER BY event_id ROWS UNBOUNDED PRECEDING)
""")
def codex_running_totals(spark, sf_dir):
    r = U.running_totals(_codex(spark, sf_dir), ["total_input_tokens", "total_cached_tokens"])
    return r.where("line_no > 0").select(
        "path", "line_no",
        F.col("running_total_input_tokens").cast("bigint").alias("running_input"),
        F.col("running_total_cached_tokens").cast("bigint").alias("running_cached"),
    )


@query("""
WITH texts AS (
  SELECT doc_id, '{"sessionId":"d' || @str(doc_id) || '"}' || chr(13) || chr(10) || ' ' || chr(10) || text || chr(10)
    || '  {"n":' || @str(n_chars) || '} ' AS body FROM documents),
ls AS (
  SELECT doc_id, unnest(string_split_regex(body, '\r?\n')) AS line, generate_subscripts(string_split_regex(body, '\r?\n'), 1) - 1 AS line_no FROM texts),
trimmed AS (SELECT doc_id, @big(line_no) AS line_no, trim(line, ' ' || chr(9)) AS line FROM ls)
SELECT doc_id, line_no, NOT json_valid(line) AS is_malformed, @big(length(line)) AS n,
  CASE WHEN json_valid(line) THEN json_extract_string(line, '$.sessionId') END AS native_id
FROM trimmed WHERE line <> ''
""")
def ndjson_records(spark, sf_dir):
    """Whole document texts as session files: a JSON head, the text's own lines, a JSON tail."""
    texts = table(spark, sf_dir, "documents", heavy=True).select(
        "doc_id",
        F.concat(
            F.lit('{"sessionId":"d'), F.col("doc_id").cast("string"), F.lit('"}\r\n \n'), F.col("text"),
            F.lit('\n  {"n":'), F.col("n_chars").cast("string"), F.lit("} "),
        ).alias("text"),
    )
    r = typed_records(explode_ndjson(texts))
    kept = F.when(F.col("is_malformed"), F.get_json_object("raw", "$._raw")).otherwise(F.col("raw"))
    return r.select(
        "doc_id", "line_no", "is_malformed", F.length(kept).cast("bigint").alias("n"), "native_id"
    )


@query("""
WITH e AS (SELECT o_orderkey, o_custkey % 5 AS n FROM orders WHERE o_orderkey % 10 <> 0),
i AS (SELECT o_orderkey, unnest(range(n)) AS line_no FROM e)
SELECT o_orderkey AS file_id, @big(line_no) AS line_no, @big(o_orderkey * 10 + line_no) AS id FROM i
""")
def json_array_records(spark, sf_dir):
    """Files that hold one JSON array; every tenth holds something else and yields nothing."""
    o = table(spark, sf_dir, "orders")
    ids = F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(4)), lambda i: i < F.col("o_custkey") % 5),
        lambda i: F.concat(F.lit('{"id":'), (F.col("o_orderkey") * 10 + i).cast("string"), F.lit("}")),
    )
    array = F.concat(F.lit("["), F.array_join(ids, ", "), F.lit("]"))
    broken = F.when(F.col("o_orderkey") % 20 == 0, F.lit('{"id":1}')).otherwise(F.concat(array, F.lit(" x")))
    text = F.when(F.col("o_orderkey") % 10 == 0, broken).otherwise(array)
    r = explode_json_array(o.select(F.col("o_orderkey").alias("file_id"), text.alias("text")))
    return r.select("file_id", "line_no", F.get_json_object("raw", "$.id").cast("bigint").alias("id"))


_UUID5 = """
  (substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-'
   || substr('89ab', CAST(('0x' || substr(h, 17, 1))::INT % 4 AS INT) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12))"""
_HASHED = "sha1(unhex('6e1f93b25a0e5c3a9b7e2f0a8c4d6e10') || encode({0})) AS h"


@query(f"""
WITH chat AS (
  SELECT 'claude-code' AS source_kind, path, arg_min(native_id, turn) AS native_session_id,
    max(CASE WHEN turn >= 1 THEN '/Users/dev/proj' || @str(conv_id % 7) || '/pkg' || @str(conv_id % 3) END) AS session_cwd,
    max(CASE WHEN turn % 2 = 1 THEN 'feature/' || @str(conv_id % 9) END) AS recorded_branch,
    contains(path, '--claude-worktrees-') AS copy, {_HASHED.format('path')}
  FROM v_lines GROUP BY path),
codex AS (
  SELECT DISTINCT 'codex' AS source_kind, path, CASE WHEN user_id % 3 = 0 THEN @str(user_id) ELSE @uuid('u' || @str(user_id)) END AS native_session_id,
    '/srv/u' || @str(user_id) AS session_cwd, 'b' || @str(user_id % 5) AS recorded_branch, false AS copy, {_HASHED.format('path')}
  FROM v_events),
a AS (SELECT * FROM chat UNION ALL SELECT * FROM codex),
b AS (SELECT *, NOT copy AND regexp_matches(native_session_id, '^[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}$') AS reuse FROM a)
SELECT source_kind, path, native_session_id, session_cwd, recorded_branch,
  CASE WHEN reuse THEN native_session_id ELSE {_UUID5} END AS session_id,
  CASE WHEN reuse THEN 'native' ELSE 'path-hash' END AS derivation
FROM b
""")
def session_identity(spark, sf_dir):
    records = _chat(spark, sf_dir).unionByName(_codex(spark, sf_dir))
    return I.resolve_identity(I.session_facts(records)).select(
        "source_kind", "path", "native_session_id", "session_cwd", "recorded_branch", "session_id", "derivation"
    )


@query(f"""
SELECT conv_id, turn, regexp_matches(lower(native_id), '^[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}$') AS native_is_uuid, {_UUID5} AS path_uuid
FROM (SELECT conv_id, turn, native_id, {_HASHED.format("path || '#' || @str(turn)")} FROM v_lines)
""")
def path_uuids(spark, sf_dir):
    v = view(spark, sf_dir, "v_lines")
    key = F.concat("path", F.lit("#"), F.col("turn").cast("string"))
    return v.select(
        "conv_id", "turn", is_uuid(F.col("native_id")).alias("native_is_uuid"), session_uuid(key).alias("path_uuid")
    )


@query("""
SELECT session_id, source_kind, arg_min(doc_id, (-mtime_ms, path)) AS doc_id, @big(max(mtime_ms)) AS mtime
FROM v_sessions GROUP BY session_id, source_kind
""")
def newest_per_session(spark, sf_dir):
    s = view(spark, sf_dir, "v_sessions").select("source_kind", "session_id", "path", "mtime_ms", "doc_id")
    return I.newest_per_session(s).select(
        "session_id", "source_kind", "doc_id", F.round("mtime_ms").cast("bigint").alias("mtime")
    )


@query("""
SELECT conv_id, turn,
  CASE WHEN conv_id % 5 = 0 THEN 'w' || @str(conv_id % 3) END AS worktree,
  '-Users-dev-proj' || @str(conv_id % 7) AS root_name,
  '/Users/dev/proj' || @str(conv_id % 7) AS decoded,
  CASE WHEN turn % 3 = 0 THEN @str(conv_id) END AS segment,
  '/Users/dev/s' || @str(turn) || '.vscdb' AS store,
  CASE WHEN conv_id % 2 = 0 THEN 'c' || @str(conv_id) END AS composer,
  '/home/d' || @str(conv_id) || '/app' AS transcript_cwd,
  '-a-b' || @str(conv_id) || '-c' || @str(turn) AS encoded
FROM v_lines
""")
def path_parts(spark, sf_dir):
    v = view(spark, sf_dir, "v_lines")
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    marked = F.when(
        F.col("turn") % 3 == 0, F.concat(F.lit("C:\\x\\agent-transcripts\\old\\agent-transcripts\\"), conv, F.lit("\\s.jsonl"))
    ).otherwise(F.lit("/x/agent-transcripts/"))
    store = F.concat(F.lit("/Users/dev/s"), turn, F.lit(".vscdb"))
    ref = F.when(F.col("conv_id") % 2 == 0, F.concat(store, F.lit("::composer::c"), conv)).otherwise(store)
    transcript = F.concat(F.lit("/u/.cursor/projects/home-d"), conv, F.lit("-app/agent-transcripts/1/1.jsonl"))
    name = P.worktree_root(P.parent_name(F.col("path")))
    return v.select(
        "conv_id", "turn",
        P.worktree_path(F.col("path")).alias("worktree"),
        name.alias("root_name"),
        P.decode_dir(name).alias("decoded"),
        P.segment_after(marked, "/agent-transcripts/").alias("segment"),
        P.physical_path(ref).alias("store"),
        P.composer_id(ref).alias("composer"),
        P.transcript_cwd(transcript).alias("transcript_cwd"),
        P.encode_dir(F.concat(F.lit("/a.b"), conv, F.lit("/c"), turn)).alias("encoded"),
    )


@query("""
SELECT path, @sha256('v0.2/chunks' || chr(10) || string_agg(digest, '' ORDER BY chunk)) AS content_hash, @big(sum(n)) AS record_count
FROM (SELECT path, line_no // 65536 AS chunk, @sha256('v0.2' || chr(10) || '[' || string_agg(raw, ',' ORDER BY line_no) || ']') AS digest, count(*) AS n
      FROM v_records GROUP BY ALL) GROUP BY path
""")
def session_content_hash(spark, sf_dir):
    return content_hash(view(spark, sf_dir, "v_records", heavy=True), ["path"])


@query("""
SELECT doc_id, @sha256('v0.2/chunks' || chr(10) || @sha256('v0.2' || chr(10) || '[{"doc":' || @str(doc_id) || '},' || raw || ',{"_raw":"tail ' || @str(doc_id) || '"}]')) AS content_hash
FROM v_files
""")
def file_content_hash(spark, sf_dir):
    """The same hash inside one row, for files read whole."""
    doc = F.col("doc_id").cast("string")
    text = F.concat(F.lit('{"doc":'), doc, F.lit("}\r\n\n "), F.col("raw"), F.lit("\ntail "), doc, F.lit("\n"))
    return view(spark, sf_dir, "v_files", heavy=True).select("doc_id", content_hash_of_text(text).alias("content_hash"))


@query("""
WITH m AS (SELECT DISTINCT CASE (conv_id + turn) % 6 WHEN 0 THEN 'claude-opus-4' WHEN 1 THEN 'claude-sonnet-4'
  WHEN 2 THEN 'claude-haiku-4-5' WHEN 3 THEN 'gpt-5-codex' WHEN 4 THEN '' ELSE 'gemini-2.5-pro' END AS model FROM conversations)
SELECT model, @big(CASE WHEN model LIKE '%opus%' THEN 7 WHEN model LIKE '%haiku%' THEN 8 WHEN model LIKE 'gpt-5-%' THEN 2 ELSE 9 END) AS rule FROM m
""")
def price_rules_used(spark, sf_dir):
    m = view(spark, sf_dir, "v_lines").select("model").distinct()
    return m.select("model", price_rule(F.col("model")).cast("bigint").alias("rule"))
