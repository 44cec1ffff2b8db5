"""Queries over manifests, requests, triggers and recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionmill.functions import failures as Y
from sessionmill.functions import text as T
from sessionmill.operators import manifest as M
from sessionmill.operators import recommendations as Z
from sessionmill.operators import reports as R
from sessionmill.plans.registry import query
from sessionmill.plans.views import table, view
from sessionmill.streaming import cooldown as W


def _entries(spark, sf_dir):
    return view(spark, sf_dir, "v_entries")


@query("""
SELECT manifest_id, @big(count(*) FILTER (WHERE status = 'acked')) AS uploaded,
  @big(count(*) FILTER (WHERE failure_reason IS NOT NULL AND status <> 'acked')) AS failed,
  @big(count(*) FILTER (WHERE skipped_reason IS NOT NULL AND status <> 'acked')) AS skipped, @big(count(*)) AS total
FROM v_entries GROUP BY manifest_id""")
def report_counts(spark, sf_dir):
    return R.report_counts(_entries(spark, sf_dir))


_SHORT = "CASE WHEN length({0}) > 16 THEN substr({0}, 1, 9) || '…' || right({0}, 4) ELSE {0} END"


@query("""
WITH f AS (SELECT *, """ + _SHORT.format("session_id") + """ AS short_id FROM v_entries WHERE failure_reason IS NOT NULL AND status <> 'acked'),
g AS (SELECT manifest_id, failure_reason AS reason, count(*) AS sessions, string_split(arg_min(short_id, (entry_no, session_id)), '…')[1] AS head FROM f GROUP BY ALL)
SELECT manifest_id, reason, CASE reason WHEN 'parse' THEN 0 WHEN 'conflict' THEN 1 WHEN 'presign-expired' THEN 2 WHEN 'network' THEN 3 WHEN 'anonymization' THEN 4 ELSE 5 END AS reason_order,
  CASE reason WHEN 'parse' THEN 'Fix the source file or exclude ' || head || ' and run again.' WHEN 'conflict' THEN 'Safe to ignore; clears on the next run.'
    WHEN 'presign-expired' THEN 'Transient; the next run asks for a new URL.' WHEN 'network' THEN 'Transient; the next run tries again.'
    WHEN 'anonymization' THEN 'Inspect the source of ' || head || '.' ELSE 'Run again; report it if it stays.' END AS remedy, @big(sessions) AS sessions
FROM g""")
def failure_groups(spark, sf_dir):
    """Failures per manifest by reason, in report order."""
    groups = R.failure_groups(_entries(spark, sf_dir))
    return R.in_report_order(groups).select("manifest_id", "reason", "reason_order", "remedy", "sessions")


@query("SELECT manifest_id, session_id, " + _SHORT.format("session_id") + " AS short_id, failure_reason FROM v_entries WHERE failure_reason IS NOT NULL AND status <> 'acked'")
def failed_sessions(spark, sf_dir):
    return R.failed_entries(_entries(spark, sf_dir)).select("manifest_id", "session_id", "short_id", "failure_reason")


@query("SELECT manifest_id, session_id, " + _SHORT.format("session_id") + " AS short_id, skipped_reason AS reason FROM v_entries WHERE skipped_reason IS NOT NULL AND status <> 'acked'")
def skipped_sessions(spark, sf_dir):
    return R.skipped_entries(_entries(spark, sf_dir))


@query("""
SELECT manifest_id, @big(count(*) FILTER (WHERE status = 'acked')) AS acked, @big(count(*) FILTER (WHERE status = 'skipped-on-resume')) AS skipped,
  @big(count(*) FILTER (WHERE f)) AS failed,
  CASE WHEN count(*) FILTER (WHERE f) = 0 THEN 'none'
    WHEN bool_and(NOT f OR failure_reason = 'anonymization') THEN 'anonymization'
    WHEN bool_and(NOT f OR failure_reason IN ('parse', 'anonymization')) THEN 'local' ELSE 'wire' END AS failure_class
FROM (SELECT *, status IN ('pending', 'in-flight') AND failure_reason IS NOT NULL AS f FROM v_entries) GROUP BY manifest_id""")
def batch_outcomes(spark, sf_dir):
    e = _entries(spark, sf_dir)
    failed = F.col("status").isin("pending", "in-flight") & F.col("failure_reason").isNotNull()
    outcome = (
        F.when(F.col("status") == "acked", "acked")
        .when(F.col("status") == "skipped-on-resume", "skipped")
        .when(failed, "failed")
    )
    return M.batch_outcome(e.select("manifest_id", outcome.alias("outcome"), F.col("failure_reason").alias("reason")))


@query("""
SELECT manifest_id, @big(count(*)) AS entries FROM v_entries GROUP BY manifest_id
HAVING count(*) FILTER (WHERE status IN ('pending', 'in-flight')) = 0""")
def finished_manifests(spark, sf_dir):
    return M.finished_manifests(_entries(spark, sf_dir))


@query("""
SELECT 'm' || @str(l_suppkey) AS manifest_id, 's' || @str(l_partkey) AS session_id, arg_max(status, (l_orderkey * 10000000 + entry_no * 100000 + l_partkey, status)) AS status
FROM v_entries GROUP BY l_suppkey, l_partkey""")
def latest_entry_states(spark, sf_dir):
    """Last state of each entry in a log of updates."""
    e = _entries(spark, sf_dir)
    log = e.select(
        F.concat(F.lit("m"), F.col("l_suppkey").cast("string")).alias("manifest_id"),
        F.concat(F.lit("s"), F.col("l_partkey").cast("string")).alias("session_id"),
        (F.col("l_orderkey") * 10000000 + F.col("entry_no") * 100000 + F.col("l_partkey")).alias("seq"),
        "status",
    )
    return M.latest_entries(log).select("manifest_id", "session_id", "status")


@query("""
WITH m AS (SELECT l_orderkey, 'm' || @str(l_orderkey) AS manifest_id, o_orderstatus, o_custkey FROM (SELECT DISTINCT l_orderkey FROM v_entries) JOIN orders ON o_orderkey = l_orderkey),
jobs AS (SELECT DISTINCT manifest_id, session_id FROM v_entries WHERE l_partkey % 50 <> 0
  UNION SELECT manifest_id, 'extra' FROM m WHERE o_custkey % 25 = 0),
unknown AS (SELECT manifest_id, count(*) AS n FROM jobs WHERE (manifest_id, session_id) NOT IN (SELECT (manifest_id, session_id) FROM v_entries) GROUP BY 1),
orphans AS (SELECT manifest_id, count(*) AS n FROM v_entries e WHERE status IN ('pending', 'in-flight') AND l_partkey % 50 = 0 GROUP BY 1)
SELECT manifest_id, @big(coalesce(u.n, 0)) AS unknown_jobs, @big(coalesce(o.n, 0)) AS orphan_entries,
  o_orderstatus <> 'P' AND u.n IS NULL AND o.n IS NULL AS resume
FROM m LEFT JOIN unknown u USING (manifest_id) LEFT JOIN orphans o USING (manifest_id)""")
def resumable_manifests(spark, sf_dir):
    """Which saved manifests cover the batch at hand."""
    e = _entries(spark, sf_dir)
    o = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("m"), F.col("o_orderkey").cast("string")).alias("manifest_id"), "o_orderstatus", "o_custkey"
    )
    same = F.lit("claude-code")
    entries = e.select(
        "manifest_id", "session_id", "status", same.alias("source_kind"), F.lit("https://x").alias("endpoint"), F.lit("u").alias("user_id")
    )
    batch = o.select(
        "manifest_id", F.when(F.col("o_orderstatus") == "P", "codex").otherwise(same).alias("run_source_kind"),
        F.lit("https://x").alias("run_endpoint"), F.lit("u").alias("run_user_id"),
    )
    extra = o.where("o_custkey % 25 = 0").select("manifest_id", F.lit("extra").alias("session_id"))
    extra = extra.join(e.select("manifest_id"), "manifest_id", "left_semi")
    jobs = e.where("l_partkey % 50 <> 0").select("manifest_id", "session_id").unionByName(extra).distinct()
    return M.resumable(entries, jobs, batch)


@query("""
SELECT session_id, CASE WHEN l_partkey % 9 = 0 THEN 'missing' WHEN l_partkey % 9 = 1 THEN 'modified' END AS skip_reason, @big(count(*)) AS n
FROM v_entries GROUP BY ALL""")
def resume_recheck(spark, sf_dir):
    """Entries whose file is gone or has changed since the manifest was made."""
    part = table(spark, sf_dir, "part").where("p_partkey % 9 <> 0")
    key = F.col("p_partkey").cast("string")
    text = F.when(F.col("p_partkey") % 9 == 1, F.concat(F.lit("new"), key)).otherwise(F.concat(F.lit("raw"), key))
    now = part.select(F.concat(F.lit("/f/"), key, F.lit(".jsonl")).alias("path"), F.sha2(text, 256).alias("raw_hash"))
    checked = M.recheck_entries(_entries(spark, sf_dir), now)
    return checked.groupBy("session_id", "skip_reason").agg(F.count("*").alias("n"))


_REQUESTS = """
WITH r AS (
  SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'AnonymizationError' WHEN 1 THEN 'PresignExpiredError' WHEN 2 THEN 'SyntaxError' WHEN 3 THEN 'Error' WHEN 4 THEN 'NetworkError' END AS cls,
    CASE WHEN k % 3 = 0 THEN 400 + k % 130 WHEN k % 3 = 1 THEN 500 + k % 20 END AS status,
    CASE WHEN event_type = 'view' THEN 'Unexpected token x' WHEN event_type = 'error' THEN 'malformed log' WHEN event_type = 'click' THEN 'sparse parser' ELSE 'boom' END AS msg
  FROM v_events),
w AS (SELECT *, msg IN ('Unexpected token x', 'malformed log') AS words FROM r)
"""


def _requests(spark, sf_dir):
    v = view(spark, sf_dir, "v_events")
    mode, k = F.col("event_id") % 6, F.col("k")
    cls = (
        F.when(mode == 0, "AnonymizationError").when(mode == 1, "PresignExpiredError").when(mode == 2, "SyntaxError")
        .when(mode == 3, "Error").when(mode == 4, "NetworkError")
    )
    status = F.when(k % 3 == 0, 400 + k % 130).when(k % 3 == 1, 500 + k % 20).cast("int")
    kind = F.col("event_type")
    msg = (
        F.when(kind == "view", "Unexpected token x").when(kind == "error", "malformed log")
        .when(kind == "click", "sparse parser").otherwise("boom")
    )
    return v.select("event_id", cls.alias("cls"), status.alias("status"), msg.alias("msg"))


@query(_REQUESTS + """
SELECT event_id,
  CASE WHEN cls = 'AnonymizationError' THEN 'anonymization' WHEN cls = 'PresignExpiredError' THEN 'presign-expired'
    WHEN cls = 'SyntaxError' OR (cls = 'Error' AND words) THEN 'parse' WHEN status = 409 THEN 'conflict' WHEN status = 403 THEN 'presign-expired'
    WHEN status IS NOT NULL OR cls IS NOT NULL THEN 'network' ELSE 'unknown' END AS reason,
  CASE WHEN cls IN ('AnonymizationError', 'PresignExpiredError', 'SyntaxError') OR (cls = 'Error' AND words) THEN msg
    WHEN status IS NOT NULL THEN 'HTTP ' || @str(status) WHEN cls IS NOT NULL THEN msg END AS message,
  status IS NULL OR status = 429 OR status BETWEEN 500 AND 599 AS retry
FROM w""")
def failure_reasons(spark, sf_dir):
    r = _requests(spark, sf_dir)
    args = (F.col("cls"), F.col("status"), F.col("msg"))
    return r.select(
        "event_id", Y.failure_reason(*args).alias("reason"), Y.failure_message(*args).alias("message"),
        Y.should_retry(F.col("status")).alias("retry"),
    )


_EVENTS = """
WITH ev AS (
  SELECT 'u' || @str(user_id % 20) AS manifest_id, event_id, CASE event_type WHEN 'signup' THEN 'upload-start' WHEN 'click' THEN 'session-start' WHEN 'view' THEN 'session-acked'
    WHEN 'error' THEN 'session-failed' ELSE 'session-skipped' END AS event, k FROM v_events)
"""


def _progress(spark, sf_dir):
    names = {"signup": "upload-start", "click": "session-start", "view": "session-acked", "error": "session-failed"}
    event = F.lit("session-skipped")
    for kind, name in names.items():
        event = F.when(F.col("event_type") == kind, name).otherwise(event)
    return view(spark, sf_dir, "v_events").select(
        F.concat(F.lit("u"), (F.col("user_id") % 20).cast("string")).alias("manifest_id"),
        "event_id", event.alias("event"), F.col("k").alias("expected_sessions"), F.col("event_id").cast("string").alias("session_id"),
    )


@query(_EVENTS + "SELECT manifest_id, event_id, event, @big(row_number() OVER (PARTITION BY manifest_id ORDER BY event_id) - 1) AS seq FROM ev")
def event_sequence(spark, sf_dir):
    """Gapless event numbers per manifest."""
    return R.with_sequence(_progress(spark, sf_dir), ["event_id"]).select("manifest_id", "event_id", "event", "seq")


@query(_EVENTS + """
SELECT manifest_id, @big(max(k) FILTER (WHERE event = 'upload-start')) AS total, @big(count(*) FILTER (WHERE event IN ('session-acked', 'session-failed', 'session-skipped'))) AS done,
  @big(count(*) FILTER (WHERE event = 'session-skipped')) AS skipped, @big(count(*) FILTER (WHERE event = 'session-failed')) AS failed
FROM ev GROUP BY manifest_id""")
def batch_states(spark, sf_dir):
    """Counters per manifest; every event is logged twice and counts once."""
    log = _progress(spark, sf_dir)
    return R.batch_state(log.unionByName(log))


# The chain of starts per endpoint, walked step by step.
_COOLDOWN = """
WITH RECURSIVE open AS (
  SELECT * FROM v_triggers WHERE logged_in AND NOT coalesce(blocked_until_ms > ts_ms, false)),
chain AS (
  SELECT endpoint, min(ts_ms) AS ts_ms FROM open GROUP BY endpoint
  UNION ALL
  SELECT c.endpoint, (SELECT min(o.ts_ms) FROM open o WHERE o.endpoint = c.endpoint AND o.ts_ms >= c.ts_ms + 120000)
  FROM chain c WHERE c.ts_ms IS NOT NULL),
started AS (SELECT endpoint, ts_ms FROM chain WHERE ts_ms IS NOT NULL)
"""


@query(_COOLDOWN + "SELECT endpoint, ts_ms FROM started")
def started_uploads(spark, sf_dir):
    """Triggers that start an upload: no other start within two minutes before."""
    t = view(spark, sf_dir, "v_triggers")
    open_ = t.where(F.col("logged_in") & ~W.blocked(F.col("blocked_until_ms"), F.col("ts_ms")))
    return W.started_triggers(open_)


@query(_COOLDOWN + """,
firsts AS (SELECT endpoint, ts_ms, min(trigger_id) AS trigger_id FROM open JOIN started USING (endpoint, ts_ms) GROUP BY endpoint, ts_ms)
SELECT t.trigger_id, t.endpoint, CASE WHEN NOT logged_in THEN 'not_logged_in' WHEN blocked_until_ms > t.ts_ms THEN 'blocked'
  WHEN f.trigger_id IS NOT NULL THEN 'spawned' ELSE 'cooldown' END AS action
FROM v_triggers t LEFT JOIN firsts f ON f.endpoint = t.endpoint AND f.trigger_id = t.trigger_id""")
def hook_actions(spark, sf_dir):
    return W.hook_actions(view(spark, sf_dir, "v_triggers")).select("trigger_id", "endpoint", "action")


@query("SELECT endpoint, @big(max(ts_ms) + 43200000) AS blocked_until_ms FROM v_triggers WHERE NOT logged_in GROUP BY endpoint")
def block_verdicts(spark, sf_dir):
    t = view(spark, sf_dir, "v_triggers")
    return W.block_verdicts(t.withColumn("blocked", ~F.col("logged_in")))


def _recs(spark, sf_dir):
    return view(spark, sf_dir, "v_recs")


@query("""
SELECT id, @big(row_number() OVER (ORDER BY estimated_savings_usd DESC, id)) AS rank FROM v_recs""")
def ranked_recommendations(spark, sf_dir):
    return Z.ranked_by_savings(_recs(spark, sf_dir)).select("id", "rank")


@query("""
SELECT id, org_id, @big(row_number() OVER (PARTITION BY org_id ORDER BY estimated_savings_usd DESC, id)) AS rank FROM v_recs WHERE status = 'open'""")
def ranked_recommendations_per_org(spark, sf_dir):
    open_ = _recs(spark, sf_dir).where("status = 'open'")
    return Z.ranked_by_savings(open_, ["org_id"]).select("id", "org_id", "rank")


@query("SELECT status, @big(count(*)) AS recommendations, round(sum(CAST(estimated_savings_usd AS DECIMAL(18, 2))), 2)::DOUBLE AS total_usd FROM v_recs GROUP BY status")
def recommendation_totals(spark, sf_dir):
    t = Z.savings_totals(_recs(spark, sf_dir))
    return t.withColumn("total_usd", F.round("total_usd", 2))


_IMPACT = """
WITH i AS (
  SELECT *, TRY_CAST(substr(id, 2) AS BIGINT) AS k FROM v_recs WHERE status = 'applied'),
m AS (
  SELECT id, k, CASE k % 4 WHEN 0 THEN 'not-started' WHEN 1 THEN 'measuring' ELSE 'available' END AS measurement,
    CASE WHEN k % 4 >= 2 THEN CASE WHEN k % 3 = 0 THEN 0 ELSE k % 100 END END::DOUBLE AS realized_usd, (k % 7 * 32)::DOUBLE AS base FROM i)
"""


def _applied(spark, sf_dir):
    k = F.substring("id", 2, 20).cast("bigint")
    impact = F.struct(
        (k % 7 * 32).cast("double").alias("baseline_cost_usd"),
        F.when(k % 3 != 0, k % 100).cast("double").alias("realized_savings_usd"),
        F.when(k % 4 == 1, "measuring").otherwise("available").alias("measurement_status"),
    )
    r = _recs(spark, sf_dir).where("status = 'applied'")
    return r.withColumn("impact", F.when(k % 4 != 0, impact))


@query(_IMPACT + """
SELECT id, measurement, realized_usd, CASE WHEN measurement = 'available' THEN CASE WHEN base > 0 THEN round(realized_usd / base, 6) ELSE 0 END END::DOUBLE AS realized_share FROM m""")
def recommendation_impact(spark, sf_dir):
    m = Z.impact(_applied(spark, sf_dir))
    return m.select("id", "measurement", "realized_usd", F.round("realized_share", 6).alias("realized_share"))


@query(_IMPACT + """
SELECT sum(realized_usd) AS realized_usd, @big(count(*) FILTER (WHERE measurement = 'measuring')) AS measuring,
  @big(count(*) FILTER (WHERE measurement = 'available')) AS available, @big(count(*) FILTER (WHERE measurement = 'not-started')) AS not_started FROM m""")
def recommendation_impact_totals(spark, sf_dir):
    return Z.impact_totals(_applied(spark, sf_dir))


@query("SELECT id FROM v_recs WHERE NOT (status = 'dismissed' AND o_orderdate + INTERVAL 30 DAY > TIMESTAMP '1997-06-15 00:00:00')")
def visible_recommendations(spark, sf_dir):
    """Dismissed ones stay hidden for 30 days."""
    r = _recs(spark, sf_dir).withColumn("dismissed_at", F.col("o_orderdate"))
    return Z.visible(r, F.lit("1997-06-15 00:00:00").cast("timestamp_ntz")).select("id")


@query(r"""
SELECT o_orderkey, CASE WHEN v < 0.01 THEN '<$0.01' ELSE '$' || printf('%.2f', v) END AS savings,
  CASE WHEN b < 1024 THEN @str(b) || ' B' WHEN b < 1048576 THEN printf('%.1f', b / 1024.0) || ' KB'
    WHEN b < 1073741824 THEN printf('%.1f', b / 1048576.0) || ' MB' ELSE printf('%.1f', b / 1073741824.0) || ' GB' END AS size,
  lower(trim(regexp_replace(o_orderpriority || '_x-y', '[_-]+', ' ', 'g'))) AS category,
  strftime(o_orderdate, '%b %-d, %H:%M') AS day, @ms(o_orderdate) AS ms,
  strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') AS iso, CAST(NULL AS BIGINT) AS bad_ms, 'a  b ' AS scrubbed
FROM (SELECT *, (o_orderkey % 5) * 0.25 AS v, o_orderkey * o_orderkey * 8 AS b FROM orders)""")
def display_values(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    ms = T.epoch_ms(iso)
    key = F.col("o_orderkey")
    return o.select(
        "o_orderkey",
        T.human_savings(key % 5 * 0.25).alias("savings"),
        T.human_bytes(key * key * 8).alias("size"),
        T.human_category(F.concat("o_orderpriority", F.lit("_x-y"))).alias("category"),
        T.report_date(iso).alias("day"),
        ms.alias("ms"),
        T.iso_millis(ms + 0.75).alias("iso"),
        T.epoch_ms(F.concat(F.lit("on "), iso)).alias("bad_ms"),
        T.scrub_control_chars(F.lit("a\u001b\u0085b\n")).alias("scrubbed"),
    )
