"""Queries that go through files, SQL functions and streams, all on data derived from the tables."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionmill.functions.sql_functions import register_sql_functions
from sessionmill.operators import reports as R
from sessionmill.operators import usage as U
from sessionmill.operators.ordering import durable, shared_folder
from sessionmill.operators.snapshots import snapshot_key
from sessionmill.plans.redaction_queries import (
    _MAIL,
    OWNER,
    UPLOAD_ID,
    _entropy_sql,
    _interleave_sql,
    _pseudonym_sql,
    context,
)
from sessionmill.plans.registry import query
from sessionmill.plans.report_queries import _COOLDOWN, _EVENTS, _progress
from sessionmill.plans.upload import ListedFiles, UploadRun, all_acked, read_listed, resume_upload, run_upload, saved_states
from sessionmill.plans.usage_queries import _FACTS, _HASHED, _UUID5
from sessionmill.plans.views import table, view
from sessionmill.sources import ledger as L
from sessionmill.sources.files import kept_listing, list_files, raw_hashes
from sessionmill.sources.git_files import git_dir_files
from sessionmill.sources.records import file_hashes, read_ndjson, typed_records
from sessionmill.sources.sinks import write_bodies, write_events
from sessionmill.streaming.acks import settle_entries
from sessionmill.streaming.ingest import ingest_listings
from sessionmill.streaming.state import output
from sessionmill.streaming.triggers import gate_blocked, gate_progress, gate_snapshots, gate_triggers


def _folder(spark: SparkSession, name: str) -> str:
    """A folder of its own for each call, below the cluster's shared one."""
    return f"{shared_folder(spark)}/sessionmill/{name}-{uuid.uuid4().hex}"


def _chat_files(spark: SparkSession, sf_dir: str, out: str) -> str:
    """Chat sessions written as NDJSON files; returns the glob of the files."""
    r = view(spark, sf_dir, "v_records").select(
        F.concat(F.lit("p"), (F.col("conv_id") % 7).cast("string")).alias("manifest_id"),
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("session_id"),
        "line_no", "raw",
    )
    write_bodies(r, out)
    return f"{out}/*/*/*.txt"


# Hashes of the session files, from the lines they are made of.
_FILE_HASHES = """
hashes AS (
  SELECT conv_id, @sha256('v0.2/chunks' || chr(10) || @sha256('v0.2' || chr(10) || '[' || string_agg(raw, ',' ORDER BY line_no) || ']')) AS content_hash,
    @sha256('v1/blocks' || chr(10) || @str(sum(strlen(raw) + 1)) || chr(10) || @sha256(@sha256(string_agg(raw || chr(10), '' ORDER BY line_no)))) AS raw_hash,
    @big(count(*)) AS n_records
  FROM v_records GROUP BY conv_id)
"""


@query(_FACTS + "," + _FILE_HASHES + """
SELECT s.conv_id, round(coalesce(t.cost, 0), 6) AS total_cost_usd, @big(s.turns) AS turn_count, t.primary_model, content_hash
FROM (SELECT path, conv_id, count(*) FILTER (WHERE role = 'user') AS turns FROM costs GROUP BY path, conv_id) s LEFT JOIN totals t USING (path) JOIN hashes USING (conv_id)""")
def scanned_session_files(spark, sf_dir):
    """Metrics and hashes of sessions read back from NDJSON files, small ones whole and larger ones in splits."""
    glob = _chat_files(spark, sf_dir, _folder(spark, "files"))
    records = read_ndjson(spark, glob, "claude-code", whole_limit=8192)
    # Files are opened and parsed once, for the metrics and for the hashes.
    typed = durable(typed_records(records).drop("raw"))
    m = U.session_metrics(typed).join(file_hashes(typed, texts=records), ["source_kind", "path"])
    return m.select(
        _conv().alias("conv_id"), F.round("total_cost_usd", 6).alias("total_cost_usd"), "turn_count", "primary_model", "content_hash"
    )


@query("WITH " + _FILE_HASHES + "SELECT conv_id, n_records, raw_hash FROM hashes")
def listed_records(spark, sf_dir):
    """Records of listed files only; one listed file is gone and does no harm."""
    glob = _chat_files(spark, sf_dir, _folder(spark, "listed"))
    listing = list_files(spark, glob, "claude-code")
    gone = listing.limit(1).withColumn("path", F.lit("/gone/[x]/{a,b}/*.jsonl"))
    records = read_listed(listing.unionByName(gone), {"claude-code": glob})
    return records.groupBy(_conv().alias("conv_id")).agg(F.count("*").alias("n_records"), F.max("raw_hash").alias("raw_hash"))


@query("""
SELECT conv_id, 'claude-code' AS source_kind, @big(sum(strlen(raw)) + count(*)) AS size_bytes FROM v_records GROUP BY conv_id""")
def listed_session_files(spark, sf_dir):
    glob = _chat_files(spark, sf_dir, _folder(spark, "listing"))
    return list_files(spark, glob, "claude-code").select(
        F.regexp_extract("path", "body=c([0-9]+)/", 1).cast("bigint").alias("conv_id"), "source_kind", "size_bytes"
    )


_SENT = _FACTS + "," + _FILE_HASHES + """,
ids AS (SELECT path, conv_id, arg_min(native_id, turn) AS native FROM v_lines GROUP BY path, conv_id),
s AS (
  SELECT ids.conv_id, round(coalesce(t.cost, 0), 6) AS cost, b.answered,
    CASE WHEN native LIKE 'legacy-%' THEN 'c' || @str(ids.conv_id) ELSE native END AS sid
  FROM ids JOIN sessions b USING (path) LEFT JOIN totals t USING (path)),
kept AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY sid ORDER BY conv_id DESC) = 1),
sent AS (SELECT * FROM kept JOIN hashes USING (conv_id) WHERE answered AND cost >= 0.01)
"""


def _conv() -> F.Column:
    return F.regexp_extract("path", "body=c([0-9]+)/", 1).cast("bigint")


def _chat_run(spark, sf_dir, name):
    """A listing of the session files, a way to read them, and a run that sends them."""
    folder = _folder(spark, name)
    glob = _chat_files(spark, sf_dir, f"{folder}/files")
    found = kept_listing(spark, glob, "claude-code")
    listing = found.withColumn("mtime_ms", _conv().cast("double")).drop("machine_id")
    run = UploadRun("r1", f"{folder}/out", f"{folder}/ledger", context(), "2026-01-01T00:00:00.000Z")
    return listing, ListedFiles({"claude-code": glob}, found={"claude-code": found}), run


@query(_SENT + """
SELECT conv_id, 'new' AS kind, CASE WHEN cost < 10 THEN 'metadata' ELSE 'full' END AS tier, CASE WHEN cost < 10 THEN cost END AS cost_usd, content_hash, raw_hash
FROM sent""")
def upload_run(spark, sf_dir):
    """A whole upload run over session files: classify, price, redact, audit, write, upsert."""
    listing, read, run = _chat_run(spark, sf_dir, "upload")
    run_upload(listing, read, run)
    return spark.read.parquet(f"{run.folder}/entries").select(
        _conv().alias("conv_id"), "kind", "tier", F.round("total_cost_usd", 6).alias("cost_usd"), "content_hash", "raw_hash"
    )


@query(_SENT + """
SELECT conv_id, 'r1' AS run, CASE WHEN conv_id % 3 = 0 THEN 'acked' ELSE 'pending' END AS status, CASE WHEN conv_id % 3 = 0 THEN 'r1-claude' ELSE 'r2-claude' END AS ledger FROM sent
UNION ALL SELECT conv_id, 'r2', 'acked', 'r2-claude' FROM sent WHERE conv_id % 3 <> 0""")
def resumed_run(spark, sf_dir):
    """A delivery that answers a third of the entries, then a run that sends the rest; and a repeat of it."""
    listing, read, run = _chat_run(spark, sf_dir, "resume")
    run_upload(listing, read, run, deliver=lambda entries: all_acked(entries.where(_conv() % 3 == 0)))
    again = replace(run, run_id="r2")
    run_upload(listing, read, again)
    run_upload(listing, read, again)  # committed already: nothing moves
    states = None
    for one in (run, again):
        entries = spark.read.parquet(f"{one.folder}/entries").select("session_id", _conv().alias("conv_id"))
        part = spark.read.parquet(f"{one.folder}/states").join(entries, "session_id").select(
            "session_id", "conv_id", F.lit(one.run_id).alias("run"), "status"
        )
        states = part if states is None else states.unionByName(part)
    ledger = L.read_ledger(spark, run.ledger_path).select("session_id", F.col("manifest_id").alias("ledger"))
    return states.join(ledger, "session_id").drop("session_id")


@query(_SENT + """
SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 0 ELSE 1 END AS attempt, CASE WHEN conv_id % 3 <> 0 AND conv_id % 5 < 2 THEN 'skipped' ELSE 'acked' END AS status,
  CASE WHEN conv_id % 3 <> 0 THEN CASE conv_id % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'modified' END END AS reason,
  CASE WHEN conv_id % 3 = 0 OR conv_id % 5 > 1 THEN 'r1-claude' END AS ledger
FROM sent""")
def resumed_manifest(spark, sf_dir):
    """A run whose delivery answers a third of the entries; its manifest is gone on with, but for files that are gone or
    modified by then."""
    listing, read, run = _chat_run(spark, sf_dir, "manifest")
    run_upload(listing, read, run, deliver=lambda entries: all_acked(entries.where(_conv() % 3 == 0)))
    hashes = durable(raw_hashes(listing.select("path"), listing)).where(_conv() % 5 != 0)
    now = hashes.withColumn("raw_hash", F.when(_conv() % 5 == 1, F.lit("modified")).otherwise(F.col("raw_hash")))
    resume_upload(listing, run, current=now)
    resume_upload(listing, run, current=now)  # nothing is open any more
    ledger = L.read_ledger(spark, run.ledger_path, run.endpoint, run.user_id).select("session_id", F.col("manifest_id").alias("ledger"))
    entries = spark.read.parquet(f"{run.folder}/entries").select("session_id", _conv().alias("conv_id"))
    states = saved_states(spark, run).select("session_id", "attempt", "status", "reason")
    return entries.join(states, "session_id").join(ledger, "session_id", "left").drop("session_id")


@query(_SENT + "SELECT conv_id, content_hash, 'st-0-claude' AS manifest_id FROM sent")
def ingested_runs(spark, sf_dir):
    """Listings as a stream: each micro-batch is a run of its own, and the ledger follows."""
    listing, read, run = _chat_run(spark, sf_dir, "ingest")
    listing.select("source_kind", "path", "size_bytes", "mtime_ms").write.parquet(f"{run.out}/listings")
    stream = ingest_listings(spark, f"{run.out}/listings", f"{run.out}/checkpoint", replace(run, run_id="st"), read)
    stream.awaitTermination()
    ledger = L.read_ledger(spark, run.ledger_path)
    return ledger.withColumn("path", F.col("source_file_path")).select(_conv().alias("conv_id"), "content_hash", "manifest_id")


@query(f"""
SELECT doc_id, @sha256(mails) AS mails, round(bits, 6) AS bits, {_UUID5} AS id, key
FROM (SELECT doc_id, {_interleave_sql("text", _MAIL, f"CASE WHEN lower(m) = '{OWNER}' THEN m ELSE " + _pseudonym_sql("user_", "third-party-email", "lower(m)") + " END")} AS mails,
  {_entropy_sql("text")} AS bits, {_pseudonym_sql("proj_", "project-name", "text")} AS key, {_HASHED.format("text")} FROM v_text)""")
def sql_functions(spark, sf_dir):
    """The registered SQL functions over whole texts."""
    register_sql_functions(spark, UPLOAD_ID, OWNER)
    view(spark, sf_dir, "v_text", heavy=True).createOrReplaceTempView("texts_to_redact")
    return spark.sql(
        "SELECT doc_id, sha2(redact_emails(text), 256) AS mails, round(shannon_entropy(text), 6) AS bits, "
        "session_uuid(text) AS id, pseudonym('project-name', text) AS key FROM texts_to_redact"
    )


def _in_turns(spark: SparkSession, rows: DataFrame, at: str, folder: str, gate, turns: int = 3) -> DataFrame:
    """The output of a gate that runs after each of some deliveries, dealt by the time of the rows."""
    low, high = rows.agg(F.min(at).cast("double"), F.max(at).cast("double")).first()
    place = F.least(F.floor((F.col(at).cast("double") - low) / ((high - low) or 1) * turns), F.lit(turns - 1))
    for k in range(turns):
        rows.where(place == k).write.mode("append").parquet(f"{folder}/in")
        gate(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), folder).awaitTermination()
    return output(spark, folder)


@query(_COOLDOWN + "SELECT endpoint, ts_ms FROM started")
def streamed_uploads_started(spark, sf_dir):
    """The cooldown gate over trigger files that come in three deliveries."""
    out = _in_turns(spark, view(spark, sf_dir, "v_triggers"), "ts_ms", _folder(spark, "triggers"), gate_triggers)
    return out.where("action = 'spawned'").select("endpoint", "ts_ms")


@query("""
WITH said AS (SELECT endpoint, ts_ms FROM v_triggers WHERE NOT logged_in)
SELECT trigger_id, CASE WHEN max(s.ts_ms) + 43200000 > t.ts_ms THEN 'blocked' ELSE 'open' END AS action, @big(max(s.ts_ms) + 43200000) AS blocked_until_ms
FROM v_triggers t LEFT JOIN said s ON s.endpoint = t.endpoint AND s.ts_ms <= t.ts_ms AND s.ts_ms + 43200000 > t.ts_ms
WHERE logged_in GROUP BY trigger_id, t.ts_ms""")
def streamed_block_verdicts(spark, sf_dir):
    """Responses that block an endpoint and triggers as one stream; a verdict lives for twelve hours."""
    t = view(spark, sf_dir, "v_triggers")
    events = t.select("endpoint", "ts_ms", (~F.col("logged_in")).alias("is_response"), (~F.col("logged_in")).alias("blocked"), "trigger_id")
    out = _in_turns(spark, events, "ts_ms", _folder(spark, "verdicts"), gate_blocked)
    return out.select("trigger_id", "action", F.when(F.col("action") == "blocked", F.col("blocked_until_ms")).alias("blocked_until_ms"))


@query(_EVENTS + """
SELECT manifest_id, @big(max(k) FILTER (WHERE event = 'upload-start')) AS total, @big(count(*) FILTER (WHERE event IN ('session-acked', 'session-failed', 'session-skipped'))) AS done,
  @big(count(*) FILTER (WHERE event = 'session-skipped')) AS skipped, @big(count(*) FILTER (WHERE event = 'session-failed')) AS failed
FROM ev GROUP BY manifest_id""")
def streamed_batch_states(spark, sf_dir):
    """Live batch counters from an event log that is delivered twice."""
    folder = _folder(spark, "progress")
    events = _progress(spark, sf_dir).select("manifest_id", "event", "expected_sessions", "session_id")
    for _ in range(2):
        events.write.mode("append").json(f"{folder}/in")
        gate_progress(spark.readStream.schema(events.schema).json(f"{folder}/in"), folder).awaitTermination()
    rows = output(spark, folder)
    latest = rows.groupBy("manifest_id").agg(F.max_by(F.struct("total", "done", "skipped", "failed"), "batch").alias("s"))
    return latest.select("manifest_id", "s.*")


@query("""
WITH sent AS (SELECT event_id, ts_ms, @sha256(@str(event_id)) AS content_hash FROM v_events WHERE event_id % 2 = 0),
acks AS (SELECT event_id, ts_ms + CASE WHEN event_id % 4 = 0 THEN 60000 ELSE 259200000 END AS ts_ms FROM sent WHERE event_id % 8 <> 6),
last AS (SELECT greatest((SELECT max(ts_ms) FROM sent), (SELECT max(ts_ms) FROM acks)) AS now),
told AS (
  SELECT event_id, content_hash, CASE WHEN event_id % 16 = 0 THEN 'failed' WHEN event_id % 8 <> 6 THEN 'acked' WHEN ts_ms + 3600000 <= now THEN 'unanswered' END AS status FROM sent, last)
SELECT 's' || @str(event_id) AS session_id, status, CASE WHEN status = 'acked' THEN content_hash END AS ledger_hash FROM told WHERE status IS NOT NULL""")
def streamed_acks(spark, sf_dir):
    """Sent entries and their acks in three deliveries: some answers come days later, some never."""
    folder = _folder(spark, "acks")
    key = F.col("event_id")
    text = lambda c: F.lit(None).cast("string") if c is None else c
    sent = view(spark, sf_dir, "v_events").where(key % 2 == 0).select(
        F.lit("m").alias("manifest_id"), F.concat(F.lit("s"), key.cast("string")).alias("session_id"), "event_id", "ts_ms"
    )
    entries = sent.select(
        "manifest_id", "session_id", "ts_ms", F.lit(False).alias("is_ack"), F.sha2(key.cast("string"), 256).alias("content_hash"),
        F.col("session_id").alias("path"), text(None).alias("status"), text(None).alias("reason"),
    )
    acks = sent.where(key % 8 != 6).select(
        "manifest_id", "session_id", (F.col("ts_ms") + F.when(key % 4 == 0, 60_000).otherwise(259_200_000)).alias("ts_ms"), F.lit(True).alias("is_ack"),
        text(None).alias("content_hash"), text(None).alias("path"), F.when(key % 16 == 0, "failed").otherwise("acked").alias("status"), text(None).alias("reason"),
    )
    ledger = f"{folder}/ledger"
    out = _in_turns(spark, entries.unionByName(acks), "ts_ms", folder, lambda events, f: settle_entries(events, f, ledger, "acks"))
    last = out.groupBy("session_id").agg(F.max_by("status", "batch").alias("status"))
    moved = L.read_ledger(spark, ledger).select("session_id", F.col("content_hash").alias("ledger_hash"))
    return last.join(moved, "session_id", "left")


@query(_EVENTS + "SELECT manifest_id, event, @big(row_number() OVER (PARTITION BY manifest_id ORDER BY event_id) - 1) AS seq FROM ev")
def event_log(spark, sf_dir):
    """Numbered events written as an NDJSON log and read back."""
    folder = _folder(spark, "events")
    write_events(R.with_sequence(_progress(spark, sf_dir), ["event_id"]), folder)
    return spark.read.json(folder).select("manifest_id", "event", "seq")


@query("""
WITH s AS (SELECT user_id, event_type AS kind, 'p' || @str(user_id % 3) AS project, ts, @sha256('{"v":' || @str(@big(floor(value / 40))) || '}') AS h FROM events),
p AS (SELECT *, lag(h) OVER (PARTITION BY user_id, kind, project ORDER BY ts, h) AS before FROM s)
SELECT @str(user_id) AS user_id, kind, project, h AS content_hash, @big(count(*)) AS n FROM p WHERE before IS NULL OR before <> h GROUP BY ALL""")
def streamed_changed_snapshots(spark, sf_dir):
    """The snapshot gate over snapshots that come in three deliveries; how often each hash passes."""
    snaps = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("user_id"), F.col("event_type").alias("kind"),
        F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("project"),
        F.col("ts").cast("timestamp").alias("captured_at"), F.floor(F.col("value") / 40).alias("v"),
    )
    keyed = snaps.withColumn("content_hash", snapshot_key(["v"])).drop("v")
    out = _in_turns(spark, keyed, "captured_at", _folder(spark, "snapshots"), gate_snapshots)
    return out.groupBy("user_id", "kind", "project", "content_hash").agg(F.count("*").alias("n"))


@query("""
SELECT git_dir || array_to_string(list_transform(parts[1:i], lambda x: '/' || x), '') AS git_dir, array_to_string(parts[i + 1:], '/') AS rel_path, @sha256(content) AS h
FROM (SELECT git_dir, content, parts, unnest(range(0, len(parts))) AS i FROM (
  SELECT git_dir, content, string_split(rel_path, '/') AS parts FROM v_git_files WHERE git_dir LIKE '%/.git'))""")
def collected_git_tables(spark, sf_dir):
    """Git tables out of files as a collector takes them: each belongs to every directory above it, down from .git."""
    v = view(spark, sf_dir, "v_git_files").where("git_dir LIKE '%/.git'")
    files = v.select(F.concat("git_dir", F.lit("/"), "rel_path").alias("path"), "content")
    return git_dir_files(files).select("git_dir", "rel_path", F.sha2("content", 256).alias("h"))
