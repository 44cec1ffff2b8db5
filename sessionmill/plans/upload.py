"""One upload run over a fleet's session files: what is new goes out redacted, the ledger follows.

The run's folder holds what goes out: redacted payload, manifest, entry states, events, redaction
totals, summary. Stages
that are read more than once are cut by checkpoints, and the text of sessions is not among them: it
is read again for the sessions that are sent.

The ledger's commit names the run, and it is the last thing written. A run that dies before it can be
started again under the same id and writes over its own folder. After it the same call changes
nothing and returns the summary it left. The ledger takes up acknowledged sessions only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionmill.functions.hashing import POLICY_VERSION
from sessionmill.functions.pricing import MIN_FULL_UPLOAD_USD
from sessionmill.operators import classify as C
from sessionmill.operators import manifest as M
from sessionmill.operators import redact as R
from sessionmill.operators import reports as O
from sessionmill.operators import selection as S
from sessionmill.operators import usage as U
from sessionmill.operators.ordering import durable
from sessionmill.operators.identity import resolve_identity, session_facts
from sessionmill.operators.projects import with_project
from sessionmill.sources import ledger as L
from sessionmill.sources import sinks
from sessionmill.sources.blocks import reading_tasks, whole_files
from sessionmill.sources.files import existing, kept_listing, raw_hashes
from sessionmill.sources.gemini import registry, resolve_cwds
from sessionmill.sources.providers import by_source_kind
from sessionmill.sources.records import (
    RECORD_ROWS,
    WHOLE_FILE_LIMIT,
    content_hash,
    file_hashes,
    open_ndjson,
    read_ndjson,
    typed_records,
    whole_records,
)

SESSION = ["source_kind", "path"]
#: Names by which a scan knows compressed files and unpacks them.
COMPRESSED = r"(?i)\.(gz|bz2|deflate|lz4|lzo|snappy|zst|zstd|xz|br)$"
#: Tasks that read files get this much at most.
TASK_BYTES = 64 * 1024 * 1024


@dataclass(frozen=True)
class UploadRun:
    run_id: str
    out: str
    ledger_path: str
    redaction: R.RedactionContext
    uploaded_at: str
    min_usd: float = MIN_FULL_UPLOAD_USD
    limit: int | None = None
    endpoint: str = ""
    user_id: str = ""

    @property
    def folder(self) -> str:
        return f"{self.out}/run={self.run_id}"


def _saved(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


class ListedFiles:
    """Reads listed files (source_kind, path, mtime_ms) of one glob per provider.

    Each glob is listed once, however often files are read, or not at all if its listing is at hand (`found`, as
    `kept_listing` gives it). The listing, from the oldest wanted file on, is joined with the wanted paths before
    anything is opened; both may have any length. Small plain files on a file system of the machines are read
    one after another in a few tasks. Only if a wanted file is larger than `whole_limit`, compressed or in
    another store, the glob is opened as a scan.
    """

    def __init__(self, globs: dict[str, str], whole_limit: int = WHOLE_FILE_LIMIT, found: dict[str, DataFrame] | None = None):
        self.globs, self.whole_limit = globs, whole_limit
        self._found = dict(found or {})
        self._opened: dict[str, DataFrame | None] = {}

    def __call__(self, wanted: DataFrame) -> DataFrame:
        spark = wanted.sparkSession
        out = spark.createDataFrame([], RECORD_ROWS)
        stated = wanted.where(F.col("source_kind").isin(*self.globs)).groupBy("source_kind")
        for kind, ms in stated.agg(F.min("mtime_ms")).collect():  # one per provider
            if kind not in self._found:
                self._found[kind] = kept_listing(spark, self.globs[kind], kind)
            of_kind = wanted.where(F.col("source_kind") == kind).select("path")
            found = self._found[kind] if ms is None else self._found[kind].where(F.col("mtime_ms") >= int(ms))
            chosen = found.select("path", "size_bytes").join(of_kind, "path", "left_semi")
            plain = F.startswith("path", F.lit("/")) & (F.col("size_bytes") <= self.whole_limit) & ~F.col("path").rlike(COMPRESSED)
            size, others = chosen.agg(F.sum(F.when(plain, F.col("size_bytes"))), F.count_if(~plain)).first()
            if size is not None:
                texts = whole_files(chosen.where(plain), max(reading_tasks(spark), size // TASK_BYTES))
                out = out.unionByName(
                    whole_records(texts.select(F.lit(kind).alias("source_kind"), "path", F.col("content").cast("string").alias("value")))
                )
            if others:
                if self._opened.get(kind) is None:
                    self._opened[kind] = open_ndjson(spark, self.globs[kind])
                if self._opened[kind] is not None:
                    scanned = chosen.where(~plain).select("path")
                    out = out.unionByName(
                        read_ndjson(spark, self.globs[kind], kind, self.whole_limit, scanned, ms, found=self._opened[kind])
                    )
        return out


def read_listed(wanted: DataFrame, globs: dict[str, str], whole_limit: int = WHOLE_FILE_LIMIT) -> DataFrame:
    """Records of the listed files, read once; see `ListedFiles`."""
    return ListedFiles(globs, whole_limit)(wanted)


def all_acked(entries: DataFrame) -> DataFrame:
    """Acks of a run whose payload table is the destination: writing it is the delivery."""
    return entries.select("session_id", F.lit("acked").alias("status"), F.lit(None).cast("string").alias("reason"))


def run_upload(
    listing: DataFrame, read_records: Callable[[DataFrame], DataFrame], run: UploadRun,
    sidecars: DataFrame | None = None, deliver: Callable[[DataFrame], DataFrame] = all_acked,
    registries: DataFrame | None = None, git_contexts: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Classify, price, redact and write one batch; returns the summary row.

    `listing` has source_kind, path, size_bytes, mtime_ms; `read_records` turns the rows that must
    be read into records (see `ListedFiles`). `deliver` gets the entries and answers with
    (session_id, status, reason), status being acked, failed or skipped; entries it does not
    answer stay pending and are sent again by a later run. `registries` (root, content) are the Gemini
    registries that name the directories of its sessions; `git_contexts` turns sessions (path,
    session_cwd, recorded_branch) into their git coordinates, which the entries then carry.
    """
    spark = listing.sparkSession
    if L.is_committed(spark, run.ledger_path, run.run_id, run.endpoint, run.user_id):
        return spark.read.parquet(f"{run.folder}/summary")
    rules = run.redaction.rules()
    own = L.read_ledger(spark, run.ledger_path, run.endpoint, run.user_id)
    checked = durable(C.stat_check(listing, own))

    texts = read_records(checked.where("NOT stat_hit"))
    records = durable(typed_records(texts).drop("raw"))
    hashes = durable(file_hashes(records, sidecars, texts, checked))
    seen = session_facts(records)
    if registries is not None:
        gemini = seen.where("source_kind = 'gemini'").select("path", "project_hash")
        cwds = resolve_cwds(gemini, registry(registries)).groupBy("path").agg(F.min("cwd").alias("registry_cwd"))
        seen = seen.join(cwds, "path", "left")
    sessions = resolve_identity(seen).join(hashes, SESSION)
    metrics = U.session_metrics(records)
    classified = C.classify(checked, sessions, own)
    facts = classified.join(metrics, SESSION, "left").join(
        sessions.select(*SESSION, "session_cwd", "recorded_branch"), SESSION, "left"
    )
    facts = durable(with_project(facts))

    will = C.newest_first(S.eligible(facts), run.limit) if run.limit else S.eligible(facts)
    will = durable(will)

    # Only new and updated full-tier sessions are read again and pay for redaction.
    full = U.with_tier(will, run.min_usd).where("tier = 'full'").select(*SESSION, "session_id", "mtime_ms", "size_bytes")
    raw = read_records(full.drop("session_id")).select(*SESSION, "line_no", "raw")
    if sidecars is not None:
        raw = raw.unionByName(sidecars.select(*SESSION, "line_no", "raw"))
    redacted = durable(R.redact_json(raw.join(full.drop("mtime_ms", "size_bytes"), SESSION), "raw", rules))
    # The audit runs before anything leaves.
    R.assert_no_leak_json(redacted, "raw", rules)

    manifest_id = F.concat(F.lit(f"{run.run_id}-"), by_source_kind(lambda s: F.lit(s.provider_id)))
    raw_hashes = hashes.select("path", "raw_hash")
    contexts = None if git_contexts is None else git_contexts(will.select("path", "session_cwd", "recorded_branch"))
    jobs = M.upload_jobs(will.drop(*U.METRICS), metrics, raw_hashes, contexts, min_usd=run.min_usd)
    entries = M.manifest_entries(jobs, M.body_bytes(redacted, SESSION), manifest_id)
    digests = content_hash(redacted, ["path"]).select("path", F.col("content_hash").alias("redacted_hash"))
    entries = _saved(entries.join(digests, "path", "left"), f"{run.folder}/entries")
    sinks.write_payloads(redacted.withColumn("manifest_id", manifest_id), f"{run.folder}/payload")
    sinks.write_manifests(
        M.manifest_headers(entries).withColumns({"endpoint": F.lit(run.endpoint), "user_id": F.lit(run.user_id)}),
        entries, f"{run.folder}/manifest",
    )

    _saved(R.batch_totals(redacted), f"{run.folder}/redactions")

    states = _saved(M.entry_states(entries, deliver(entries)), f"{run.folder}/states")
    sinks.write_events(M.batch_events(states, run.uploaded_at), f"{run.folder}/events")
    sized = will.join(entries.select("path", F.col("expected_bytes").alias("byte_size")), "path", "left")
    summary = O.upload_summary(facts, sized, run.limit)
    vanished = checked.where("NOT stat_hit").join(records.select(*SESSION).distinct(), SESSION, "left_anti")
    done = _saved(summary.withColumn("without_records", F.lit(vanished.count())), f"{run.folder}/summary")

    L.write_ledger(_moved(entries, states, run.uploaded_at), run.ledger_path, run.run_id, run.endpoint, run.user_id)
    return done


def _moved(entries: DataFrame, states: DataFrame, uploaded_at: str) -> DataFrame:
    """Ledger rows of the entries that were acknowledged."""
    acked = entries.join(states.where("status = 'acked'").select("session_id", "manifest_id"), ["session_id", "manifest_id"])
    return acked.select(
        "session_id", "content_hash", F.lit(uploaded_at).alias("last_uploaded_at"), "manifest_id",
        F.col("path").alias("source_file_path"), "mtime_ms",
        F.col("size_bytes").alias("byte_size_on_disk"), "derivation",
        F.lit(POLICY_VERSION).alias("policy_version"),
    )


def saved_states(spark: SparkSession, run: UploadRun) -> DataFrame:
    """The state of every entry of a run after all its attempts; `attempt` is the one that settled it, 0 the run."""
    states = spark.read.parquet(f"{run.folder}/states").withColumn("attempt", F.lit(0))
    resumed = existing(lambda: spark.read.parquet(f"{run.folder}/resumed"))
    if resumed is not None:
        states = states.unionByName(resumed)
    return M.latest_entries(states.withColumn("seq", F.col("attempt"))).drop("seq")


def resume_upload(
    listing: DataFrame, run: UploadRun, deliver: Callable[[DataFrame], DataFrame] = all_acked, current: DataFrame | None = None
) -> DataFrame:
    """Go on with the manifests that a run has left open; returns the states of this attempt.

    The payload lies redacted in the run's folder, so nothing is parsed again. A manifest is taken up if it is of
    this run's endpoint and user and knows all of its sessions. Files are checked by their raw hash first (read
    from `listing`, or given as `current`: path, raw_hash): entries whose file is missing or modified are
    skipped, as a later run sends what is there now. Each attempt is committed like a run, and one that died
    is made again under its number.
    """
    spark = listing.sparkSession
    entries = spark.read.parquet(f"{run.folder}/entries")
    attempt = 1
    while L.is_committed(spark, run.ledger_path, f"{run.run_id}/{attempt}", run.endpoint, run.user_id):
        attempt += 1
    before = saved_states(spark, run).where(F.col("attempt") < attempt)
    open_ = entries.drop("status").join(
        before.where(F.col("status").isin(M.UNFINISHED)).select("manifest_id", "session_id"), ["manifest_id", "session_id"]
    )
    headers = spark.read.json(f"{run.folder}/manifest/headers")
    owned = entries.select("manifest_id", "session_id").join(
        before.select("manifest_id", "session_id", "status"), ["manifest_id", "session_id"]
    ).join(headers.select("manifest_id", "source_kind", "endpoint", "user_id"), "manifest_id")
    batch = headers.select(
        "manifest_id", F.col("source_kind").alias("run_source_kind"), F.lit(run.endpoint).alias("run_endpoint"), F.lit(run.user_id).alias("run_user_id")
    )
    ready = M.resumable(owned, open_.select("manifest_id", "session_id"), batch).where("resume").select("manifest_id")
    open_ = durable(open_.join(ready, "manifest_id"))
    if current is None:
        current = raw_hashes(open_.select("path"), listing.select("path", "size_bytes"))
    checked = durable(M.recheck_entries(open_, current))
    skipped = checked.where("skip_reason IS NOT NULL").select("session_id", F.lit("skipped").alias("status"), F.col("skip_reason").alias("reason"))
    sent = checked.where("skip_reason IS NULL").drop("skip_reason")
    states = M.entry_states(open_, deliver(sent).select("session_id", "status", "reason").unionByName(skipped))
    done = _saved(states, f"{run.folder}/resumed/attempt={attempt}")
    L.write_ledger(_moved(entries, done, run.uploaded_at), run.ledger_path, f"{run.run_id}/{attempt}", run.endpoint, run.user_id)
    return done
