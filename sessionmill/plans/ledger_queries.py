"""Queries that compare sessions with the ledger, and pick what a run uploads."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionmill.operators import classify as C
from sessionmill.operators import manifest as M
from sessionmill.operators import projects as G
from sessionmill.operators import reports as R
from sessionmill.operators import selection as S
from sessionmill.operators.ordering import durable
from sessionmill.plans.registry import query
from sessionmill.plans.views import table, view
from sessionmill.sources import ledger as L
from sessionmill.sources.configs import nearest_configs, project_configs, upload_configs
from sessionmill.sources.files import raw_hashes
from sessionmill.sources.providers import by_source_kind, detect_providers, provider_table

# A row per session after both checks, as SQL.
_CLASSIFIED = """
WITH by_path AS (
  SELECT source_file_path AS path, max_by(struct_pack(m := mtime_ms, s := byte_size_on_disk, d := derivation, p := policy_version, id := session_id),
    (last_uploaded_at, session_id)) AS l
  FROM v_ledger WHERE source_file_path IS NOT NULL GROUP BY source_file_path),
stat AS (
  SELECT s.*, coalesce(l.d IS NOT NULL AND l.m = s.mtime_ms AND l.s = s.size_bytes AND l.p = 'v0.2', false) AS stat_hit,
    l.id AS l_id, l.d AS l_d
  FROM v_sessions s LEFT JOIN by_path USING (path)),
kinds AS (
  SELECT stat.path, stat.doc_id, stat.source_kind, stat.size_bytes, stat.mtime_ms, stat.total_cost_usd, stat.has_answer, stat.source, stat_hit,
    CASE WHEN stat_hit THEN l_id ELSE stat.session_id END AS session_id,
    CASE WHEN stat_hit THEN l_d ELSE stat.derivation END AS derivation,
    CASE WHEN stat_hit THEN NULL ELSE stat.content_hash END AS content_hash,
    CASE WHEN stat_hit THEN 'unchanged' WHEN g.session_id IS NULL THEN 'new'
         WHEN g.content_hash = stat.content_hash THEN 'unchanged' ELSE 'updated' END AS kind
  FROM stat LEFT JOIN v_ledger g ON g.session_id = stat.session_id),
classified AS (
  SELECT * FROM kinds QUALIFY row_number() OVER (PARTITION BY source_kind, session_id ORDER BY mtime_ms DESC, path) = 1),
candidates AS (
  SELECT * FROM classified WHERE kind <> 'unchanged' AND has_answer AND total_cost_usd >= 0.01)
"""


def _files(spark, sf_dir):
    return view(spark, sf_dir, "v_sessions").select("source_kind", "path", "size_bytes", "mtime_ms")


def _ledger(spark, sf_dir):
    return view(spark, sf_dir, "v_ledger")


def _classified(spark, sf_dir):
    sessions = view(spark, sf_dir, "v_sessions")
    checked = C.stat_check(_files(spark, sf_dir), _ledger(spark, sf_dir))
    return C.classify(checked, sessions, _ledger(spark, sf_dir))


def _candidates(spark, sf_dir):
    """Classified sessions with the facts the selection needs."""
    facts = view(spark, sf_dir, "v_sessions").select(
        "path", "total_cost_usd", "has_answer", F.col("size_bytes").alias("byte_size")
    )
    return G.with_project(_classified(spark, sf_dir).join(facts, "path"))


@query(_CLASSIFIED + "SELECT path, stat_hit, CASE WHEN stat_hit THEN l_id END AS ledger_session_id FROM stat")
def stat_check(spark, sf_dir):
    """Files the ledger vouches for by path, size, time and policy; the rest must be read."""
    return C.stat_check(_files(spark, sf_dir), _ledger(spark, sf_dir)).select(
        "path", "stat_hit", "ledger_session_id"
    )


@query("""
SELECT s.path, s.session_id, CASE WHEN g.session_id IS NULL THEN 'new'
  WHEN g.content_hash = s.content_hash THEN 'unchanged' ELSE 'updated' END AS kind
FROM v_sessions s LEFT JOIN v_ledger g USING (session_id)
""")
def content_check(spark, sf_dir):
    s = view(spark, sf_dir, "v_sessions").select("path", "session_id", "content_hash")
    return C.content_check(s, _ledger(spark, sf_dir)).select("path", "session_id", "kind")


@query(_CLASSIFIED + "SELECT source_kind, path, session_id, derivation, content_hash, kind FROM classified")
def classified_sessions(spark, sf_dir):
    return _classified(spark, sf_dir).select(
        "source_kind", "path", "session_id", "derivation", "content_hash", "kind"
    )


@query(_CLASSIFIED + """
SELECT @big(count(*)) AS discovered, @big(count(*) FILTER (WHERE kind = 'unchanged')) AS unchanged,
  @big(count(*) FILTER (WHERE kind = 'new')) AS new, @big(count(*) FILTER (WHERE kind = 'updated')) AS updated
FROM classified""")
def classification_counts(spark, sf_dir):
    return C.bucket_counts(_classified(spark, sf_dir))


@query(_CLASSIFIED + "SELECT path, kind FROM candidates ORDER BY mtime_ms DESC, path LIMIT 25")
def newest_candidates(spark, sf_dir):
    """The 25 newest sessions left to upload: the limit is the feature."""
    rows = S.eligible(_candidates(spark, sf_dir))
    return C.newest_first(rows, 25).select("path", "kind")


@query(_CLASSIFIED + """,
sent AS (SELECT * FROM candidates ORDER BY mtime_ms DESC, path LIMIT 40),
n AS (SELECT count(*) AS discovered, count(*) FILTER (WHERE kind = 'unchanged') AS unchanged,
  count(*) FILTER (WHERE kind = 'new') AS new, count(*) FILTER (WHERE kind = 'updated') AS updated FROM classified)
SELECT @big(discovered) AS discovered, @big(unchanged) AS unchanged, @big(new) AS new, @big(updated) AS updated,
  @big((SELECT count(*) FROM sent)) AS will_upload, @big((SELECT sum(size_bytes) FROM sent)) AS estimated_bytes, 'v0.2' AS policy_version,
  (SELECT strftime(make_timestamp(CAST(trunc(min(mtime_ms)) AS BIGINT) * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') FROM sent) AS date_from,
  (SELECT strftime(make_timestamp(CAST(trunc(max(mtime_ms)) AS BIGINT) * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') FROM sent) AS date_to,
  true AS limited, @big(40) AS limit_rows, @big(new + updated) AS candidates
FROM n""")
def upload_summary(spark, sf_dir):
    rows = durable(_candidates(spark, sf_dir))
    return R.upload_summary(rows, C.newest_first(S.eligible(rows), 40), limit=40)


@query(_CLASSIFIED + """
SELECT CASE WHEN total_cost_usd < 0.01 THEN 'excluded' WHEN total_cost_usd < 10 THEN 'metadata' ELSE 'full' END AS tier, @big(count(*)) AS sessions
FROM classified WHERE kind <> 'unchanged' AND has_answer GROUP BY 1""")
def tier_split(spark, sf_dir):
    return S.tier_split(_candidates(spark, sf_dir).where("has_answer"))


@query(_CLASSIFIED + """
SELECT 'nothing_left_after_filters' AS reason, @big(count(*)) AS sessions_discovered, @big(count(DISTINCT source)) AS projects_discovered,
  @big(count(*) FILTER (WHERE kind = 'unchanged')) AS already_uploaded,
  @big(count(*) FILTER (WHERE kind <> 'unchanged' AND NOT (has_answer AND total_cost_usd >= 0.01))) AS trivial_or_empty,
  @big(count(*) FILTER (WHERE kind <> 'unchanged' AND has_answer AND total_cost_usd >= 0.01)) AS unselected
FROM classified""")
def empty_selection_reason(spark, sf_dir):
    return S.explain_empty(_candidates(spark, sf_dir))


@query(_CLASSIFIED + """
SELECT 'claude' AS provider_id, '-Users-dev-' || s.source AS project_id, @big(count(*)) AS session_count,
  @big(count(c.path)) AS eligible
FROM v_sessions s LEFT JOIN candidates c ON c.path = s.path GROUP BY s.source""")
def eligible_per_project(spark, sf_dir):
    sessions = G.with_project(_files(spark, sf_dir))
    left = S.eligible(_candidates(spark, sf_dir))
    return G.eligible_counts(G.project_groups(sessions), sessions, left).select(
        "provider_id", "project_id", "session_count", "eligible"
    )


@query(_CLASSIFIED + """,
n AS (SELECT source, count(*) AS n FROM candidates GROUP BY source)
SELECT 'claude' AS provider_id, '/Users/dev/' || source AS display_name, @big(n) AS will_upload,
  @big(round(n / (SELECT max(n) FROM n) * 20)) AS bar FROM n""")
def upload_rows_per_project(spark, sf_dir):
    left = S.eligible(_candidates(spark, sf_dir)).withColumn("session_cwd", F.lit(None).cast("string"))
    rows = durable(G.project_rows(left).select("provider_id", "display_name", "will_upload"))
    return G.biggest_first(G.share_of_max(rows, "will_upload"), "will_upload", "display_name")


@query("""
WITH changed AS (SELECT * FROM v_sessions WHERE doc_id % 6 < 3 QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY doc_id DESC) = 1),
new AS (SELECT session_id, content_hash, 'run-' || lpad(@str(doc_id), 9, '0') AS last_uploaded_at, 'm9' AS manifest_id FROM changed)
SELECT session_id, content_hash, last_uploaded_at, manifest_id FROM v_ledger WHERE session_id NOT IN (SELECT session_id FROM new)
UNION ALL SELECT * FROM new
""")
def ledger_upsert(spark, sf_dir):
    s = view(spark, sf_dir, "v_sessions").where("doc_id % 6 < 3")
    old = _ledger(spark, sf_dir).select("session_id", "content_hash", "last_uploaded_at", "manifest_id")
    new = s.select(
        "session_id", "content_hash",
        F.concat(F.lit("run-"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("last_uploaded_at"),
        F.lit("m9").alias("manifest_id"),
    )
    return L.upsert(old, new)


@query("""
SELECT session_id, content_hash, manifest_id, CAST(NULL AS STRING) AS derivation
FROM v_ledger WHERE manifest_id <> 'm3' AND manifest_id <> 'm2'
""")
def ledger_migration(spark, sf_dir):
    """Entries without the optional columns: old versions stay, a newer version or a hash that is
    none drops out."""
    old = _ledger(spark, sf_dir).select(
        "session_id",
        F.when(F.col("manifest_id") == "m2", "nohash").otherwise(F.col("content_hash")).alias("content_hash"),
        "last_uploaded_at", "manifest_id",
        F.when(F.col("manifest_id") == "m3", 3).otherwise(1).alias("schema_version"),
    )
    return L.migrate(old).select("session_id", "content_hash", "manifest_id", "derivation")


@query("""
WITH f AS (SELECT user_id % 12 AS machine, CASE event_type WHEN 'click' THEN 'claude-code' WHEN 'view' THEN 'codex' WHEN 'error' THEN 'cursor'
  WHEN 'signup' THEN 'gemini' ELSE 'other' END AS source_kind FROM events)
SELECT 'h' || @str(machine) AS machine_id, source_kind, @big(count(*)) AS n_files,
  CASE source_kind WHEN 'claude-code' THEN 'claude' ELSE source_kind END AS provider_id,
  CASE source_kind WHEN 'claude-code' THEN 'claude-jsonl-2026-04' WHEN 'codex' THEN 'codex-jsonl-2026-05' WHEN 'cursor' THEN 'cursor-jsonl-2026-05'
    ELSE 'gemini-jsonl-2026-06' END AS format_version
FROM f WHERE source_kind <> 'other' GROUP BY machine, source_kind""")
def detected_providers(spark, sf_dir):
    kind = F.col("event_type")
    source = (
        F.when(kind == "click", "claude-code").when(kind == "view", "codex").when(kind == "error", "cursor")
        .when(kind == "signup", "gemini").otherwise("other")
    )
    files = table(spark, sf_dir, "events").select(
        F.concat(F.lit("h"), (F.col("user_id") % 12).cast("string")).alias("machine_id"), source.alias("source_kind")
    )
    return detect_providers(files).select("machine_id", "source_kind", "n_files", "provider_id", "format_version")


def _groups(spark, sf_dir):
    return G.project_groups(G.with_project(_files(spark, sf_dir)))


def _chosen(spark, sf_dir):
    """Providers and projects a run chose."""
    providers = ["claude", "codex"]
    projects = _groups(spark, sf_dir).where(F.col("project_id").rlike("src1[0-9]?$"))
    return providers, projects


@query("""
SELECT path FROM v_sessions WHERE regexp_matches(source, '^src1[0-9]?$')
""")
def selected_sessions(spark, sf_dir):
    providers, projects = _chosen(spark, sf_dir)
    return S.select_sessions(G.with_project(_files(spark, sf_dir)), providers, projects).select("path")


@query(_CLASSIFIED + "SELECT path, kind FROM classified WHERE regexp_matches(source, '^src1[0-9]?$')")
def selected_classifications(spark, sf_dir):
    providers, projects = _chosen(spark, sf_dir)
    chosen = S.select_sessions(G.with_project(_files(spark, sf_dir)), providers, projects)
    return C.only_selected(_classified(spark, sf_dir), chosen).select("path", "kind")


@query("""
SELECT 'claude' AS provider_id, '-Users-dev-' || source AS project_id, @big(count(*)) AS session_count,
  true AS provider_selected, regexp_matches(source, '^src1[0-9]?$') AS project_selected
FROM v_sessions GROUP BY source""")
def selection_report(spark, sf_dir):
    providers, projects = _chosen(spark, sf_dir)
    return S.selection_report(_groups(spark, sf_dir), providers, projects).select(
        "provider_id", "project_id", "session_count", "provider_selected", "project_selected"
    )


@query("""
SELECT DISTINCT '-Users-dev-' || source AS project_id FROM v_sessions
WHERE regexp_matches(source, '^src[0-9]*$') AND NOT regexp_matches(source, '^src1[0-9]$')
""")
def config_selection(spark, sf_dir):
    """Projects by include and exclude globs; exclude wins."""
    seen = detect_providers(_files(spark, sf_dir).withColumn("machine_id", F.lit("h")))
    ids = S.supported_providers(seen, provider_table(spark).where("provider_id <> 'gemini'"))
    picked = S.config_selection(
        _groups(spark, sf_dir), ids, "/Users/dev", include=["~/src*", "/opt/**"], exclude=["/Users/*/src1?"]
    )
    return picked.select("project_id")


@query("SELECT 'claude' AS provider_id, '-Users-dev-' || source AS project_id, @big(count(*)) AS session_count FROM v_sessions WHERE source = 'src1' GROUP BY source")
def scoped_projects(spark, sf_dir):
    return (
        _groups(spark, sf_dir).where(S.in_scope(F.lit("/Users/dev/src1")))
        .select("provider_id", "project_id", "session_count")
    )


# Config texts by customer, and the reason why each is refused (empty: it is good).
_CONFIG_FORMS = [
    ('{"version":1}', ""),
    ('{"version":1,"upload":{"enabled":false,"linkPrs":true}}', ""),
    ('{"version":1,"upload":{"minCost":@n.5}}', ""),
    ('{"$schema":"x","version":1,"org":"org@n","upload":{"concurrency":1@n}}', ""),
    ('{"version":1,"uplaod":{}}', "unknown key .uplaod"),
    ('{"version":1,', "no JSON"),
    ('{"version":1,"upload":{"concurrency":"4"}}', "$.upload.concurrency"),
    ('{"upload":{"auto":true}}', "version"),
    ('{"version":1,"upload":@n}', "$.upload"),
    ('{"version":1,"upload":null}', "$.upload"),
    ('{"version":1,"snapshot":[]}', "$.snapshot"),
    ('{"version":1,"org":""}', "$.org"),
    ('{"version":1,"endpoint":"nope@n"}', "$.endpoint"),
    ('{"version":1,"upload":{"providers":"claude"}}', "$.upload.providers"),
    ('{"version":1,"upload":{"providers":[""]}}', "$.upload.providers"),
    ('{"version":1,"upload":{"providers":["a",@n]}}', "$.upload.providers"),
    ('{"version":1,"$schema":@n}', "$.$schema"),
    ('{"version":"1"}', "version"),
    ("[@n]", "no object"),
    ('{"version":1,"upload":{"minCost":0}}', "$.upload.minCost"),
]
_UPLOAD_FORMS = [
    ('{"schemaVersion":1}', ""),
    ('{"schemaVersion":1,"providers":["claude"],"projects":{"include":["~/p@n*"],"exclude":["~/p@n/x"]}}', ""),
    ('{"schemaVersion":1,"upload":{"org":"org@n","concurrency":2@n,"enabled":false}}', ""),
    ('{"schemaVersion":2}', "schemaVersion"),
    ('{"schemaVersion":1,"projects":[]}', "$.projects"),
    ('{"schemaVersion":1,"projects":{"include":[@n]}}', "$.projects.include"),
    ('{"schemaVersion":1,"projects":{"only":[]}}', "unknown key projects.only"),
    ('{"schemaVersion":1,"upload":{"org":""}}', "$.upload.org"),
]


def _config_files(spark, sf_dir, forms):
    c = table(spark, sf_dir, "customer")
    form = F.get(F.array(*[F.lit(text) for text, _ in forms]), (F.col("c_custkey") % len(forms)).cast("int"))
    text = F.replace(form, F.lit("@n"), F.col("c_nationkey").cast("string"))
    return c.select(F.concat(F.lit("/w/"), F.col("c_custkey").cast("string")).alias("dir"), text.alias("content"))


def _forms_sql(forms):
    cases = " ".join(f"WHEN {k} THEN '{error}'" for k, (_, error) in enumerate(forms) if error)
    return f"WITH c AS (SELECT c_custkey, c_nationkey, c_custkey % {len(forms)} AS form, CASE c_custkey % {len(forms)} {cases} END AS error FROM customer)"


@query(_forms_sql(_CONFIG_FORMS) + """
SELECT '/w/' || @str(c_custkey) AS dir, error, CASE WHEN error IS NULL THEN form <> 1 END AS enabled,
  CASE WHEN error IS NULL THEN CASE WHEN form = 2 THEN c_nationkey + 0.5 ELSE 10.0 END END::DOUBLE AS min_cost,
  CASE WHEN error IS NULL THEN @big(CASE WHEN form = 3 THEN ('1' || @str(c_nationkey))::BIGINT ELSE 4 END) END AS concurrency,
  CASE WHEN error IS NULL THEN form = 1 END AS link_prs, CASE WHEN form = 3 THEN 'org' || @str(c_nationkey) END AS org
FROM c""")
def project_config_settings(spark, sf_dir):
    configs = project_configs(_config_files(spark, sf_dir, _CONFIG_FORMS))
    return configs.select("dir", "error", "enabled", "min_cost", "concurrency", "link_prs", "org")


@query(_forms_sql(_UPLOAD_FORMS) + """
SELECT '/w/' || @str(c_custkey) AS dir, error, CASE WHEN form = 1 THEN 'claude' END AS providers, CASE WHEN form = 1 THEN '~/p' || @str(c_nationkey) || '*' END AS include,
  CASE WHEN form = 1 THEN '~/p' || @str(c_nationkey) || '/x' END AS exclude, CASE WHEN form = 2 THEN false END AS enabled,
  CASE WHEN form = 2 THEN ('2' || @str(c_nationkey))::BIGINT END AS concurrency, CASE WHEN form = 2 THEN 'org' || @str(c_nationkey) END AS org
FROM c""")
def upload_config_settings(spark, sf_dir):
    """The older config form, with include and exclude globs."""
    configs = upload_configs(_config_files(spark, sf_dir, _UPLOAD_FORMS))
    lists = [F.array_join(c, ",").alias(c) for c in ("providers", "include", "exclude")]
    return configs.select("dir", "error", *lists, "enabled", "concurrency", "org")


@query("""
WITH p AS (
  SELECT c_custkey, c_nationkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'codex' ELSE 'claude' END AS provider_id,
    '/Users/dev' || @str(c_nationkey) || '/team' || @str(c_custkey % 13) || '/proj' || @str(c_custkey) AS path FROM customer),
t AS (
  SELECT *, CASE k % 4 WHEN 1 THEN regexp_matches(path, '^/Users/dev[0-9]+/team1[^/]*/.*$') WHEN 2 THEN regexp_matches(path, '^/Users/[^/]*/team(2|3|x)/proj[0-9]*0[0-9]$') OR regexp_matches(path, '/proj[0-9]*7$') ELSE true END AS inside,
    k % 3 = 0 AND regexp_matches(path, '^/Users/dev[0-9]*/(.*/)?proj[0-9]*5$') AS outside FROM p)
SELECT @big(c_custkey) AS c_custkey, provider_id FROM t WHERE inside AND NOT outside AND k % 7 <> 6 AND (k % 5 <> 0 OR provider_id = 'claude')""")
def governed_projects(spark, sf_dir):
    """Projects by the globs of the config that governs each: lists out of config files, one config per nation."""
    key = F.col("n_nationkey")
    names = lambda *globs: F.array(*map(F.lit, globs))
    files = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("/Users/dev"), key.cast("string")).alias("dir"),
        F.when(key % 7 == 6, '{"schemaVersion":1,"projects":{"include":[1]}}').otherwise(F.to_json(F.struct(
            F.lit(1).alias("schemaVersion"),
            F.when(key % 5 == 0, names("claude", "gemini")).alias("providers"),
            F.struct(
                F.when(key % 4 == 1, names("~/team1*/**")).when(key % 4 == 2, names("/Users/*/team{2,3,x}/proj*0?", "**/proj*7"))
                .when(key % 4 == 3, F.array().cast("array<string>")).alias("include"),
                F.when(key % 3 == 0, names("/Users/dev*/**/proj*5", "~/nowhere/**")).alias("exclude"),
            ).alias("projects"),
        ))).alias("content"),
    )
    configs = upload_configs(files).withColumn("home", F.col("dir"))
    c = table(spark, sf_dir, "customer")
    text = {n: F.col(n).cast("string") for n in ("c_nationkey", "c_custkey")}
    home = F.concat(F.lit("/Users/dev"), text["c_nationkey"])
    groups = c.select(
        F.col("c_custkey").cast("bigint").alias("c_custkey"), home.alias("config_dir"),
        F.when(F.col("c_custkey") % 3 == 0, "codex").otherwise("claude").alias("provider_id"),
        F.concat(F.lit("~/team"), (F.col("c_custkey") % 13).cast("string"), F.lit("/proj"), text["c_custkey"]).alias("project_name"),
    )
    return S.governed_selection(groups, configs).select("c_custkey", "provider_id")


@query("""
SELECT '/w/' || @str(c_custkey) || '/a/b' AS cwd,
  CASE WHEN c_custkey % 3 = 0 THEN '/w/' || @str(c_custkey) WHEN c_custkey % 3 = 1 THEN '/w/' || @str(c_custkey) || '/a' END AS config_dir,
  CASE WHEN c_custkey % 3 = 0 THEN 'project' WHEN c_custkey % 3 = 1 THEN 'upload' END AS form
FROM customer""")
def governing_configs(spark, sf_dir):
    """Nearest config upwards of each directory; a project config wins over a nearer upload config."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("/w/"), F.col("c_custkey").cast("string")).alias("dir"))
    return nearest_configs(
        c.select(F.concat("dir", F.lit("/a/b")).alias("cwd")),
        c.where("c_custkey % 3 = 0").select("dir"),
        c.where("c_custkey % 3 < 2").select(F.concat("dir", F.lit("/a")).alias("dir")),
    )


_JOBS = _CLASSIFIED + """,
jobs AS (
  SELECT c.*, @sha256('v1/blocks' || chr(10) || @str(strlen(s.raw)) || chr(10) || @sha256(@sha256(s.raw))) AS raw_hash, strlen(s.raw) AS body, s.lang,
    CASE WHEN c.total_cost_usd < 10 THEN 'metadata' ELSE 'full' END AS tier
  FROM candidates c JOIN v_sessions s USING (path))
"""


def _jobs(spark, sf_dir):
    sessions = view(spark, sf_dir, "v_sessions")
    will = S.eligible(_candidates(spark, sf_dir)).select(
        "source_kind", "path", "session_id", "derivation", "content_hash", "kind", "size_bytes", "mtime_ms"
    )
    # Used for the jobs and for the files to hash; classified once.
    will = durable(will)
    zero = F.lit(0.0)
    metrics = sessions.select(
        "source_kind", "path", "total_cost_usd", F.col("size_bytes").cast("double").alias("total_tokens"),
        *[zero.alias(c) for c in ["input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens"]],
        F.lit(1).alias("turn_count"), F.lit("a").alias("started_at"), F.lit("b").alias("ended_at"),
        F.lit("gpt-5").alias("primary_model"), F.lit("openai").alias("model_provider"),
    )
    contents = sessions.select("path", F.encode("raw", "UTF-8").alias("content"))
    jobs = M.upload_jobs(will, metrics, raw_hashes(will.select("path"), contents))
    sizes = M.body_bytes(sessions.select("source_kind", "path", "raw"), ["source_kind", "path"])
    manifest = F.concat(F.lit("up-"), by_source_kind(lambda s: F.lit(s.provider_id)))
    return jobs, M.manifest_entries(jobs, sizes, manifest)


@query(_JOBS + """
SELECT path, session_id, raw_hash, tier, 'claude-jsonl-2026-04' AS format_version,
  CASE WHEN tier = 'metadata' THEN @big(size_bytes) END AS total_tokens,
  CASE WHEN tier = 'metadata' THEN total_cost_usd END AS cost_usd
FROM jobs""")
def upload_jobs(spark, sf_dir):
    jobs, _ = _jobs(spark, sf_dir)
    return jobs.select(
        "path", "session_id", "raw_hash", "tier", "format_version",
        F.col("total_tokens").cast("bigint").alias("total_tokens"), F.col("total_cost_usd").alias("cost_usd"),
    )


@query(_JOBS + """
SELECT 'up-claude' AS manifest_id, session_id, @big(CASE WHEN tier = 'metadata' THEN 0 ELSE body END) AS expected_bytes, 'pending' AS status FROM jobs""")
def manifest_entries(spark, sf_dir):
    _, entries = _jobs(spark, sf_dir)
    return entries.select("manifest_id", "session_id", "expected_bytes", "status")


@query(_JOBS + """
SELECT 'up-claude' AS manifest_id, 'claude-code' AS source_kind, @big(count(*)) AS expected_session_count,
  @big(sum(CASE WHEN tier = 'metadata' THEN 0 ELSE body END)) AS expected_bytes,
  @big(count(*) FILTER (WHERE tier = 'metadata')) AS metadata_sessions, 'v0.2' AS policy_version
FROM jobs""")
def manifest_headers(spark, sf_dir):
    _, entries = _jobs(spark, sf_dir)
    return M.manifest_headers(entries)


@query("SELECT path, @big(sum(strlen(raw)) + count(*) - 1) AS body_bytes FROM v_records GROUP BY path")
def payload_sizes(spark, sf_dir):
    return M.body_bytes(view(spark, sf_dir, "v_records"), ["path"])
