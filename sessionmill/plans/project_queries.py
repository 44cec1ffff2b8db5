"""Queries that group sessions by project and repository and resolve git coordinates."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionmill.functions.repo_urls import remote_identity
from sessionmill.operators import git_context as X
from sessionmill.operators import projects as G
from sessionmill.plans.registry import query
from sessionmill.plans.views import table, view
from sessionmill.sources import cursor as K
from sessionmill.sources import gemini as E

# Repository facts per host, from the construction of the git files.
_REPOS = """
WITH hosts AS (SELECT host, n, n % 11 <> 10 AS has_remote FROM v_hosts),
repos AS (
  SELECT host, n, has_remote,
    CASE WHEN NOT has_remote OR n % 4 = 3 THEN NULL
         WHEN n % 4 = 0 THEN 'github.com' WHEN n % 4 = 1 THEN host ELSE host || ':2222' END AS r_host,
    CASE WHEN NOT has_remote OR n % 4 = 3 THEN NULL WHEN n % 4 = 2 THEN 'sub' ELSE 'org' || @str(n % 3) END AS r_owner,
    CASE WHEN NOT has_remote OR n % 4 = 3 THEN NULL WHEN n % 4 = 0 THEN host WHEN n % 4 = 1 THEN 'app' ELSE @str(n % 5) END AS r_name,
    CASE WHEN n % 5 = 0 THEN NULL ELSE 'b' || @str(n % 3) END AS head_branch,
    CASE WHEN n % 5 = 0 THEN substr(@sha256(host), 1, 40) WHEN n % 3 = 0 THEN substr(@sha256('loose' || host), 1, 40)
         WHEN n % 3 = 1 THEN substr(@sha256('p1' || host), 1, 40) END AS commit_sha
  FROM hosts),
ctx AS (
  SELECT c.page_id, c.path, c.cwd, c.recorded_branch,
    CASE WHEN c.cwd = '' THEN 'no-cwd' WHEN c.cwd LIKE '/gone/%' THEN 'missing-dir' WHEN c.cwd LIKE '/tmp/%' THEN 'not-a-repo'
         WHEN NOT has_remote THEN 'no-remote' WHEN r_host IS NULL THEN 'unparseable-remote' WHEN commit_sha IS NULL THEN 'no-commit' END AS reason,
    r.*
  FROM v_cwds c JOIN repos r USING (host))
"""


def _git(spark, sf_dir):
    return tuple(view(spark, sf_dir, v) for v in ("v_dirs", "v_dot_git", "v_git_files"))


def _contexts(spark, sf_dir):
    sessions = view(spark, sf_dir, "v_cwds").drop("host")
    return X.git_context(sessions, X.cwd_repositories(sessions, *_git(spark, sf_dir)))


@query(_REPOS + """
SELECT page_id, reason, CASE WHEN reason IS NULL THEN r_host END AS host, CASE WHEN reason IS NULL THEN r_owner END AS owner,
  CASE WHEN reason IS NULL THEN r_name END AS name, CASE WHEN reason IS NULL THEN coalesce(recorded_branch, head_branch) END AS branch,
  CASE WHEN reason IS NULL THEN commit_sha END AS commit_sha
FROM ctx""")
def git_contexts(spark, sf_dir):
    c = _contexts(spark, sf_dir)
    return c.select("page_id", "reason", "host", "owner", "name", "branch", "commit_sha")


@query(_REPOS + """
SELECT @big(count(*) FILTER (WHERE reason IS NULL)) AS sessions_with_context,
  @big(count(DISTINCT CASE WHEN reason IS NULL THEN r_owner || '/' || r_name END)) AS repositories, false AS all_unresolved
FROM ctx""")
def git_context_summary(spark, sf_dir):
    return X.context_summary(_contexts(spark, sf_dir))


@query(_REPOS + "SELECT DISTINCT r_owner || '/' || r_name AS repository FROM ctx WHERE reason IS NULL")
def batch_repositories(spark, sf_dir):
    return X.context_repositories(_contexts(spark, sf_dir))


@query(_REPOS + """
SELECT CASE WHEN n % 6 = 5 THEN '/src/.worktrees/' || host ELSE '/src/' || host || '/.git' END AS git_dir, head_branch, commit_sha FROM repos""")
def head_commits(spark, sf_dir):
    return X.head_commits(view(spark, sf_dir, "v_git_files"))


@query(_REPOS + """
SELECT CASE WHEN n % 6 = 5 THEN '/src/.worktrees/' || host ELSE '/src/' || host || '/.git' END AS git_dir, has_remote,
  r_host AS host, r_owner AS owner, r_name AS name FROM repos""")
def origin_repositories(spark, sf_dir):
    return X.repositories(view(spark, sf_dir, "v_git_files")).select("git_dir", "has_remote", "repository.*")


@query("SELECT '/src/' || host AS root, CASE WHEN n % 6 = 5 THEN '/src/.worktrees/' || host ELSE '/src/' || host || '/.git' END AS git_dir FROM v_hosts")
def git_directories(spark, sf_dir):
    _, dot_git, git_files = _git(spark, sf_dir)
    return X.git_dirs(dot_git, git_files)


@query("""
SELECT DISTINCT cwd, CASE WHEN cwd LIKE '/src/%' THEN '/src/' || host END AS root FROM v_cwds WHERE cwd <> ''""")
def enclosing_roots(spark, sf_dir):
    """Nearest ancestor directory that holds a repository."""
    s = view(spark, sf_dir, "v_cwds").where("cwd <> ''")
    return G.nearest_ancestor(s, "cwd", view(spark, sf_dir, "v_dot_git"), "root")


@query("""
WITH forms AS (
  SELECT page_id, url, host, url_path,
    CASE page_id % 7 WHEN 0 THEN url WHEN 1 THEN 'git@' || host || ':' || substr(url_path, 2) || '.git' WHEN 2 THEN replace(url, '://', '://u:p@')
      WHEN 3 THEN 'ssh://git@' || host || ':2222' || url_path WHEN 4 THEN upper(host) || ':a b/c' WHEN 5 THEN 'https://' || host || ':443/x' || url_path || '.git'
      ELSE '/local' || url_path END AS remote
  FROM v_pages),
parts AS (
  SELECT *, CASE WHEN page_id % 7 IN (1) THEN substr(url_path, 2) || '.git' WHEN page_id % 7 = 5 THEN '/x' || url_path || '.git' ELSE url_path END AS p,
    CASE WHEN page_id % 7 = 3 THEN host || ':2222' ELSE host END AS h FROM forms),
segs AS (SELECT *, list_filter(string_split(regexp_replace(p, '\\.git$', ''), '/'), lambda s: s <> '') AS s FROM parts)
SELECT page_id, CASE WHEN ok THEN h END AS host, CASE WHEN ok THEN s[-2] END AS owner, CASE WHEN ok THEN s[-1] END AS name
FROM (SELECT *, page_id % 7 NOT IN (4, 6) AND len(s) >= 2 AND NOT regexp_matches(s[-1] || s[-2], '[@\\s/]') AS ok FROM segs)""")
def remote_identities(spark, sf_dir):
    """Host, owner and name out of remotes of many forms; credentials never get through."""
    v = view(spark, sf_dir, "v_pages")
    host, path, url = F.col("host"), F.col("url_path"), F.col("url")
    forms = F.array(
        url,
        F.concat(F.lit("git@"), host, F.lit(":"), F.substring(path, 2, 1 << 30), F.lit(".git")),
        F.replace(url, F.lit("://"), F.lit("://u:p@")),
        F.concat(F.lit("ssh://git@"), host, F.lit(":2222"), path),
        F.concat(F.upper(host), F.lit(":a b/c")),
        F.concat(F.lit("https://"), host, F.lit(":443/x"), path, F.lit(".git")),
        F.concat(F.lit("/local"), path),
    )
    remote = F.element_at(forms, (F.col("page_id") % 7 + 1).cast("int"))
    r = v.select("page_id", remote_identity(remote).alias("r"))
    return r.select("page_id", "r.host", "r.owner", "r.name")


@query("""
SELECT 'claude' AS provider_id, '-Users-dev-proj' || @str(conv_id % 7) AS project_id, '/Users/dev/proj' || @str(conv_id % 7) AS project_name, @big(count(*)) AS session_count
FROM (SELECT DISTINCT conv_id FROM v_lines) GROUP BY conv_id % 7
UNION ALL SELECT 'codex', 'codex', 'Codex sessions', @big(count(DISTINCT path)) FROM v_events
UNION ALL SELECT 'gemini', 'gemini', 'Gemini sessions', @big(count(*)) FROM pages
UNION ALL SELECT 'cursor', CASE WHEN p_partkey % 3 = 0 THEN 'cursor' WHEN p_partkey % 3 = 1 THEN p_brand ELSE p_type END,
  CASE WHEN p_partkey % 3 = 0 THEN 'cursor' WHEN p_partkey % 3 = 1 THEN p_brand ELSE p_type END, @big(count(*)) FROM part GROUP BY 1, 2, 3""")
def project_groups(spark, sf_dir):
    """Groups of all four tools; worktree sessions count for their main checkout."""
    chat = view(spark, sf_dir, "v_records", heavy=True).select("source_kind", "path").distinct()
    codex = view(spark, sf_dir, "v_codex", heavy=True).select("source_kind", "path").distinct()
    gemini = table(spark, sf_dir, "pages", heavy=True).select(
        F.lit("gemini").alias("source_kind"),
        F.concat(F.lit("/u/.gemini/tmp/p/chats/"), F.col("page_id").cast("string"), F.lit(".jsonl")).alias("path"),
    )
    key = F.col("p_partkey").cast("string")
    path = (
        F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("/u/state.vscdb::composer::"), key))
        .when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("/u/.cursor/projects/"), F.col("p_brand"), F.lit("/agent-transcripts/"), key, F.lit("/x.jsonl")))
        .otherwise(F.concat(F.lit("/old/"), F.col("p_type"), F.lit("/s/"), key))
    )
    cursor = table(spark, sf_dir, "part").select(F.lit("cursor").alias("source_kind"), path.alias("path"))
    sessions = chat.unionByName(codex).unionByName(gemini).unionByName(cursor)
    return G.project_groups(G.with_project(sessions))


def _page_sessions(spark, sf_dir):
    s = view(spark, sf_dir, "v_cwds").withColumnRenamed("cwd", "session_cwd")
    return G.with_project(s.drop("host"))


_PROJECT = "'-src-' || replace(host, '.', '-')"


@query(f"""
SELECT 'claude' AS provider_id, {_PROJECT} AS project_id, cwd, @big(0) AS rank FROM v_cwds WHERE cwd <> '' GROUP BY host, cwd
UNION ALL SELECT DISTINCT 'claude', {_PROJECT}, '/src/' || replace(replace(host, '.', '/'), '-', '/'), @big(1) FROM v_cwds""")
def candidate_cwds(spark, sf_dir):
    c = G.candidate_cwds(_page_sessions(spark, sf_dir))
    return c.select("provider_id", "project_id", "cwd", F.col("pos.rank").cast("bigint").alias("rank"))


_GROUP_REPOS = _REPOS + f""",
firsts AS (
  SELECT host, arg_min(CASE WHEN cwd LIKE '/src/%' AND r_host IS NOT NULL THEN r_host || '/' || r_owner || '/' || r_name END, path)
    FILTER (WHERE cwd LIKE '/src/%' AND r_host IS NOT NULL) AS repo, count(*) AS sessions
  FROM ctx GROUP BY host)
"""


@query(_GROUP_REPOS + f"SELECT 'claude' AS provider_id, {_PROJECT} AS project_id, repo FROM firsts WHERE repo IS NOT NULL")
def repository_of_group(spark, sf_dir):
    s = _page_sessions(spark, sf_dir)
    cands = G.candidate_cwds(s)
    return G.repo_of_group(cands, X.repo_keys(X.cwd_repositories(cands, *_git(spark, sf_dir))))


@query(_GROUP_REPOS + f"""
SELECT coalesce('repo:' || repo, {_PROJECT}) AS group_key, coalesce(regexp_replace(repo, '^[^/]*/', ''), '/src/' || replace(replace(host, '.', '/'), '-', '/')) AS label,
  'claude' AS provider_id, @big(sum(sessions)) AS session_count, @big(count(*)) AS merged_groups
FROM firsts GROUP BY ALL""")
def repository_groups(spark, sf_dir):
    """Project groups merged by repository, biggest first."""
    s = _page_sessions(spark, sf_dir)
    cands = G.candidate_cwds(s)
    repos = G.repo_of_group(cands, X.repo_keys(X.cwd_repositories(cands, *_git(spark, sf_dir))))
    return G.biggest_first(G.group_by_repo(G.project_groups(s), repos))


@query(_GROUP_REPOS + f"""
SELECT c.path, coalesce('repo:' || f.repo, {_PROJECT}) AS group_key
FROM ctx c JOIN firsts f USING (host)""")
def repository_sessions(spark, sf_dir):
    """The repository group of every session."""
    s = _page_sessions(spark, sf_dir)
    cands = G.candidate_cwds(s)
    repos = G.repo_of_group(cands, X.repo_keys(X.cwd_repositories(cands, *_git(spark, sf_dir))))
    return G.repository_sessions(s, repos).select("path", "group_key")


@query("""
WITH dirs AS (
  SELECT '/srv/' || p_brand || '-' || @str(p_size) AS dir FROM part UNION SELECT '/srv/' || p_brand || '/' || @str(p_size) FROM part WHERE p_size % 2 = 0),
ids AS (SELECT DISTINCT regexp_replace('/srv/' || p_brand || '-' || @str(p_size + p_partkey % 2), '[/.]', '-', 'g') AS project_id FROM part)
SELECT project_id, arg_max(dir, (list_transform(string_split(dir, '/'), lambda s: length(s)), dir)) AS dir
FROM ids LEFT JOIN dirs ON regexp_replace(dir, '[/.]', '-', 'g') = project_id GROUP BY project_id""")
def real_project_dirs(spark, sf_dir):
    """Encoded ids back to directories that exist, hyphens and all."""
    part = table(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    dashed = part.select(F.concat(F.lit("/srv/"), "p_brand", F.lit("-"), size).alias("dir"))
    nested = part.where("p_size % 2 = 0").select(F.concat(F.lit("/srv/"), "p_brand", F.lit("/"), size).alias("dir"))
    wanted = (F.col("p_size") + F.col("p_partkey") % 2).cast("string")
    ids = part.select(
        F.regexp_replace(F.concat(F.lit("/srv/"), "p_brand", F.lit("-"), wanted), "[/.]", "-").alias("project_id")
    )
    return G.real_dirs(ids, dashed.unionByName(nested).distinct())


def _kv(spark, sf_dir):
    """A key/value store of composers (conversations) and bubbles (turns)."""
    c = table(spark, sf_dir, "conversations", heavy=True)
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    store = F.concat(F.lit("/s"), (F.col("conv_id") % 3).cast("string"), F.lit("/state.vscdb"))
    name = F.when(F.col("conv_id") % 4 == 0, F.lit("5")).otherwise(F.concat(F.lit('"chat '), conv, F.lit('"')))
    # One composer row per turn count: the headers are spelled out from the last turn downwards.
    last = c.groupBy("conv_id").agg(F.max("turn").alias("last"))
    ids = F.sequence(F.lit(0).cast("bigint"), F.col("last"))
    headers = F.transform(
        ids,
        lambda t: F.concat(
            F.lit('{"bubbleId":"b'), t.cast("string"), F.lit('","type":'),
            F.when(t % 5 == 4, F.lit('"1"')).otherwise(F.lit("1")), F.lit("}"),
        ),
    )
    comps = last.select(
        store.alias("store_path"), F.concat(F.lit("composerData:c"), conv).alias("key"),
        F.when(F.col("conv_id") % 10 == 9, F.lit("{broken")).otherwise(
            F.concat(
                F.lit('{"name":'), name, F.lit(',"createdAt":'), F.col("conv_id").cast("string"),
                F.lit(',"fullConversationHeadersOnly":['),
                F.when(F.col("conv_id") % 10 == 8, F.lit("")).otherwise(F.array_join(headers, ",")), F.lit("]}"),
            )
        ).alias("value"),
    )
    bubble = F.to_json(
        F.struct(
            F.lit(1).alias("type"), F.col("text"),
            F.struct((F.length("text") * 3).alias("inputTokens")).alias("tokenCount"),
            F.when(
                F.col("turn") % 2 == 0,
                F.struct(F.lit("grep").alias("name"), F.lit("done").alias("status"), F.col("text").alias("result")),
            ).alias("toolFormerData"),
        )
    )
    bodies = c.where("conv_id % 10 <> 7 AND turn % 6 <> 3").select(
        store.alias("store_path"), F.concat(F.lit("bubbleId:c"), conv, F.lit(":b"), turn).alias("key"), bubble.alias("value")
    )
    return comps.unionByName(bodies)


_BUBBLES = """
WITH lasts AS (SELECT conv_id, max(turn) AS last FROM conversations WHERE conv_id % 10 NOT IN (7, 8, 9) GROUP BY conv_id),
heads AS (SELECT conv_id, unnest(range(last + 1)) AS turn FROM lasts),
heads2 AS (SELECT * FROM heads WHERE turn % 5 <> 4),
j AS (SELECT h.conv_id, h.turn, c.text FROM heads2 h LEFT JOIN conversations c ON c.conv_id = h.conv_id AND c.turn = h.turn AND c.turn % 6 <> 3)
"""


@query(_BUBBLES + """
SELECT '/s' || @str(conv_id % 3) || '/state.vscdb' AS store_path, 'c' || @str(conv_id) AS composer_id, @big(turn) AS pos, 'b' || @str(turn) AS bubble_id,
  text IS NOT NULL AS has_body, text, CASE WHEN text IS NOT NULL THEN @big(length(text) * 3) END AS input_tokens,
  CASE WHEN turn % 2 = 0 AND text IS NOT NULL THEN 'grep' END AS tool_name, CASE WHEN turn % 2 = 0 AND text IS NOT NULL THEN @big(length(text)) END AS tool_result_chars
FROM j""")
def composer_export(spark, sf_dir):
    """Conversation headers with their bubbles; composers without any bubble vanish."""
    e = K.composer_export(_kv(spark, sf_dir))
    return e.select(
        "store_path", "composer_id", F.col("pos").cast("bigint").alias("pos"), "bubble_id", "has_body", "text",
        F.col("input_tokens").cast("bigint").alias("input_tokens"), "tool_name", "tool_result_chars",
    )


@query(_BUBBLES + """
SELECT '/s' || @str(conv_id % 3) || '/state.vscdb::composer::c' || @str(conv_id) AS path, @big(turn + 1) AS line_no, NULL AS composer, 'b' || @str(turn) AS bubble, text FROM j
UNION ALL SELECT '/s' || @str(conv_id % 3) || '/state.vscdb::composer::c' || @str(conv_id), @big(0), 'c' || @str(conv_id), NULL, NULL FROM lasts""")
def cursor_records(spark, sf_dir):
    """Composers as the records a run reads."""
    r = K.export_records(_kv(spark, sf_dir))
    at = {"composer": "$.composer.composerId", "bubble": "$.bubble.bubbleId", "text": "$.bubble.text"}
    return r.select("path", "line_no", *[F.get_json_object("raw", p).alias(n) for n, p in at.items()])


@query("""
SELECT 'c' || @str(conv_id) AS composer_id, '/s' || @str(conv_id % 3) || '/state.vscdb' AS store_path,
  CASE WHEN conv_id % 4 <> 0 THEN 'chat ' || @str(conv_id) END AS name, conv_id::DOUBLE AS created_at
FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 10 <> 9)""")
def composers(spark, sf_dir):
    return K.composers(_kv(spark, sf_dir)).select("composer_id", "store_path", "name", "created_at")


@query("""
SELECT 'cursor' AS source_kind, '/s' || @str(conv_id % 3) || '/state.vscdb::composer::c' || @str(conv_id) AS path, @big(1000 + conv_id % 3) AS size_bytes
FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 10 NOT IN (7, 8, 9))
UNION ALL SELECT DISTINCT 'cursor', '/u/.cursor/projects/w/agent-transcripts/' || @str(conv_id) || '/t.jsonl', @big(7) FROM conversations""")
def cursor_sessions(spark, sf_dir):
    """Both kinds of Cursor sessions in one listing."""
    stores = spark.range(3).select(
        F.concat(F.lit("/s"), F.col("id").cast("string"), F.lit("/state.vscdb")).alias("store_path"),
        (F.col("id") + 1000).alias("size_bytes"), F.lit(0.0).alias("mtime_ms"),
    )
    refs = K.composer_refs(_kv(spark, sf_dir), stores)
    files = table(spark, sf_dir, "conversations", heavy=True).select("conv_id").distinct().select(
        F.lit("cursor").alias("source_kind"),
        F.concat(F.lit("/u/.cursor/projects/w/agent-transcripts/"), F.col("conv_id").cast("string"), F.lit("/t.jsonl")).alias("path"),
        F.lit(7).cast("bigint").alias("size_bytes"), F.lit(0.0).alias("mtime_ms"),
    )
    return refs.unionByName(files).select("source_kind", "path", "size_bytes")


@query("""
WITH t AS (
  SELECT conv_id, turn, CASE WHEN role = 'user' THEN 1 ELSE 2 END AS type,
    CASE turn % 3 WHEN 0 THEN text || chr(10) || 'more' WHEN 1 THEN text ELSE 'as string' END AS text,
    CASE WHEN turn % 3 = 0 THEN 'Read,Edit' ELSE '' END AS tools,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos
  FROM conversations WHERE role IN ('user', 'assistant'))
SELECT '/t/' || @str(conv_id) AS path, @big(pos) AS pos, 'b' || @str(pos) AS bubble_id, type, text, tools AS tool_names FROM t""")
def transcript_export(spark, sf_dir):
    """Terminal transcripts in the export shape: numbered turns, joined text parts, tool names."""
    c = table(spark, sf_dir, "conversations", heavy=True)
    text = F.to_json(F.struct(F.lit("text").alias("type"), F.col("text")))
    tools = F.lit('{"type":"tool_use","name":"Read","input":{"x":1}},{"type":"tool_use","name":"Edit"},{"type":"tool_use","name":""}')
    content = (
        F.when(F.col("turn") % 3 == 0, F.concat(F.lit('{"content":['), text, F.lit(","), tools, F.lit(',{"type":"text","text":"more"},{"type":"text","text":""}]}')))
        .when(F.col("turn") % 3 == 1, F.to_json(F.struct(F.col("text").alias("content"))))
        .otherwise(F.lit('"as string"'))
    )
    raw = F.concat(F.lit('{"role":"'), F.col("role"), F.lit('","message":'), content, F.lit("}"))
    records = c.select(
        F.concat(F.lit("/t/"), F.col("conv_id").cast("string")).alias("path"), F.col("turn").alias("line_no"), raw.alias("raw")
    )
    e = K.transcript_export(records)
    return e.select("path", "pos", "bubble_id", "type", "text", F.array_join("tool_names", ",").alias("tool_names"))


@query("""
WITH c AS (SELECT c_custkey, '/home/u' || @str(c_nationkey) || '/.gemini' AS root, '/w/' || c_name AS cwd, 'l' || @str(c_custkey % 30) AS label FROM customer),
s AS (
  SELECT o_orderkey, '/home/u' || @str(c_nationkey) || '/.gemini' AS root, 'l' || @str(c_custkey % 30) AS label,
    CASE o_orderkey % 3 WHEN 0 THEN @sha256('/w/' || c_name) WHEN 1 THEN @sha256('/x') END AS project_hash
  FROM orders JOIN customer ON o_custkey = c_custkey),
one AS (SELECT root, label, min(cwd) AS cwd FROM c GROUP BY root, label HAVING count(*) = 1)
SELECT o_orderkey AS id, c.cwd FROM s JOIN c ON c.root = s.root AND c.label = s.label AND @sha256(c.cwd) = s.project_hash
UNION ALL SELECT o_orderkey, one.cwd FROM s JOIN one USING (root, label) WHERE project_hash IS NULL""")
def gemini_cwds(spark, sf_dir):
    """Labels back to directories, checked by their hash; without a hash only if unambiguous."""
    cust = table(spark, sf_dir, "customer")
    root = F.concat(F.lit("/home/u"), F.col("c_nationkey").cast("string"), F.lit("/.gemini"))
    label = F.concat(F.lit("l"), (F.col("c_custkey") % 30).cast("string"))
    cwd = F.concat(F.lit("/w/"), F.col("c_name"))
    # One registry file per customer; their entries add up per root.
    content = F.concat(F.lit('{"projects":{"'), cwd, F.lit('":"'), label, F.lit('","":"x","/n":5,"/e":""}}'))
    cands = E.registry(cust.select(root.alias("root"), content.alias("content")))
    o = table(spark, sf_dir, "orders").join(cust, F.col("o_custkey") == F.col("c_custkey"))
    mode = F.col("o_orderkey") % 3
    sessions = o.select(
        F.concat(root, F.lit("/tmp/"), label, F.lit("/chats/"), F.col("o_orderkey").cast("string"), F.lit(".jsonl")).alias("path"),
        F.when(mode == 0, F.sha2(cwd, 256)).when(mode == 1, F.sha2(F.lit("/x"), 256)).alias("project_hash"),
    )
    found = E.resolve_cwds(sessions, cands)
    return found.select(F.regexp_extract("path", r"/([0-9]+)\.jsonl$", 1).cast("bigint").alias("id"), "cwd")
