"""Queries over captured inventories: MCP servers, plugins, hooks, skills, context files."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionmill.functions.redaction_rules import CATEGORIES
from sessionmill.functions.rows import unnest
from sessionmill.operators import snapshots as N
from sessionmill.plans.redaction_queries import _col, context, redaction_ctes
from sessionmill.plans.registry import query
from sessionmill.plans.views import table
from sessionmill.sources.files import sidecar_records, sidecars_as_records


def _mcp_docs(spark, sf_dir):
    """One captured list per page: a remote server, a local one, a line that is none."""
    p = table(spark, sf_dir, "pages")
    key = F.col("page_id").cast("string")
    mark = F.element_at(F.array(F.lit("✓ Connected"), F.lit("✗ Failed to connect"), F.lit("⏸ Pending")), (F.col("page_id") % 3 + 1).cast("int"))
    text = F.concat(
        F.lit("Checking MCP server health…\n\n"),
        F.lit("plugin:a:s"), key, F.lit(": "), F.col("url"), F.lit(" (HTTP) - "), mark,
        F.lit("\n  local-"), (F.col("page_id") % 7).cast("string"), F.lit(": npx tool@"), key, F.lit(" - ✓ Connected\n"),
        F.lit("plugin:a:s"), key, F.lit(": again (SSE) - ⏸ Pending\n"),
        F.when(F.col("page_id") % 5 == 0, F.lit("no server here\n")).otherwise(F.lit("")),
    )
    return p.select(F.col("page_id").alias("doc_id"), text.alias("text"))


_GLYPH = "CASE page_id % 3 WHEN 0 THEN 'connected' WHEN 1 THEN 'failed' ELSE 'pending' END"


@query(f"""
SELECT page_id AS doc_id, 'plugin:a:s' || @str(page_id) AS name, 'http' AS transport, url AS target, {_GLYPH} AS status FROM pages
UNION ALL SELECT page_id, 'local-' || @str(page_id % 7), 'stdio', 'npx tool@' || @str(page_id), 'connected' FROM pages
UNION ALL SELECT page_id, 'plugin:a:s' || @str(page_id), 'http', 'again', 'pending' FROM pages""")
def mcp_servers(spark, sf_dir):
    return N.mcp_servers(_mcp_docs(spark, sf_dir)).drop("line_no")


@query("SELECT page_id AS doc_id, CASE WHEN page_id % 5 = 0 THEN 'unparsed' ELSE 'parsed' END AS parse_status FROM pages")
def mcp_parse_status(spark, sf_dir):
    return N.mcp_parse_status(_mcp_docs(spark, sf_dir))


@query(f"""
SELECT page_id AS doc_id, 'plugin:a:s' || @str(page_id) AS name, {_GLYPH} AS status FROM pages
UNION ALL SELECT page_id, 'local-' || @str(page_id % 7), 'connected' FROM pages""")
def declared_mcp_servers(spark, sf_dir):
    """Distinct names per list, the first entry of a name wins."""
    return N.declared_servers(N.mcp_servers(_mcp_docs(spark, sf_dir)))


@query("""
WITH c AS (SELECT s_suppkey, s_nationkey AS n, s_suppkey % 2 = 0 AS big FROM supplier),
i AS (SELECT s_suppkey, unnest(range(n * CASE WHEN big THEN 8 ELSE 1 END)) AS k, n * CASE WHEN big THEN 8 ELSE 1 END AS total FROM c)
SELECT s_suppkey AS doc_id, 'srv' || @str(k) AS name, 'unknown' AS status FROM i WHERE total <= 100""")
def json_mcp_servers(spark, sf_dir):
    """JSON lists; a list of more than 100 names declares nothing."""
    s = table(spark, sf_dir, "supplier")
    n = F.col("s_nationkey") * F.when(F.col("s_suppkey") % 2 == 0, 8).otherwise(1)
    ks = F.filter(F.sequence(F.lit(0), F.lit(24 * 8)), lambda k: k < n)
    items = F.transform(ks, lambda k: F.concat(F.lit('{"name":"srv'), k.cast("string"), F.lit('"}')))
    text = F.concat(F.lit('[{"name":5},{"x":1}'), F.when(F.size(items) > 0, F.lit(",")).otherwise(F.lit("")), F.array_join(items, ","), F.lit("]"))
    docs = s.select(F.col("s_suppkey").alias("doc_id"), text.alias("text"))
    return N.declared_servers(N.json_mcp_servers(docs))


@query("""
SELECT p_partkey AS doc_id, @big(1) AS block, p_name || '@' || p_brand AS name, CASE WHEN p_size % 4 = 0 THEN 'unknown' ELSE '1.' || @str(p_size) END AS version,
  'managed' AS scope, CASE WHEN p_size % 3 = 0 THEN 'disabled' ELSE 'enabled' END AS status FROM part
UNION ALL SELECT p_partkey, @big(2), 'bare' || @str(p_size), 'unknown', 'unknown', 'disabled' FROM part""")
def installed_plugins(spark, sf_dir):
    """Blocks of a plugin list with defaults for missing keys."""
    p = table(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    text = F.concat(
        F.lit("Installed plugins:\nVersion: stray\n\n  ❯ "), F.col("p_name"), F.lit("@"), F.col("p_brand"),
        F.when(F.col("p_size") % 4 == 0, F.lit("\n    Version: unknown")).otherwise(F.concat(F.lit("\n    Version: 1."), size)),
        F.lit("\n    Scope: managed\n    Status: "),
        F.when(F.col("p_size") % 3 == 0, F.lit("✘ disabled")).otherwise(F.lit("✔ Enabled")),
        F.lit("\n\n  ❯ bare"), size, F.lit("\n    Color: red\n"),
    )
    return N.plugins(p.select(F.col("p_partkey").alias("doc_id"), text.alias("text")))


def _hook_layers(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey").cast("string")
    mode = F.col("c_custkey") % 5
    nested = F.concat(
        F.lit('{"hooks":{"PreToolUse":[{"matcher":"Bash","hooks":[{"command":"run '), key, F.lit('"},{"type":"x"}]}],"Stop":[{"hooks":[{"command":"end"}]}]}}')
    )
    top = F.concat(F.lit('{"SessionEnd":[{"matcher":7,"hooks":[{"command":"bye '), key, F.lit('"}]}]}'))
    text = (
        F.when(mode == 0, nested).when(mode == 1, top).when(mode == 2, F.lit('{"model":"x"}'))
        .when(mode == 3, F.lit('{"hooks":{"Stop":{"a":1},"Notification":[5,{"hooks":[{"command":"ok"}]}]}}'))
    )
    return c.select(
        F.concat(F.lit("m"), (F.col("c_custkey") % 400).cast("string")).alias("machine_id"),
        F.concat(F.lit("layer-"), key).alias("source"), text.alias("config"),
    )


@query("""
SELECT 'm' || @str(c_custkey % 400) AS machine_id, 'layer-' || @str(c_custkey) AS source, h.event AS event, h.matcher AS matcher, h.command AS command
FROM (SELECT c_custkey, unnest(CASE c_custkey % 5
  WHEN 0 THEN [{'event': 'PreToolUse', 'matcher': 'Bash', 'command': 'run ' || @str(c_custkey)}, {'event': 'PreToolUse', 'matcher': 'Bash', 'command': ''}, {'event': 'Stop', 'matcher': NULL, 'command': 'end'}]
  WHEN 1 THEN [{'event': 'SessionEnd', 'matcher': NULL, 'command': 'bye ' || @str(c_custkey)}]
  WHEN 3 THEN [{'event': 'Notification', 'matcher': NULL, 'command': 'ok'}] END) AS h FROM customer)""")
def merged_hooks(spark, sf_dir):
    """Hooks of all settings layers; unreadable layers and odd entries give none."""
    return N.hooks(_hook_layers(spark, sf_dir)).select("machine_id", "source", "event", "matcher", "command")


@query("""
SELECT 'm' || @str(c_custkey % 400) AS machine_id, CASE WHEN bool_or(c_custkey % 5 IN (3, 4)) THEN 'unparsed' ELSE 'parsed' END AS parse_status
FROM customer GROUP BY c_custkey % 400""")
def hook_parse_status(spark, sf_dir):
    return N.hook_parse_status(_hook_layers(spark, sf_dir))


def _machine(column):
    return F.concat(F.lit("m"), F.col(column).cast("string"))


@query("""
SELECT 'm' || @str(c_custkey) AS machine_id, 'plugin:' || 'kit' || @str(c_nationkey) || '@' || lower(c_mktsegment) AS source,
  '/home/' || @str(c_custkey) || '/.claude/plugins/cache/' || lower(c_mktsegment) || '/kit' || @str(c_nationkey) || '/1.' || @str(c_nationkey) AS dir
FROM customer WHERE c_custkey % 4 NOT IN (1, 2)""")
def plugin_directories(spark, sf_dir):
    """Cache directories of enabled plugins that exist."""
    c = table(spark, sf_dir, "customer")
    key, n = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    home = F.concat(F.lit("/home/"), key)
    name = F.concat(F.lit("kit"), n, F.lit("@"), F.lower("c_mktsegment"))
    rows = c.select(
        _machine("c_custkey").alias("machine_id"), home.alias("home"),
        F.when(F.col("c_custkey") % 4 == 2, F.lit("nomarket")).otherwise(name).alias("name"),
        F.concat(F.lit("1."), n).alias("version"),
        F.when(F.col("c_custkey") % 4 == 1, "disabled").otherwise("enabled").alias("status"),
    )
    dirs = c.select(
        _machine("c_custkey").alias("machine_id"),
        F.concat(home, F.lit("/.claude/plugins/cache/"), F.lower("c_mktsegment"), F.lit("/kit"), n, F.lit("/1."), n).alias("dir"),
    )
    return N.plugin_dirs(rows, dirs)


@query("""
SELECT 'm' || @str(c_custkey) AS machine_id, k.name AS name, k.kind AS kind, 'user' AS source
FROM (SELECT c_custkey, unnest([{'name': 'deploy' || @str(c_nationkey), 'kind': 'skill'}, {'name': 'fix', 'kind': 'slash_command'}, {'name': lower(c_mktsegment), 'kind': 'agent'}]) AS k FROM customer)
WHERE k.kind <> 'agent' OR c_custkey % 2 = 0""")
def skills_and_agents(spark, sf_dir):
    """Installed skills, commands and agents by name; hidden entries and other files drop out."""
    c = table(spark, sf_dir, "customer")
    root = F.concat(F.lit("/home/"), F.col("c_custkey").cast("string"), F.lit("/.claude"))
    agent = F.concat(F.lit("/agents/"), F.lower("c_mktsegment"), F.when(F.col("c_custkey") % 2 == 0, ".md").otherwise(".txt"))
    rels = [
        F.concat(F.lit("/skills/deploy"), F.col("c_nationkey").cast("string"), F.lit("/SKILL.md")),
        F.concat(F.lit("/skills/deploy"), F.col("c_nationkey").cast("string"), F.lit("/commands/x.md")),
        F.lit("/commands/fix.md"), F.lit("/commands/.hidden.md"), F.lit("/notes/agents.md"), agent,
    ]
    paths = F.transform(F.array(*rels), lambda r: F.concat(root, r))
    files = unnest(c, [_machine("c_custkey").alias("machine_id")], paths, "path").drop("_pos")
    roots = c.select(_machine("c_custkey").alias("machine_id"), F.lit("user").alias("source"), root.alias("dir"))
    return N.skills_and_agents(roots, files)


@query("""
SELECT p_partkey AS doc_id, k.name AS name, k.scope AS scope
FROM (SELECT p_partkey, p_size, unnest([{'name': p_name, 'scope': 'user'}, {'name': p_type, 'scope': 'project'}, {'name': 'dup', 'scope': 'plugin'}]) AS k FROM part)
WHERE p_size % 5 <> 0""")
def skill_scopes(spark, sf_dir):
    """Skills table of a context breakdown: scope per skill, built-in ones dropped."""
    p = table(spark, sf_dir, "part", heavy=True)
    head = F.when(F.col("p_size") % 5 == 0, F.lit("| Skill | Tokens |")).otherwise(F.lit("| Skill | Source | Tokens |"))
    text = F.concat(
        F.lit("# Context\r\n\r\n### Agents\r\n| Skill | Source |\r\n|---|---|\r\n| wrong | User |\r\n\r\n### Skills  \r\n\r\n"),
        head, F.lit("\n|:---|---:|---|\n| "), F.col("p_name"), F.lit(" | User | 5 |\nnote\n  | "), F.col("p_type"),
        F.lit(" | Project | 7 |\n| dup | Plugin (x) | 1 |\n| dup | plugin (y) | 2 |\n| core | Built-in | 3 |\n| | User | 1 |\n## Other\n| a | User | 1 |\n"),
    )
    return N.skill_scopes(p.select(F.col("p_partkey").alias("doc_id"), text.alias("text"))).select("doc_id", "name", "scope")


@query("""
SELECT c_custkey AS doc_id, lower(c_mktsegment) AS name FROM customer UNION ALL SELECT c_custkey, 'my server ' || @str(c_nationkey) FROM customer""")
def toml_mcp_names(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    text = F.concat(
        F.lit('model = "x"\n[mcp_servers.'), F.lower("c_mktsegment"), F.lit(']\ncommand = "npx"\n  [mcp_servers."my server '),
        F.col("c_nationkey").cast("string"), F.lit('"]  \n[mcp_servers.a.env]\n[other.b]\n'),
    )
    return N.toml_mcp_names(c.select(F.col("c_custkey").alias("doc_id"), text.alias("text"))).drop("line_no")


@query("SELECT c_custkey AS doc_id, unnest([lower(c_mktsegment), 's' || @str(c_nationkey)]) AS name FROM customer WHERE c_custkey % 3 <> 0")
def json_mcp_names(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    good = F.concat(F.lit('{"theme":"x","mcpServers":{"'), F.lower("c_mktsegment"), F.lit('":{"command":"a"},"s'), F.col("c_nationkey").cast("string"), F.lit('":{}}}'))
    bad = F.when(F.col("c_custkey") % 2 == 0, F.lit('{"mcpServers":["a"]}')).otherwise(F.lit('{"mcpServers":'))
    text = F.when(F.col("c_custkey") % 3 == 0, bad).otherwise(good)
    return N.json_mcp_names(c.select(F.col("c_custkey").alias("doc_id"), text.alias("text"))).drop("line_no")


@query("""
WITH w AS (SELECT c_custkey, c_custkey % 3 AS k, length(c_name) AS n FROM customer)
SELECT 'm' || @str(c_custkey) AS machine_id, i.name AS name, i.category AS category, i.chars AS chars
FROM (SELECT c_custkey, k, unnest([
  {'name': '~/.codex/AGENTS.md', 'category': 'memory_files', 'chars': @big(n + 2), 'need': k < 2},
  {'name': 'AGENTS.md (codex project)', 'category': 'memory_files', 'chars': @big(4), 'need': k < 2},
  {'name': 'AGENTS.md (codex cwd)', 'category': 'memory_files', 'chars': @big(9), 'need': k = 1},
  {'name': 'srv', 'category': 'mcp_tools', 'chars': CAST(NULL AS BIGINT), 'need': k = 0}]) AS i FROM w) WHERE i.need""")
def context_artifacts(spark, sf_dir):
    """Instruction files a tool loads, by size, and its declared servers."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey") % 3
    home = F.concat(F.lit("/home/"), F.col("c_custkey").cast("string"))
    cwd = F.when(k == 1, F.concat(home, F.lit("/r/sub"))).otherwise(F.concat(home, F.lit("/r")))
    ws = c.select(_machine("c_custkey").alias("machine_id"), home.alias("home"), cwd.alias("cwd"))

    def file(rel, content, keep):
        return c.where(keep).select(_machine("c_custkey").alias("machine_id"), F.concat(home, F.lit(rel)).alias("path"), content.alias("content"))

    files = (
        file("/r/.git/HEAD", F.lit("x"), k < 3)
        .unionByName(file("/.codex/AGENTS.md", F.concat(F.col("c_name"), F.lit("😀")), k < 2))
        .unionByName(file("/r/AGENTS.md", F.lit("abcd"), k < 2))
        .unionByName(file("/r/sub/AGENTS.md", F.lit("123456789"), k < 2))
    )
    servers = c.where(k == 0).select(_machine("c_custkey").alias("machine_id"), F.lit("srv").alias("name"))
    return N.context_artifacts("codex", ws, files, servers).drop("cwd")


_PAGES, _ = redaction_ctes("pages", "page_id", "'target: npx x --key=' || md5(url) || ' KEY=' || url || ' ' || html")


@query(_PAGES + "SELECT page_id AS doc_id, @sha256(text) AS h, " + " + ".join(_col(c) for c in CATEGORIES) + " AS hits FROM redacted")
def redacted_snapshots(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    text = F.concat(F.lit("target: npx x --key="), F.md5("url"), F.lit(" KEY="), F.col("url"), F.lit(" "), F.col("html"))
    out = N.redact_snapshots(p.select(F.col("page_id").alias("doc_id"), text.alias("text")), context())
    hits = sum((F.col(_col(c)) for c in CATEGORIES), F.lit(0).cast("bigint"))
    return out.select("doc_id", F.sha2("text", 256).alias("h"), hits.alias("hits"))


@query("""
WITH s AS (SELECT user_id, event_type AS kind, CASE WHEN user_id % 4 = 0 THEN NULL ELSE 'p' || @str(user_id % 3) END AS project, event_id, ts, @sha256('{"v":' || @str(@big(floor(value / 40))) || '}') AS h FROM events),
p AS (SELECT *, lag(h) OVER (PARTITION BY user_id, kind, project ORDER BY ts, h) AS before FROM s)
SELECT event_id, h AS content_hash FROM p WHERE before IS NULL OR before <> h""")
def changed_snapshots(spark, sf_dir):
    """Snapshots that differ from the previous one; the capture time is no part of the hash."""
    e = table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").cast("string").alias("user_id"), F.col("event_type").alias("kind"),
        F.when(F.col("user_id") % 4 != 0, F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string"))).alias("project"),
        F.col("ts").alias("captured_at"), F.floor(F.col("value") / 40).alias("v"),
    )
    snaps = e.withColumn("content_hash", N.snapshot_key(["v", "captured_at"]))
    return N.changed_snapshots(snaps).select("event_id", "content_hash")


@query("""
SELECT '/u/.claude/projects/p' || source || '/' || lang || '.jsonl' AS path, 'r' || lpad(@str(doc_id), 8, '0') AS file_id, @big(strlen(text)) AS bytes, @big(length(text)) AS chars,
  @big(row_number() OVER (PARTITION BY source, lang ORDER BY doc_id)) AS n
FROM documents""")
def sidecar_sizes(spark, sf_dir):
    """Size records of tool results, numbered in name order; contents do not get through."""
    d = table(spark, sf_dir, "documents")
    path = F.concat(
        F.lit("/u/.claude/projects/p"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("/tool-results/r"),
        F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".txt"),
    )
    sizes = sidecar_records(d.select(path.alias("path"), F.encode("text", "UTF-8").alias("content")))
    rows = sidecars_as_records(sizes)
    return rows.select(
        "path", F.get_json_object("raw", "$.file_id").alias("file_id"),
        F.get_json_object("raw", "$.bytes").cast("bigint").alias("bytes"),
        F.get_json_object("raw", "$.chars").cast("bigint").alias("chars"),
        (F.col("line_no") - F.lit(2**62)).alias("n"),
    )
