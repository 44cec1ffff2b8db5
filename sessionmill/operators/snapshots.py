"""Captured tool inventories: text tables in, typed tables out.

`docs` tables have (doc_id, text): the captured output or file, one per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmill.functions.json_text import is_json, string_or_null
from sessionmill.functions.rows import unnest, unnest_map
from sessionmill.functions.text import UNICODE_BLANKS, trim_blank, utf16_length
from sessionmill.operators.ordering import carry_forward, first_per_key
from sessionmill.operators.projects import nearest_ancestor
from sessionmill.operators.redact import RedactionContext, redact_text

# Texts and limits of the captured formats.
MCP_BANNER = "Checking MCP server health"
MCP_STATUS = {"✓": "connected", "✗": "failed", "⏸": "pending"}
MAX_DECLARED_SERVERS = 100
HOOK_EVENT_HINT = "ToolUse|Stop|Prompt|Session|Notification|PreCompact|SubagentStop"
INVENTORY_DIRS = {"skills": "skill", "commands": "slash_command", "agents": "agent"}
ARTIFACT_FILES = {"codex": ("AGENTS.md", ".codex/AGENTS.md"), "gemini": ("GEMINI.md", ".gemini/GEMINI.md"),
                  "cursor": ("AGENTS.md", None)}

# Kinds of a remote target, in brackets at its end.
MCP_REMOTE = ["HTTP", "SSE"]


def _doc_lines(docs: DataFrame, split: str = "\n") -> DataFrame:
    text_lines = F.split("text", split, -1)
    return unnest(docs, ["doc_id"], text_lines, "line", "line_no").select(
        "doc_id", F.col("line_no").cast("bigint").alias("line_no"), "line"
    )


def _mcp_relevant(line: Column) -> Column:
    return (line != "") & ~F.startswith(line, F.lit(MCP_BANNER))


def _mcp_fields(line: Column) -> Column:
    """name, target and mark of a trimmed line `name: target - mark words`, null for any other line.

    The name is the first word and ends in a colon; what stands before the first dash that a mark follows
    is the target.
    """
    word = F.split(line, r"\s", 2)
    head, rest = F.get(word, F.lit(0)), trim_blank(F.get(word, F.lit(1)))
    marks = "".join(MCP_STATUS)
    halves = F.split(rest, rf"\s+-\s+(?=[{marks}]\s)", 2)
    target, tail = F.get(halves, F.lit(0)), F.get(halves, F.lit(1))
    complete = F.endswith(head, F.lit(":")) & (F.length(head) > 1) & (target != "") & tail.isNotNull()
    fields = F.struct(F.left(head, F.length(head) - 1).alias("name"), target.alias("target"), F.left(tail, F.lit(1)).alias("mark"))
    return F.when(complete, fields)


def mcp_servers(docs: DataFrame) -> DataFrame:
    """Servers of an MCP list text: name, transport, target, health."""
    line = F.col("line")
    rows = _doc_lines(docs).withColumn("line", trim_blank(line)).where(_mcp_relevant(line))
    rows = rows.withColumn("_f", _mcp_fields(line)).where("_f IS NOT NULL")
    target, status = F.col("_f.target"), F.lit("unknown")
    for mark, word in MCP_STATUS.items():
        status = F.when(F.col("_f.mark") == mark, word).otherwise(status)
    kind = F.substring_index(target, "(", -1)
    remote = F.contains(target, F.lit("(")) & kind.isin([f"{k})" for k in MCP_REMOTE])
    return rows.select(
        "doc_id", "line_no",
        F.col("_f.name").alias("name"),
        F.when(remote, "http").otherwise("stdio").alias("transport"),
        F.when(remote, trim_blank(F.left(target, F.length(target) - F.length(kind) - 1))).otherwise(target).alias("target"),
        status.alias("status"),
    )


def mcp_parse_status(docs: DataFrame) -> DataFrame:
    """'unparsed' for a text with a line that could not be read; found out inside the row."""
    bad = F.exists(
        F.transform(F.split("text", "\n", -1), trim_blank),
        lambda s: _mcp_relevant(s) & _mcp_fields(s).isNull(),
    )
    return docs.select("doc_id", F.when(bad, "unparsed").otherwise("parsed").alias("parse_status"))


def json_mcp_servers(docs: DataFrame) -> DataFrame:
    """Names of a JSON MCP list; health is not part of that form."""
    items = F.when(is_json(F.col("text")), F.from_json("text", "array<struct<name: variant>>"))
    return (
        unnest(docs, ["doc_id"], items, "_s", "line_no")
        .select(
            "doc_id",
            F.col("line_no").cast("bigint").alias("line_no"),
            string_or_null(F.col("_s.name")).alias("name"),
            F.lit("unknown").alias("status"),
        )
        .where("name IS NOT NULL")
    )


def declared_servers(servers: DataFrame, limit: int = MAX_DECLARED_SERVERS) -> DataFrame:
    """Distinct servers per document, the first entry of a name wins. A document with more than
    `limit` names declares nothing, which is the receiving side's contract."""
    first = first_per_key(
        servers.select("doc_id", "name", "status", "line_no"), ["doc_id", "name"], F.col("line_no")
    )
    few = first.groupBy("doc_id").agg(F.count("*").alias("_n")).where(F.col("_n") <= limit)
    return first.join(few, "doc_id", "left_semi").select("doc_id", "name", "status")


def plugins(docs: DataFrame) -> DataFrame:
    """Plugin list blocks: a line with the pointer glyph opens a block, key lines follow.

    The text is cut into its blocks inside the row; nothing is shuffled.
    """
    opening = rf"\n[{UNICODE_BLANKS}]*❯[\s&&[^\n]]+(?=[^{UNICODE_BLANKS}])"
    parts = F.split(F.concat(F.lit("\n"), F.col("text")), opening, -1)
    blocks = unnest(docs, ["doc_id"], parts, "body", "block").where("block > 0")
    body = F.col("body")

    def last(key: str) -> Column:
        values = F.regexp_extract_all(body, F.lit(rf"\n[{UNICODE_BLANKS}]*{key}:([^\n]*)"), F.lit(1))
        named = F.filter(F.transform(values, trim_blank), lambda v: v != "")
        return F.try_element_at(named, F.lit(-1))

    enabled = F.coalesce(last("Status").rlike("(?i)enabled"), F.lit(False))
    return blocks.select(
        "doc_id",
        F.col("block").cast("bigint").alias("block"),
        trim_blank(F.substring_index(body, "\n", 1)).alias("name"),
        F.coalesce(last("Version"), F.lit("unknown")).alias("version"),
        F.coalesce(last("Scope"), F.lit("unknown")).alias("scope"),
        F.when(enabled, "enabled").otherwise("disabled").alias("status"),
    )


def _hook_entries(layers: DataFrame) -> DataFrame:
    """(machine_id, source, event, entries, readable) per event of each layer."""
    v = F.try_parse_json("config")
    readable = F.coalesce(is_json(F.col("config")) & (F.schema_of_variant(v) != "VOID"), F.lit(False))
    nested = F.try_variant_get(v, "$.hooks", "map<string,variant>")
    top = F.try_variant_get(v, "$", "map<string,variant>")
    hinted = F.exists(F.map_keys(top), lambda k: k.rlike(HOOK_EVENT_HINT))
    events = F.coalesce(nested, F.when(hinted, top))
    return layers.select("machine_id", "source", readable.alias("readable"), events.alias("events"))


def _is_array(v: Column) -> Column:
    return F.schema_of_variant(v).like("ARRAY%")


def _is_object(v: Column) -> Column:
    return F.schema_of_variant(v).like("OBJECT%")


def _array_or_empty(v: Column) -> Column:
    empty = F.lit([]).cast("array<string>")
    items = F.when(_is_array(v), F.try_variant_get(v, "$", "array<variant>"))
    return F.coalesce(items, F.transform(empty, lambda s: F.parse_json(s)))


def hooks(layers: DataFrame) -> DataFrame:
    """Hooks of settings layers and plugins: event, matcher, command, source."""
    per_event = unnest_map(
        _hook_entries(layers), ["machine_id", "source"], "events", "event", "_entries"
    )
    per_entry = unnest(
        per_event, ["machine_id", "source", "event"], _array_or_empty(F.col("_entries")), "_e", "entry_no"
    ).where(_is_object(F.col("_e")))
    matcher = F.try_variant_get("_e", "$.matcher", "variant")
    matcher = F.when(F.schema_of_variant(matcher) == "STRING", F.try_variant_get(matcher, "$", "string"))
    per_hook = unnest(
        per_entry,
        ["machine_id", "source", "event", "entry_no", matcher.alias("matcher")],
        _array_or_empty(F.try_variant_get("_e", "$.hooks", "variant")),
        "_h",
        "hook_no",
    ).where(_is_object(F.col("_h")))
    command = F.try_variant_get("_h", "$.command", "variant")
    return per_hook.select(
        "machine_id", "source", "event", "entry_no", "hook_no", "matcher",
        F.coalesce(string_or_null(command), F.lit("")).alias("command"),
    )


def hook_parse_status(layers: DataFrame) -> DataFrame:
    """'unparsed' where a layer could not be read or an entry has the wrong shape."""

    def bad_entry(e: Column) -> Column:
        inner = _array_or_empty(F.try_variant_get(e, "$.hooks", "variant"))
        return ~_is_object(e) | F.exists(inner, lambda h: ~_is_object(h))

    bad_event = F.exists(
        F.map_values("events"),
        lambda v: ~_is_array(v) | F.exists(_array_or_empty(v), bad_entry),
    )
    bad = ~F.col("readable") | F.coalesce(bad_event, F.lit(False))
    return (
        _hook_entries(layers)
        .groupBy("machine_id")
        .agg(F.when(F.bool_or(bad), "unparsed").otherwise("parsed").alias("parse_status"))
    )


def plugin_dirs(plugin_rows: DataFrame, dirs: DataFrame) -> DataFrame:
    """Cache directory of enabled plugins (name@marketplace, resolved version) that exists.

    `plugin_rows` carries machine_id and home; `dirs` has (machine_id, dir).
    """
    name = F.col("name")
    marketplace = F.substring_index(name, "@", -1)
    package = F.substring(name, F.lit(1), F.length(name) - F.length(marketplace) - 1)
    path = F.concat_ws(
        "/", F.col("home"), F.lit(".claude/plugins/cache"), marketplace, package, F.col("version")
    )
    rows = plugin_rows.where(
        (F.col("status") == "enabled") & F.contains(name, F.lit("@")) & (package != "")
    ).select("machine_id", F.concat(F.lit("plugin:"), "name").alias("source"), path.alias("dir"))
    return rows.join(dirs.select("machine_id", "dir"), ["machine_id", "dir"], "left_semi").select(
        "machine_id", "source", "dir"
    )


def skills_and_agents(roots: DataFrame, files: DataFrame) -> DataFrame:
    """Names in skills/, commands/ and agents/ below each root; hidden names are dropped.

    A file path is cut at every such directory on it (bounded by its depth), so the match with the
    roots is an equi-join.
    """
    parts = F.split("path", "/", -1)
    at = F.filter(
        F.sequence(F.lit(2), F.size(parts) - 1),
        lambda i: F.get(parts, i - 1).isin(list(INVENTORY_DIRS)),
    )
    cut = unnest(files.where(F.size(parts) > 2), ["machine_id", parts.alias("parts")], at, "i")
    rows = cut.select(
        "machine_id",
        F.array_join(F.slice("parts", F.lit(1), F.col("i") - 1), "/").alias("dir"),
        F.get("parts", F.col("i") - 1).alias("sub"),
        F.get("parts", F.col("i")).alias("entry"),
    )
    entry = F.col("entry")
    is_skill = F.col("sub") == "skills"
    kind = F.lit(None).cast("string")
    for sub, word in INVENTORY_DIRS.items():
        kind = F.when(F.col("sub") == sub, word).otherwise(kind)
    return (
        roots.join(rows, ["machine_id", "dir"])
        .where((entry != "") & ~F.startswith(entry, F.lit(".")))
        .where(is_skill | F.endswith(entry, F.lit(".md")))
        .select(
            "machine_id",
            F.when(is_skill, entry).otherwise(F.regexp_replace(entry, r"\.md$", "")).alias("name"),
            kind.alias("kind"),
            "source",
        )
        .distinct()
    )


def skill_scopes(docs: DataFrame) -> DataFrame:
    """Scope of each skill in the Skills table of a context breakdown; built-in skills have none.

    A document is cut into its sections inside the row; only table rows of skill sections leave it.
    """
    parts = F.split(F.concat(F.lit("\n"), F.col("text")), r"\n(?=#{2,4}\s+[^\s])", -1)
    sections = unnest(docs, ["doc_id"], parts, "body", "section")
    title = F.regexp_extract("body", r"^#{2,4}\s+([^\n]*)", 1)
    skills = sections.where(F.lower(trim_blank(title)) == "skills")
    table_lines = F.filter(F.transform(F.split("body", "\n", -1), trim_blank), lambda x: F.startswith(x, F.lit("|")))

    def cells_of(line: Column) -> Column:
        inner = F.regexp_replace(F.regexp_replace(line, r"^\|", ""), r"\|$", "")
        return F.transform(F.split(inner, r"\|", -1), trim_blank)

    ruled = F.filter(F.transform(table_lines, cells_of), lambda cells: ~F.forall(cells, lambda c: c.rlike("^:?-+:?$")))
    # Rows and header are never null: else the optimizer puts tests for null in front, which parse all tables once more.
    tables = skills.select("doc_id", "section", F.coalesce(ruled, F.array().cast("array<array<string>>")).alias("rows"))
    header = F.coalesce(F.transform(F.get("rows", F.lit(0)), F.lower), F.array().cast("array<string>"))
    body = unnest(tables.withColumn("header", header), ["doc_id", "section", "header"], "rows", "cells", "at").where("at > 0")

    def cell(title: str) -> Column:
        return F.get("cells", F.array_position("header", title) - 1)

    source = F.lower(cell("source"))
    scope = F.lit(None).cast("string")
    for word in ["plugin", "project", "user"]:
        scope = F.when(F.startswith(source, F.lit(word)), word).otherwise(scope)
    place = F.struct("section", "at").alias("place")
    found = body.select("doc_id", place, cell("skill").alias("name"), scope.alias("scope")).where(
        "name <> '' AND scope IS NOT NULL"
    )
    return first_per_key(found, ["doc_id", "scope", "name"], F.col("place"))


def toml_mcp_names(docs: DataFrame) -> DataFrame:
    """Server names out of `[mcp_servers.<name>]` headers."""
    pattern = r'^\[mcp_servers\.(?:"([^"]+)"|([^\]."]+))\]\s*$'
    line = trim_blank(F.col("line"))
    name = F.concat(F.regexp_extract(line, pattern, 1), F.regexp_extract(line, pattern, 2))
    return _doc_lines(docs).select("doc_id", "line_no", name.alias("name")).where("name <> ''")


def json_mcp_names(docs: DataFrame) -> DataFrame:
    """Server names out of the keys of mcpServers in a settings file."""
    servers = F.get_json_object("text", "$.mcpServers")
    keys = F.when(is_json(F.col("text")) & F.startswith(servers, F.lit("{")), F.json_object_keys(servers))
    return unnest(docs, ["doc_id"], keys, "name", "line_no").select(
        "doc_id", F.col("line_no").cast("bigint").alias("line_no"), "name"
    )


def context_artifacts(
    tool: str, workspaces: DataFrame, files: DataFrame, mcp_names: DataFrame | None = None
) -> DataFrame:
    """Instruction files with their size and declared MCP servers, per workspace.

    `workspaces` has (machine_id, home, cwd), `files` (machine_id, path, content). A workspace
    with nothing to report has no row. Contents are measured, never kept.
    """
    name, in_home = ARTIFACT_FILES[tool]
    git = files.where(F.col("path").rlike(r"/\.git(/|$)")).select(
        "machine_id", F.regexp_replace("path", r"/\.git(/.*)?$", "").alias("root")
    )
    roots = nearest_ancestor(workspaces, "cwd", git, "root", ("machine_id",))
    ws = workspaces.join(roots, ["machine_id", "cwd"], "left").withColumn("root", F.coalesce("root", "cwd"))
    key = ["machine_id", "cwd"]
    sized = files.select("machine_id", "path", utf16_length(F.col("content")).alias("chars"))

    def measured(dir_: Column, rel: str, label: Column) -> DataFrame:
        want = ws.select(*key, F.concat(dir_, F.lit("/" + rel)).alias("path"), label.alias("name"))
        return want.join(sized, ["machine_id", "path"]).select(
            *key, F.lit("memory_files").alias("category"), "name", "chars"
        )

    parts = [
        measured(F.col("root"), name, F.lit(f"{name} ({tool} project)")),
        measured(
            F.when(F.col("cwd") != F.col("root"), F.col("cwd")), name, F.lit(f"{name} ({tool} cwd)")
        ),
    ]
    if in_home:
        parts.append(measured(F.col("home"), in_home, F.lit(f"~/{in_home}")))
    if tool == "cursor":
        parts.append(measured(F.col("root"), ".cursorrules", F.lit(".cursorrules")))
        rules = sized.where(F.col("path").rlike(r"/\.cursor/rules/[^/]+\.mdc?$")).select(
            "machine_id",
            F.regexp_replace("path", r"/\.cursor/rules/[^/]+$", "").alias("root"),
            F.regexp_extract("path", r"/(\.cursor/rules/[^/]+)$", 1).alias("name"),
            "chars",
        )
        parts.append(
            ws.select(*key, "root")
            .join(rules, ["machine_id", "root"])
            .select(*key, F.lit("memory_files").alias("category"), "name", "chars")
        )
    if mcp_names is not None:
        parts.append(
            ws.select(*key)
            .join(mcp_names.select("machine_id", "name"), "machine_id")
            .select(*key, F.lit("mcp_tools").alias("category"), "name", F.lit(None).cast("bigint").alias("chars"))
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def redact_snapshots(docs: DataFrame, context: RedactionContext) -> DataFrame:
    """The standard rules over snapshot text (or any text column called `text`)."""
    return redact_text(docs, "text", context.rules())


def snapshot_key(columns: list[str]) -> Column:
    """Fingerprint of a captured document without its capture time."""
    stable = [c for c in columns if c not in ("captured_at", "capturedAt")]
    return F.sha2(F.to_json(F.struct(*stable)), 256)


def changed_snapshots(snapshots: DataFrame) -> DataFrame:
    """Snapshots whose hash differs from the previous one of the same user, kind and project.

    Rows are cut into days, so a busy user is spread over one piece per day.
    """
    keys = ["user_id", "kind", "project"]
    # Snapshots of one time stand in the order of their hashes.
    ordered = snapshots.withColumn("_order", F.struct("captured_at", "content_hash"))
    before = carry_forward(
        ordered, keys, "_order", {"previous_hash": F.col("content_hash")},
        piece=F.to_date("captured_at"), include_current=False,
    ).drop("_order")
    return before.where(~F.col("content_hash").eqNullSafe(F.col("previous_hash")))
