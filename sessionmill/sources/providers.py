"""The supported tools as data. Operators read these specs instead of branching by hand."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionmill.functions import paths as P


@dataclass(frozen=True)
class ProviderSpec:
    provider_id: str
    source_kind: str
    display_name: str
    format_version: str
    globs: tuple[str, ...]
    # Project key and label of a session path.
    project_id: Column
    project_name: Column
    # Native id and working directory out of the columns of `session_facts`.
    native_id: Column
    cwd: Column
    branch: Column
    # False where copies may share a native id.
    reuse_native: Column


def provider_specs() -> list[ProviderSpec]:
    """Built on call, as Column objects need a running session."""
    path = F.col("path")
    none = F.lit(None).cast("string")
    yes = F.lit(True)
    claude_key = P.worktree_root(P.parent_name(path))
    after_projects = F.regexp_extract(P.forward(path), "(?:^|/)projects/([^/]+)", 1)
    grandparent = F.regexp_extract(P.forward(path), "([^/]*)/[^/]*/[^/]*$", 1)
    cursor_key = (
        F.when(P.is_composer(path), F.lit("cursor"))
        .when(after_projects != "", after_projects)
        .otherwise(grandparent)
    )
    return [
        ProviderSpec(
            "claude", "claude-code", "Claude Code", "claude-jsonl-2026-04",
            (".claude/projects/*/*.jsonl",),
            claude_key, P.decode_dir(claude_key),
            F.col("first_native_id"), F.col("any_cwd"), F.col("any_branch"),
            P.worktree_path(path).isNull(),
        ),
        ProviderSpec(
            "codex", "codex", "Codex (beta)", "codex-jsonl-2026-05",
            (".codex/sessions/**/*.jsonl",),
            F.lit("codex"), F.lit("Codex sessions"),
            F.col("first_meta_id"), F.col("first_meta_cwd"), F.col("first_meta_branch"), yes,
        ),
        ProviderSpec(
            "cursor", "cursor", "Cursor (beta)", "cursor-jsonl-2026-05",
            (".cursor/projects/**/agent-transcripts/**/*.jsonl",),
            cursor_key, cursor_key,
            F.when(P.is_transcript(path), P.segment_after(path, P.TRANSCRIPT_MARKER)).otherwise(
                P.composer_id(path)
            ),
            F.when(P.is_transcript(path), P.transcript_cwd(path)), none, yes,
        ),
        ProviderSpec(
            "gemini", "gemini", "Gemini (beta)", "gemini-jsonl-2026-06",
            (".gemini/tmp/*/chats/*.jsonl",),
            F.lit("gemini"), F.lit("Gemini sessions"),
            F.col("first_native_id"), F.col("registry_cwd"), none, yes,
        ),
    ]


def by_source_kind(pick) -> Column:
    """CASE over source_kind with one branch per provider."""
    case = None
    for spec in provider_specs():
        hit = F.col("source_kind") == spec.source_kind
        case = F.when(hit, pick(spec)) if case is None else case.when(hit, pick(spec))
    return case


def provider_table(spark: SparkSession) -> DataFrame:
    """Four rows, so any join with it is a broadcast join of known size."""
    rows = [
        (i, s.provider_id, s.source_kind, s.display_name, s.format_version)
        for i, s in enumerate(provider_specs())
    ]
    return spark.createDataFrame(
        rows,
        "provider_order int, provider_id string, source_kind string, display_name string, "
        "format_version string",
    )


def detect_providers(files: DataFrame) -> DataFrame:
    """Which tools left data on which machine."""
    seen = files.groupBy("machine_id", "source_kind").agg(F.count("*").alias("n_files"))
    return seen.join(F.broadcast(provider_table(files.sparkSession)), "source_kind")
