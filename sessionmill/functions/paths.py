"""Expressions over session paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers found in session paths.
WORKTREE_MARKER = "--claude-worktrees-"
COMPOSER_MARKER = "::composer::"
TRANSCRIPT_MARKER = "/agent-transcripts/"


def forward(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_dir(path: Column) -> Column:
    """Directory of a path, '/' for a top-level entry."""
    cut = F.regexp_replace(path, "/[^/]*$", "")
    return F.when(cut == "", F.lit("/")).otherwise(cut)


def parent_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)/[^/]*$", 1)


def segment_after(path: Column, marker: str) -> Column:
    """First path segment behind the last occurrence of `marker`; null when there is none."""
    p = forward(path)
    segment = F.split_part(F.substring_index(p, marker, -1), F.lit("/"), F.lit(1))
    return F.when(F.contains(p, F.lit(marker)) & (segment != ""), segment)


def encode_dir(path: Column) -> Column:
    return F.regexp_replace(path, "[/.]", "-")


def decode_dir(name: Column) -> Column:
    return F.replace(name, F.lit("-"), F.lit("/"))


def worktree_path(path: Column) -> Column:
    """Sub-path of a worktree copy, null for a main checkout."""
    name = parent_name(path)
    at = F.instr(name, WORKTREE_MARKER)
    tail = F.substring(name, at + F.lit(len(WORKTREE_MARKER)), F.length(name))
    return F.when(at > 0, decode_dir(tail))


def worktree_root(name: Column) -> Column:
    """Encoded project name with any worktree part removed."""
    at = F.instr(name, WORKTREE_MARKER)
    return F.when(at > 0, F.substring(name, F.lit(1), at - 1)).otherwise(name)


def is_composer(path: Column) -> Column:
    return F.contains(path, F.lit(COMPOSER_MARKER))


def physical_path(path: Column) -> Column:
    at = F.instr(path, COMPOSER_MARKER)
    return F.when(at > 0, F.substring(path, F.lit(1), at - 1)).otherwise(path)


def composer_id(path: Column) -> Column:
    at = F.instr(path, COMPOSER_MARKER)
    return F.when(
        at > 0, F.substring(path, at + F.lit(len(COMPOSER_MARKER)), F.length(path))
    )


def is_transcript(path: Column) -> Column:
    return F.contains(forward(path), F.lit(TRANSCRIPT_MARKER))


def transcript_cwd(path: Column) -> Column:
    """Working directory encoded in a terminal transcript's path (lossy: '-' may be a real dash)."""
    name = F.regexp_extract(forward(path), r"\.cursor/projects/([^/]+)/agent-transcripts/", 1)
    return F.when(name != "", F.concat(F.lit("/"), decode_dir(name)))


def normalize(path: Column) -> Column:
    """Resolve '.', '..' and doubled slashes of an absolute path."""
    def step(acc: Column, seg: Column) -> Column:
        up = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return (
            F.when(seg.isin("", "."), acc)
            .when(seg == "..", up)
            .otherwise(F.array_append(acc, seg))
        )

    parts = F.aggregate(F.split(path, "/", -1), F.lit([]).cast("array<string>"), step)
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def ancestors(path: Column) -> Column:
    """The directory itself and every directory above it, '/' last. Bounded by the path depth."""
    parts = F.filter(F.split(path, "/", -1), lambda s: s != "")
    depth = F.size(parts)
    return F.transform(
        F.sequence(depth, F.lit(0), F.lit(-1)),
        lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/")),
    )


def glob_regex(pattern: str) -> str:
    """Anchored regex of a path glob: '*' and '?' stay in a segment, '**' crosses segments."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        if pattern.startswith("**/", i):
            out.append("(?:[^/]+/)*" if i else "(?:.*/)?")  # at the start also below the root
            i += 3
        elif pattern.startswith("**", i):
            out.append(".*")
            i += 2
        elif ch == "*":
            out.append("[^/]*")
            i += 1
        elif ch == "?":
            out.append("[^/]")
            i += 1
        elif ch == "{" and "}" in pattern[i:]:
            end = pattern.index("}", i)
            options = [glob_regex(o)[1:-1] for o in pattern[i + 1 : end].split(",")]
            out.append("(?:" + "|".join(options) + ")")
            i = end + 1
        else:
            out.append("\\" + ch if ch in ".^$+()[]{}|\\" else ch)
            i += 1
    return "^" + "".join(out) + "$"
