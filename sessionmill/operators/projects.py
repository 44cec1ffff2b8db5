"""Sessions grouped by project and by git repository.

Groups stay long (one row per session) and are only counted; no session list is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionmill.functions.paths import ancestors, encode_dir
from sessionmill.functions.rows import unnest
from sessionmill.sources.providers import by_source_kind

REPO_PREFIX = "repo:"
GROUP = ["provider_id", "project_id"]


def with_project(sessions: DataFrame) -> DataFrame:
    return sessions.withColumns(
        {
            "provider_id": by_source_kind(lambda s: F.lit(s.provider_id)),
            "project_id": by_source_kind(lambda s: s.project_id),
            "project_name": by_source_kind(lambda s: s.project_name),
        }
    )


def project_groups(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy(*GROUP).agg(
        F.min("project_name").alias("project_name"), F.count("*").alias("session_count")
    )


def nearest_ancestor(
    dirs: DataFrame, column: str, roots: DataFrame, out: str, keys: tuple[str, ...] = ()
) -> DataFrame:
    """Distinct values of `column` with the longest enclosing `root` (null without one).

    Ancestors are spelled out, bounded by the path depth, so the search is an equi-join.
    """
    values = dirs.select(*keys, column).where(F.col(column).isNotNull()).distinct()
    steps = unnest(values, [*keys, column], ancestors(F.col(column)), "root").drop("_pos")
    hits = (
        steps.join(roots.select(*keys, "root").distinct(), [*keys, "root"])
        .groupBy(*keys, column)
        .agg(F.max_by("root", F.length("root")).alias(out))
    )
    return values.join(hits, [*keys, column], "left")


def candidate_cwds(sessions: DataFrame) -> DataFrame:
    """Distinct recorded cwds of each group in path order, then the decoded group path."""
    recorded = (
        sessions.where("session_cwd <> ''")
        .groupBy(*GROUP, F.col("session_cwd").alias("cwd"))
        .agg(F.struct(F.lit(0).alias("rank"), F.min("path").alias("path")).alias("pos"))
    )
    decoded = (
        sessions.where(F.startswith("project_name", F.lit("/")))
        .groupBy(*GROUP, F.col("project_name").alias("cwd"))
        .agg(F.struct(F.lit(1).alias("rank"), F.min("path").alias("path")).alias("pos"))
    )
    return (
        recorded.unionByName(decoded).groupBy(*GROUP, "cwd").agg(F.min("pos").alias("pos"))
    )


def repo_of_group(candidates: DataFrame, cwd_repos: DataFrame) -> DataFrame:
    """The first candidate that lies in a repository decides for its group."""
    known = cwd_repos.where("repo IS NOT NULL").select("cwd", "repo")
    return candidates.join(known, "cwd").groupBy(*GROUP).agg(F.min_by("repo", "pos").alias("repo"))


def _by_repo(rows: DataFrame, group_repos: DataFrame) -> DataFrame:
    """Rows of project groups with the key and label of their repository, or of their path without one."""
    return rows.join(group_repos, GROUP, "left").withColumns(
        {
            "group_key": F.coalesce(F.concat(F.lit(REPO_PREFIX), "repo"), F.col("project_id")),
            "label": F.coalesce(F.regexp_extract("repo", "^[^/]*/(.*)$", 1), F.col("project_name")),
        }
    )


def repository_sessions(sessions: DataFrame, group_repos: DataFrame) -> DataFrame:
    """Every session with its group_key and label, for selection and for summary rows by repository."""
    return _by_repo(sessions, group_repos).drop("repo")


def group_by_repo(groups: DataFrame, group_repos: DataFrame) -> DataFrame:
    """Merge groups of one repository; groups without a repository keep their path key. Label and provider are
    those of one group, the first by provider."""
    return _by_repo(groups, group_repos).groupBy("group_key").agg(
        F.min(F.struct("provider_id", "label")).alias("_first"),
        F.sum("session_count").alias("session_count"),
        F.count("*").alias("merged_groups"),
    ).select("group_key", "_first.label", "_first.provider_id", "session_count", "merged_groups")


def biggest_first(groups: DataFrame, count: str = "session_count", name: str = "label") -> DataFrame:
    return groups.orderBy(F.col(count).desc(), F.col(name).asc())


def share_of_max(groups: DataFrame, count: str, width: int = 20) -> DataFrame:
    """Bar length per group. The maximum is a scalar subquery, not a window over all rows."""
    top = groups.agg(F.greatest(F.max(count), F.lit(1)).alias("m")).scalar()
    return groups.withColumn("bar", F.round(F.col(count) / top * width).cast("bigint"))


def real_dirs(encoded: DataFrame, inventory: DataFrame) -> DataFrame:
    """Encoded project ids back to directories that exist, by an equi-join on the encoding.

    Several directories may share an encoding; the one with the longest leading segments wins.
    """
    ids = encoded.select("project_id").distinct()
    dirs = inventory.select("dir", encode_dir(F.col("dir")).alias("project_id"))
    lengths = F.transform(F.split("dir", "/", -1), lambda s: F.length(s))
    best = (
        dirs.join(ids, "project_id", "left_semi")
        .groupBy("project_id")
        .agg(F.max_by("dir", F.struct(lengths, F.col("dir"))).alias("dir"))
    )
    return ids.join(best, "project_id", "left")


def eligible_counts(groups: DataFrame, sessions: DataFrame, eligible: DataFrame) -> DataFrame:
    """Sessions left to upload per project, 0 included."""
    left = sessions.join(eligible.select("path"), "path", "left_semi")
    n = left.groupBy(*GROUP).agg(F.count("*").alias("_n"))
    return groups.join(n, GROUP, "left").select(
        *groups.columns, F.coalesce("_n", F.lit(0)).alias("eligible")
    )


def project_rows(will_upload: DataFrame, key: str = "project_id") -> DataFrame:
    """Rows of the upload summary, by project or, with `group_key`, by repository.

    A path label gives way to the recorded cwd of the first session.
    """
    name = "label" if key == "group_key" else "project_name"
    label = F.when(
        F.startswith(name, F.lit("/")) & (F.coalesce("session_cwd", F.lit("")) != ""), F.col("session_cwd")
    ).otherwise(F.col(name))
    first = F.struct(-F.col("mtime_ms"), F.col("path"))
    return will_upload.groupBy(key).agg(
        F.min_by("provider_id", first).alias("provider_id"),
        F.min_by(label, first).alias("display_name"),
        F.count("*").alias("will_upload"),
    )
