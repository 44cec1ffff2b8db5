"""Git coordinates of sessions from collected .git files.

Tables: `dot_git(root, kind, content)` is one row per .git entry ('dir' or 'file', a file carries
its pointer text); `git_files(git_dir, rel_path, content)` holds config, HEAD, refs and packed-refs;
`dirs(dir)` lists the directories that exist.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmill.functions.paths import normalize
from sessionmill.functions.repo_urls import SHA_PATTERN, origin_url, remote_identity
from sessionmill.functions.text import lines, trim_blank
from sessionmill.operators.projects import nearest_ancestor


def repo_facts(git_files: DataFrame) -> DataFrame:
    """One row per git directory out of one pass: origin identity, branch and commit.

    The commit is the detached one, else the loose ref that HEAD names, else the packed one.
    """
    rel, content = F.col("rel_path"), F.col("content")

    def only(name: str) -> Column:
        return F.max(F.when(rel == name, content))

    texts = git_files.groupBy("git_dir").agg(
        only("config").alias("config"), only("HEAD").alias("head"), only("packed-refs").alias("packed")
    )
    head = trim_blank(F.col("head"))
    ref = F.trim(F.regexp_extract(head, r"^ref:\s*(.+)$", 1))
    detached = head.rlike(SHA_PATTERN)
    named = texts.withColumns(
        {"detached": F.when(detached, head), "ref": F.when(~detached & (ref != ""), ref), "url": origin_url(F.col("config"))}
    )
    # The first packed line of the ref, looked up inside the row.
    packed_lines = F.transform(lines(F.col("packed")), trim_blank)
    of_ref = F.filter(
        packed_lines, lambda x: x.rlike(r"^[0-9a-f]{40}\s") & (F.trim(F.substring(x, 41, 1 << 30)) == F.col("ref"))
    )
    packed_sha = F.substring(F.get(of_ref, F.lit(0)), 1, 40)
    loose = git_files.select("git_dir", rel.alias("ref"), trim_blank(content).alias("loose_sha")).where(
        F.col("loose_sha").rlike(SHA_PATTERN)
    )
    branch = F.regexp_extract("ref", "^refs/heads/(.+)$", 1)
    return named.join(loose, ["git_dir", "ref"], "left").select(
        "git_dir",
        F.col("config").isNotNull().alias("has_config"),
        F.col("head").isNotNull().alias("has_head"),
        F.col("url").isNotNull().alias("has_remote"),
        remote_identity(F.col("url")).alias("repository"),
        F.when(branch != "", branch).alias("head_branch"),
        F.coalesce("detached", "loose_sha", packed_sha).alias("commit_sha"),
    )


def repositories(git_files: DataFrame) -> DataFrame:
    """Origin identity per git directory."""
    return repo_facts(git_files).where("has_config").select("git_dir", "has_remote", "repository")


def head_commits(git_files: DataFrame) -> DataFrame:
    """Branch and commit of each git directory."""
    return repo_facts(git_files).where("has_head").select("git_dir", "head_branch", "commit_sha")


def git_dirs(dot_git: DataFrame, known: DataFrame) -> DataFrame:
    """Repository roots with their git directory; a pointer to nowhere gives null. `known`: git_dir."""
    pointer = F.trim(F.regexp_extract("content", r"(?m)^gitdir:\s*(.+)$", 1))
    target = F.when(pointer != "", F.when(F.startswith(pointer, F.lit("/")), pointer).otherwise(
        F.concat("root", F.lit("/"), pointer)
    ))
    is_dir = F.col("kind") == "dir"
    at = F.when(is_dir, F.concat("root", F.lit("/.git"))).otherwise(normalize(target))
    found = dot_git.select("root", is_dir.alias("_own"), at.alias("git_dir"))
    marked = known.select("git_dir").distinct().withColumn("_known", F.lit(True))
    return found.join(marked, "git_dir", "left").select(
        "root", F.when(F.col("_own") | F.col("_known"), F.col("git_dir")).alias("git_dir")
    )


def cwd_repositories(
    cwds: DataFrame, dirs: DataFrame, dot_git: DataFrame, git_files: DataFrame
) -> DataFrame:
    """Per distinct cwd: does it exist, its git directory, and what that says."""
    values = cwds.select("cwd").where("cwd <> ''").distinct()
    there = dirs.select(F.col("dir").alias("cwd")).distinct().withColumn("_there", F.lit(True))
    rooted = nearest_ancestor(values, "cwd", dot_git, "root")
    facts = repo_facts(git_files)
    return (
        rooted.join(there, "cwd", "left")
        .join(git_dirs(dot_git, facts), "root", "left")
        .join(facts, "git_dir", "left")
        .select(
            "cwd",
            F.coalesce("_there", F.lit(False)).alias("exists"),
            "root", "git_dir",
            F.coalesce("has_remote", F.lit(False)).alias("has_remote"),
            "repository", "head_branch", "commit_sha",
        )
    )


def repo_keys(cwd_repos: DataFrame) -> DataFrame:
    """cwd -> host/owner/name, null unless the cwd exists and its repository has a clean remote."""
    r = F.col("repository")
    return cwd_repos.select(
        "cwd",
        F.when(F.col("exists"), F.concat_ws("/", r["host"], r["owner"], r["name"])).alias("_key"),
        r.isNotNull().alias("_has"),
    ).select("cwd", F.when(F.col("_has"), F.col("_key")).alias("repo"))


def git_context(sessions: DataFrame, cwd_repos: DataFrame) -> DataFrame:
    """Git context per session, or the reason there is none.

    Sessions without a cwd skip the join, so they do not pile up on one null key.
    """
    has_cwd = F.coalesce("cwd", F.lit("")) != ""
    joined = sessions.where(has_cwd).join(cwd_repos, "cwd", "left")
    gone = ~F.coalesce(F.col("exists"), F.lit(False))
    reason = (
        F.when(gone, "missing-dir")
        .when(F.col("git_dir").isNull(), "not-a-repo")
        .when(~F.col("has_remote"), "no-remote")
        .when(F.col("repository").isNull(), "unparseable-remote")
        .when(F.col("commit_sha").isNull(), "no-commit")
    )
    recorded = F.when(F.col("recorded_branch") != "", F.col("recorded_branch"))
    resolved = joined.withColumn("reason", reason)
    ok = F.col("reason").isNull()
    columns = {
        "reason": F.col("reason"),
        "host": F.when(ok, F.col("repository.host")),
        "owner": F.when(ok, F.col("repository.owner")),
        "name": F.when(ok, F.col("repository.name")),
        "branch": F.when(ok, F.coalesce(recorded, F.col("head_branch"))),
        "commit_sha": F.when(ok, F.col("commit_sha")),
    }
    found = resolved.select(*sessions.columns, *[c.alias(n) for n, c in columns.items()])
    without = sessions.where(~has_cwd).select(
        *sessions.columns,
        F.lit("no-cwd").alias("reason"),
        *[F.lit(None).cast("string").alias(n) for n in columns if n != "reason"],
    )
    return found.unionByName(without)


def context_repositories(contexts: DataFrame) -> DataFrame:
    """Distinct owner/name of the batch."""
    return (
        contexts.where("reason IS NULL")
        .select(F.concat("owner", F.lit("/"), "name").alias("repository"))
        .distinct()
    )


def context_summary(contexts: DataFrame) -> DataFrame:
    """Counts per batch; `all_unresolved` is the case a warning is printed for."""
    ok = F.col("reason").isNull()
    return contexts.agg(
        F.count_if(ok).alias("sessions_with_context"),
        F.count_distinct(F.when(ok, F.concat("owner", F.lit("/"), "name"))).alias("repositories"),
        F.coalesce(F.bool_and(~ok), F.lit(False)).alias("all_unresolved"),
    )
