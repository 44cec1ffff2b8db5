"""Tables for git resolution out of collected files.

`files` has (path, content): whatever the collector took from the machines, among it the config,
HEAD, ref and packed-refs files below .git directories and .git pointer files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionmill.functions.paths import ancestors, parent_dir
from sessionmill.functions.rows import unnest


def dot_git_entries(files: DataFrame) -> DataFrame:
    """One row per .git entry: directories by the files below them, pointer files by themselves."""
    path = F.col("path")
    pointers = files.where(path.rlike(r"/\.git$")).select(
        F.regexp_replace(path, r"/\.git$", "").alias("root"), F.lit("file").alias("kind"), "content"
    )
    directories = (
        files.where(F.contains(path, F.lit("/.git/")))
        .select(F.regexp_extract(path, r"^(.*?)/\.git/", 1).alias("root"))
        .distinct()
        .select("root", F.lit("dir").alias("kind"), F.lit(None).cast("string").alias("content"))
    )
    return directories.unionByName(pointers)


def git_dir_files(files: DataFrame) -> DataFrame:
    """(git_dir, rel_path, content). A file below .git belongs to that directory and to every
    directory between, as pointers lead to .git/worktrees/<name> or .git/modules/<path>."""
    below = files.where(F.contains("path", F.lit("/.git/")))
    rows = unnest(below, ["path", "content"], ancestors(parent_dir(F.col("path"))), "git_dir")
    return rows.where(F.col("git_dir").rlike(r"/\.git(/|$)")).select(
        "git_dir",
        F.substring("path", F.length("git_dir") + 2, F.length("path")).alias("rel_path"),
        "content",
    )


def directories(files: DataFrame) -> DataFrame:
    """Every directory that holds a collected file, and those above it."""
    parents = files.select(parent_dir(F.col("path")).alias("parent")).distinct()
    return unnest(parents, [], ancestors(F.col("parent")), "dir").select("dir").distinct()
