"""Project labels of the Gemini CLI back to working directories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionmill.functions.json_text import string_or_null
from sessionmill.functions.paths import forward
from sessionmill.functions.rows import unnest_map

_TRANSCRIPT = r"^(.*/\.gemini)/tmp/([^/]+)/chats/"


def registry(files: DataFrame) -> DataFrame:
    """Candidates (root, label, cwd) out of projects.json texts; the text maps cwd to label."""
    projects = F.from_json("content", "projects map<string,variant>")["projects"]
    return (
        unnest_map(files, ["root"], projects, "cwd", "_label")
        .select("root", "cwd", string_or_null(F.col("_label")).alias("label"))
        .where("label IS NOT NULL AND cwd <> ''")
    )


def resolve_cwds(sessions: DataFrame, candidates: DataFrame) -> DataFrame:
    """cwd of transcripts; never a wrong one.

    With a project hash only the candidate whose sha256 equals it counts. Without one a label must
    have a single candidate. The candidates are aggregated per (root, label, hash) first, so the
    session side is joined once and stays as it is.
    """
    path = forward(F.col("path"))
    s = sessions.select("path", "project_hash").withColumns(
        {
            "root": F.regexp_extract(path, _TRANSCRIPT, 1),
            "label": F.regexp_extract(path, _TRANSCRIPT, 2),
        }
    ).where("root <> ''")
    hashed = candidates.withColumn("project_hash", F.sha2("cwd", 256))
    with_hash = s.where("project_hash IS NOT NULL").join(
        hashed, ["root", "label", "project_hash"]
    ).select("path", "cwd")
    single = candidates.groupBy("root", "label").agg(
        F.count("*").alias("_n"), F.min("cwd").alias("cwd")
    ).where("_n = 1")
    without = s.where("project_hash IS NULL").join(single, ["root", "label"]).select("path", "cwd")
    return with_hash.unionByName(without)
