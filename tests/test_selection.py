"""Globs that are data, held against the globs of a single config."""

import re

import pytest
from pyspark.sql import functions as F

from sessionmill.functions.paths import glob_regex
from sessionmill.operators import selection as S

GLOBS = [
    "~", "~/p*", "~/p?/x", "/opt/**", "/opt/**/x", "**/x", "*", "/*", "/a.b/{c,d.e}/f+", "/a/{b", "rel/*", "/a//b/*", "/(x)|[y]", "/{a,b*}/**", "", "/a/b/", "**", "/a\\b", "/e/{}",
]
PATHS = [
    "~", "~/p1", "~/p1/x", "~/p12/x", "/opt", "/opt/a", "/opt/a/x", "/opt/x", "/x", "x", "/a.b/c/f+", "/a.b/d.e/f+", "/axb/c/f", "/a/{b", "rel/q", "/a//b/c", "/a/b/c", "/(x)|[y]",
    "/a/z", "/bcd/z/y", "", "/", "/a\\b", "/a/b/", "/é", "/e/",
]


def expand(x):
    return "/home/u" + x[1:] if x == "~" or x.startswith("~/") else x


def test_regexes_of_globs_in_a_column(spark):
    df = spark.createDataFrame([(g,) for g in GLOBS], "g string").select("g", S.glob_column_regex(F.col("g")).alias("r"))
    for row in df.collect():
        for path in PATHS:
            assert bool(re.search(row.r, path)) == bool(re.search(glob_regex(row.g), path)), (row, path)


@pytest.mark.parametrize("step", [1, 3])
def test_each_project_by_its_config(spark, step):
    rows = [(f"/c{k}", GLOBS[k : k + step], GLOBS[(k + 5) % len(GLOBS) :][:1] if k % 2 else None, ["claude"] if k % 3 else None, None) for k in range(len(GLOBS))]
    rows += [("/all", None, None, None, None), ("/empty", [], [], [], None), ("/bad", ["**"], None, None, "broken")]
    configs = spark.createDataFrame(rows, "dir string, include array<string>, exclude array<string>, providers array<string>, error string")
    configs = configs.withColumn("home", F.lit("/home/u"))
    groups = [(d, p, path) for d in [*[r[0] for r in rows], "/none", None] for p in ("claude", "codex") for path in PATHS]
    frame = spark.createDataFrame(groups, "config_dir string, provider_id string, project_name string")
    want = set()
    for d, include, exclude, providers, error in rows:
        for p in ("claude", "codex"):
            for path in PATHS:
                hit = lambda globs: any(re.search(glob_regex(expand(g)), expand(path)) for g in globs)  # noqa: B023, E731
                if error is None and (providers is None or p in providers) and (not include or hit(include)) and not hit(exclude or []):
                    want.add((d, p, path))
    got = [tuple(r) for r in S.governed_selection(frame, configs).collect()]
    assert sorted(got) == sorted(want)
