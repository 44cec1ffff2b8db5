"""Which sessions a run uploads, and why none when it uploads none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmill.functions.paths import ancestors, encode_dir, glob_regex
from sessionmill.functions.pricing import EXCLUDE_FLOOR_USD, MIN_FULL_UPLOAD_USD, tier

GROUP = ["provider_id", "project_id"]


def select_sessions(sessions: DataFrame, providers: list[str], projects: DataFrame) -> DataFrame:
    """Sessions whose provider and project are both chosen. There are four providers at most, so
    they are a parameter; projects may be any number."""
    return sessions.where(F.col("provider_id").isin(providers)).join(
        projects.select("project_id"), "project_id", "left_semi"
    )


def supported_providers(detected: DataFrame, configured: DataFrame | None = None) -> list[str]:
    """Detected providers, narrowed to the configured ones if a config names any."""
    ids = detected.select("provider_id")
    ids = ids.distinct() if configured is None else ids.intersect(configured.select("provider_id"))
    return sorted(r.provider_id for r in ids.collect())


def expand_home(pattern: str, home: str) -> str:
    return home + pattern[1:] if pattern == "~" or pattern.startswith("~/") else pattern


def glob_match(
    path: Column, include: list[str] | None, exclude: list[str] | None, home: str
) -> Column:
    """True where a path is included (or no include is given) and not excluded."""

    def any_of(globs: list[str]) -> Column:
        return path.rlike("|".join(f"(?:{glob_regex(expand_home(g, home))})" for g in globs))

    ok = any_of(include) if include else F.lit(True)
    return ok & ~any_of(exclude) if exclude else ok


def config_selection(
    groups: DataFrame,
    providers: list[str],
    home: str,
    include: list[str] | None = None,
    exclude: list[str] | None = None,
) -> DataFrame:
    name = F.col("project_name")
    tilde = (name == "~") | F.startswith(name, F.lit("~/"))
    path = F.when(tilde, F.concat(F.lit(home), F.substring(name, 2, 1 << 30))).otherwise(name)
    return groups.where(
        F.col("provider_id").isin(providers) & glob_match(path, include, exclude, home)
    )


def in_scope(scope_dir: Column) -> Column:
    """Does a project group lie in or under the directory that holds the project config?"""
    code = encode_dir(scope_dir)
    by_code = (F.col("project_id") == code) | F.startswith("project_id", F.concat(code, F.lit("-")))
    by_name = (F.col("project_name") == scope_dir) | F.startswith(
        "project_name", F.concat(scope_dir, F.lit("/"))
    )
    return F.when(F.col("provider_id") == "claude", by_code).otherwise(by_name)


def tier_split(candidates: DataFrame, min_usd: float = MIN_FULL_UPLOAD_USD) -> DataFrame:
    """Counts over all candidates, before any limit."""
    return (
        candidates.where("kind <> 'unchanged'")
        .groupBy(tier(F.col("total_cost_usd"), min_usd).alias("tier"))
        .agg(F.count("*").alias("sessions"))
    )


def eligible(candidates: DataFrame, floor_usd: float = EXCLUDE_FLOOR_USD) -> DataFrame:
    """New and updated sessions with an answer and at least the floor price."""
    return candidates.where(
        (F.col("kind") != "unchanged") & F.col("has_answer") & (F.col("total_cost_usd") >= floor_usd)
    )


def selection_report(groups: DataFrame, providers: list[str], projects: DataFrame) -> DataFrame:
    """Every project with its counts and two flags: provider chosen, project chosen."""
    chosen = projects.select("project_id").distinct().withColumn("_j", F.lit(True))
    return groups.join(chosen, "project_id", "left").select(
        *groups.columns,
        F.col("provider_id").isin(providers).alias("provider_selected"),
        F.coalesce("_j", F.lit(False)).alias("project_selected"),
    )


def explain_empty(
    candidates: DataFrame, scoped: bool = False, floor_usd: float = EXCLUDE_FLOOR_USD
) -> DataFrame:
    """One row: why nothing was selected, with the counts behind it."""
    unchanged = F.col("kind") == "unchanged"
    dropped = ~unchanged & ~(
        F.coalesce("has_answer", F.lit(False)) & (F.col("total_cost_usd") >= floor_usd)
    )
    n = candidates.agg(
        F.count("*").alias("sessions_discovered"),
        F.count_distinct("provider_id", "project_id").alias("projects_discovered"),
        F.count_if(unchanged).alias("already_uploaded"),
        F.count_if(dropped).alias("trivial_or_empty"),
    )
    left = F.col("sessions_discovered") - F.col("already_uploaded") - F.col("trivial_or_empty")
    reason = (
        F.when(F.col("sessions_discovered") == 0, "no_sessions_discovered")
        .when(F.lit(scoped), "outside_project_scope")
        .otherwise("nothing_left_after_filters")
    )
    return n.select(
        reason.alias("reason"), *n.columns, F.greatest(F.lit(0), left).alias("unselected")
    )


_PIECES = r"(\{[^}]*\}|\*\*/|\*\*|\*|\?|[^*?{]+|\{)"
_SIMPLE = r"(\*\*/|\*\*|\*|\?|[^*?]+)"


def _simple_regex(glob: Column) -> Column:
    """Regex of a glob without braces."""
    literal = lambda x: F.regexp_replace(x, r"([.^$+()\[\]{}|\\])", r"\\$1")
    pieces = F.regexp_extract_all(glob, F.lit(_SIMPLE), F.lit(1))
    return F.array_join(
        F.transform(
            pieces,
            lambda x, i: F.when(x == "**/", F.when(i == 0, "(?:.*/)?").otherwise("(?:[^/]+/)*")).when(x == "**", ".*").when(x == "*", "[^/]*").when(x == "?", "[^/]").otherwise(literal(x)),
        ),
        "",
    )


def glob_column_regex(glob: Column) -> Column:
    """`glob_regex` for globs that are data."""
    pieces = F.regexp_extract_all(glob, F.lit(_PIECES), F.lit(1))

    def piece(x: Column, i: Column) -> Column:
        options = F.transform(F.split(F.substring(x, F.lit(2), F.length(x) - 2), ",", -1), _simple_regex)
        return F.when((x == "**/") & (i > 0), "(?:[^/]+/)*").when(x.rlike(r"^\{[^}]*\}$"), F.concat(F.lit("(?:"), F.array_join(options, "|"), F.lit(")"))).otherwise(_simple_regex(x))

    return F.concat(F.lit("^"), F.array_join(F.transform(pieces, piece), ""), F.lit("$"))


def expand_home_column(pattern: Column, home: Column) -> Column:
    tilde = (pattern == "~") | F.startswith(pattern, F.lit("~/"))
    return F.when(tilde, F.concat(home, F.substring(pattern, 2, 1 << 30))).otherwise(pattern)


def compiled_globs(configs: DataFrame) -> DataFrame:
    """The globs of good configs (dir, include, exclude, error, home) as rows: config_dir, is_include, anchor, regex.

    The anchor is the directory that everything a glob matches lies below: the part before its first wildcard.
    """
    rules = configs.where("error IS NULL").select(
        F.col("dir").alias("config_dir"), "home",
        F.explode(
            F.concat(
                F.transform(F.coalesce("include", F.array().cast("array<string>")), lambda g: F.struct(F.lit(True).alias("is_include"), g.alias("glob"))),
                F.transform(F.coalesce("exclude", F.array().cast("array<string>")), lambda g: F.struct(F.lit(False).alias("is_include"), g.alias("glob"))),
            )
        ).alias("_g"),
    )
    named = rules.select("config_dir", "_g.is_include", expand_home_column(F.col("_g.glob"), F.col("home")).alias("glob"))
    fixed = F.regexp_extract("glob", r"^([^*?{]*)/", 1)
    anchor = F.concat(F.lit("/"), F.array_join(F.filter(F.split(fixed, "/", -1), lambda s: s != ""), "/"))
    return named.select("config_dir", "is_include", anchor.alias("anchor"), glob_column_regex(F.col("glob")).alias("regex")).distinct()


def governed_selection(groups: DataFrame, configs: DataFrame) -> DataFrame:
    """The groups that the config governing each of them lets through; exclude wins, no include means all.

    `groups` has config_dir (see `nearest_configs`), provider_id and project_name; `configs` is what
    `upload_configs` gives, with the home of its machine. Groups of refused configs, or of none, are left
    out. A project meets only the globs of its config whose anchor is one of its directories: an equi-join, so many
    projects, configs and globs are no product; what the anchor leaves open is decided by the glob's regex.
    """
    good = configs.where("error IS NULL").select(
        F.col("dir").alias("config_dir"), "home", F.col("providers").alias("_providers"),
        (F.coalesce(F.size("include"), F.lit(0)) > 0).alias("_includes"),
    )
    allowed = F.col("_providers").isNull() | F.array_contains("_providers", F.col("provider_id"))
    ruled = groups.join(good, "config_dir").where(F.coalesce(allowed, F.lit(False)))
    ruled = ruled.withColumn("_path", expand_home_column(F.col("project_name"), F.col("home")))
    paths = ruled.select("config_dir", "_path").distinct()
    placed = paths.withColumn("anchor", F.explode(F.array_union(ancestors(F.col("_path")), F.array(F.lit("/")))))
    hits = placed.join(compiled_globs(configs), ["config_dir", "anchor"]).where("_path rlike regex").groupBy("config_dir", "_path").agg(
        F.bool_or("is_include").alias("_in"), F.bool_or(~F.col("is_include")).alias("_out")
    )
    joined = ruled.join(hits, ["config_dir", "_path"], "left")
    taken = (F.coalesce("_in", F.lit(False)) | ~F.col("_includes")) & ~F.coalesce("_out", F.lit(False))
    return joined.where(taken).select(*groups.columns)
