"""Project and upload config files: strict shapes, defaults, and the selection they ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmill.functions.json_text import is_json

# Keys, kinds and defaults of a project config.
PROJECT_CONFIG = {
    "$schema": "string",
    "version": "one",
    "endpoint": "url",
    "org": "name",
    "upload": {
        "enabled": "boolean",
        "auto": "boolean",
        "minCost": "positive",
        "snapshot": "boolean",
        "concurrency": "count",
        "linkPrs": "boolean",
        "providers": "names",
    },
    "snapshot": {"enabled": "boolean"},
}
CONFIG_DEFAULTS = {
    "enabled": True, "auto": False, "min_cost": 10.0, "snapshot": True, "concurrency": 4,
    "link_prs": False, "snapshot_enabled": True,
}
# Keys and kinds of the older upload config.
UPLOAD_CONFIG = {
    "schemaVersion": "one",
    "providers": "names",
    "projects": {"include": "names", "exclude": "names"},
    "upload": {"enabled": "boolean", "auto": "boolean", "concurrency": "count", "linkPrs": "boolean", "org": "name"},
    "snapshot": {"enabled": "boolean"},
}
_URL = r"^(?:https?|wss?|ftp)://[^\s/?#]+\S*$|^(?!(?:https?|wss?|ftp):)[A-Za-z][A-Za-z0-9+.-]*:\S+$"


def _at(v: Column, path: str) -> Column:
    """The value at a path; a JSON null is a value, an absent one is SQL null."""
    return F.try_variant_get(v, path, "variant")


def _fits(v: Column, path: str, kind: str) -> Column:
    """Whether the value at a path is of a kind; null where it cannot be told."""
    found = F.schema_of_variant(_at(v, path))
    text = F.try_variant_get(v, path, "string")
    number = F.when(found.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(v, path, "double"))
    if kind == "boolean":
        return found == "BOOLEAN"
    if kind == "one":
        return number == 1
    if kind == "positive":
        return number > 0
    if kind == "count":
        return (number > 0) & (number == F.floor(number))
    if kind == "names":
        items = F.try_variant_get(v, path, "array<variant>")
        named = F.forall(items, lambda x: (F.schema_of_variant(x) == "STRING") & (F.try_variant_get(x, "$", "string") != ""))
        return found.startswith("ARRAY") & named
    shape = {"string": F.lit(True), "name": text != "", "url": text.rlike(_URL)}[kind]
    return (found == "STRING") & shape


def _key_error(text: Column, block: str, known: list[str]) -> Column:
    part = text if not block else F.get_json_object(text, f"$.{block}")
    extra = F.array_except(F.json_object_keys(part), F.array(*[F.lit(k) for k in known]))
    return F.when(F.size(extra) > 0, F.concat(F.lit(f"unknown key {block}."), F.get(extra, F.lit(0))))


def shape_error(text: Column, shape: dict) -> Column:
    """First reason why a JSON text does not have a shape, null where it has.

    Blocks are objects without other keys; whatever is there must be of its kind, and `one` must be there.
    """
    v = F.try_parse_json(text)
    checks = [
        F.when(~F.coalesce(is_json(text), F.lit(False)), F.lit("no JSON")),
        F.when(~F.schema_of_variant(v).like("OBJECT%"), F.lit("no object")),
        _key_error(text, "", list(shape)),
    ]
    blocks = {k: s for k, s in shape.items() if isinstance(s, dict)}
    for name, inner in blocks.items():
        block = _at(v, f"$.{name}")
        wrong = block.isNotNull() & ~F.schema_of_variant(block).like("OBJECT%")
        checks += [F.when(wrong, F.lit(f"$.{name}")), _key_error(text, name, list(inner))]
    flat = [("", k, s) for k, s in shape.items() if k not in blocks]
    flat += [(f"{b}.", k, s) for b, inner in blocks.items() for k, s in inner.items()]
    for block, key, kind in flat:
        path = f"$['{key}']" if key.startswith("$") else f"$.{block}{key}"
        wrong = ~F.coalesce(_fits(v, path, kind), F.lit(False))
        if kind == "one":
            checks.append(F.when(wrong, F.lit(key)))
        else:
            checks.append(F.when(_at(v, path).isNotNull() & wrong, F.lit(f"$.{block}{key}")))
    return F.coalesce(*checks)


def config_errors(text: Column) -> Column:
    """Why a project config is refused, null for a good one. A bad config stops its upload."""
    return shape_error(text, PROJECT_CONFIG)


def _settings(files: DataFrame, error: Column, values: dict[str, Column]) -> DataFrame:
    typed = files.select("dir", error.alias("error"), *[c.alias(n) for n, c in values.items()])
    return typed.select("dir", "error", *[F.when(F.col("error").isNull(), F.col(n)).alias(n) for n in values])


def project_configs(files: DataFrame) -> DataFrame:
    """Typed settings per config file, defaults filled in, with the error of refused files."""
    v = F.try_parse_json("content")

    def setting(path: str, kind: str, default) -> Column:
        return F.coalesce(F.try_variant_get(v, path, kind), F.lit(default))

    d = CONFIG_DEFAULTS
    return _settings(
        files,
        config_errors(F.col("content")),
        {
            "endpoint": F.try_variant_get(v, "$.endpoint", "string"),
            "org": F.try_variant_get(v, "$.org", "string"),
            "enabled": setting("$.upload.enabled", "boolean", d["enabled"]),
            "auto": setting("$.upload.auto", "boolean", d["auto"]),
            "min_cost": setting("$.upload.minCost", "double", d["min_cost"]),
            "snapshot": setting("$.upload.snapshot", "boolean", d["snapshot"]),
            "concurrency": setting("$.upload.concurrency", "bigint", d["concurrency"]),
            "link_prs": setting("$.upload.linkPrs", "boolean", d["link_prs"]),
            "providers": F.try_variant_get(v, "$.upload.providers", "array<string>"),
            "snapshot_enabled": setting("$.snapshot.enabled", "boolean", d["snapshot_enabled"]),
        },
    )


def upload_configs(files: DataFrame) -> DataFrame:
    """Typed settings per upload config of the older form; what a file leaves out is null (no limit)."""
    v = F.try_parse_json("content")
    paths = {
        "providers": ("$.providers", "array<string>"),
        "include": ("$.projects.include", "array<string>"),
        "exclude": ("$.projects.exclude", "array<string>"),
        "enabled": ("$.upload.enabled", "boolean"),
        "auto": ("$.upload.auto", "boolean"),
        "concurrency": ("$.upload.concurrency", "bigint"),
        "link_prs": ("$.upload.linkPrs", "boolean"),
        "org": ("$.upload.org", "string"),
        "snapshot_enabled": ("$.snapshot.enabled", "boolean"),
    }
    return _settings(
        files,
        shape_error(F.col("content"), UPLOAD_CONFIG),
        {name: F.try_variant_get(v, path, kind) for name, (path, kind) in paths.items()},
    )


def nearest_configs(cwds: DataFrame, projects: DataFrame, uploads: DataFrame) -> DataFrame:
    """Per cwd the config that governs it: config_dir and form.

    The nearest directory upwards with a project config wins and is the scope; only where there is
    none the nearest upload config counts. `projects` and `uploads` are the files' directories (dir).
    """
    from sessionmill.operators.projects import nearest_ancestor

    def nearest(files: DataFrame, name: str) -> DataFrame:
        dirs = files.select(F.col("dir").alias("root")).distinct()
        return nearest_ancestor(cwds.select("cwd").distinct(), "cwd", dirs, "root").select("cwd", F.col("root").alias(name))

    found = nearest(projects, "_project").join(nearest(uploads, "_upload"), "cwd")
    return found.select(
        "cwd",
        F.coalesce("_project", "_upload").alias("config_dir"),
        F.when(F.col("_project").isNotNull(), "project").when(F.col("_upload").isNotNull(), "upload").alias("form"),
    )
