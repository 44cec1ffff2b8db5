"""Key/value stores and terminal transcripts of the Cursor editor, as one export shape.

The export is kept long, one row per bubble, because a composer may hold any number of bubbles.
`export_records` makes records of it that a run reads like any other session: a line for the composer, then
one per bubble.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmill.functions.json_text import is_json, string_or_null
from sessionmill.functions.paths import COMPOSER_MARKER
from sessionmill.functions.rows import unnest
from sessionmill.functions.text import utf16_length
from sessionmill.operators.ordering import running_sum

_COMPOSER = """
  name VARIANT, workspaceName VARIANT, createdAt VARIANT, lastUpdatedAt VARIANT,
  modelConfig STRUCT<modelName: VARIANT>, fullConversationHeadersOnly ARRAY<VARIANT>
"""
_BUBBLE = """
  type VARIANT, text VARIANT, tokenCount STRUCT<inputTokens: DOUBLE, outputTokens: DOUBLE>,
  modelInfo STRUCT<modelName: VARIANT>,
  toolFormerData STRUCT<name: VARIANT, status: VARIANT, result: VARIANT>
"""


def _number(v: Column, path: str = "$") -> Column:
    """Value of a VARIANT number; a quoted number is no number."""
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.when(
        ~kind.isin("STRING", "VOID", "BOOLEAN") & ~kind.rlike("^(ARRAY|OBJECT)"),
        F.try_variant_get(v, path, "double"),
    )


def _text_at(v: Column, path: str) -> Column:
    return string_or_null(F.try_variant_get(v, path, "variant"))


def composers(kv: DataFrame) -> DataFrame:
    """Composer rows of a store; values that are no JSON object are dropped."""
    prefix = "composerData:"
    value = F.col("value").cast("string")
    rows = (
        kv.where(F.startswith("key", F.lit(prefix)) & (F.length("key") > len(prefix)))
        .where(is_json(value) & F.startswith(F.ltrim(value), F.lit("{")))
        .select(
            "store_path",
            F.substring("key", len(prefix) + 1, 1 << 30).alias("composer_id"),
            F.from_json(value, _COMPOSER).alias("c"),
        )
    )
    return rows.select(
        "store_path", "composer_id",
        string_or_null(F.col("c.name")).alias("name"),
        string_or_null(F.col("c.workspaceName")).alias("workspace_name"),
        _number(F.col("c.createdAt")).alias("created_at"),
        _number(F.col("c.lastUpdatedAt")).alias("last_updated_at"),
        string_or_null(F.col("c.modelConfig.modelName")).alias("model_name"),
        F.col("c.fullConversationHeadersOnly").alias("headers"),
    )


def headers(composer_rows: DataFrame) -> DataFrame:
    """Conversation order of the bubbles; entries without id and numeric type are dropped."""
    h = F.col("h")
    return (
        unnest(composer_rows, ["store_path", "composer_id"], "headers", "h", "pos")
        .select(
            "store_path", "composer_id", "pos",
            _text_at(h, "$.bubbleId").alias("bubble_id"),
            _number(h, "$.type").cast("int").alias("header_type"),
        )
        .where("bubble_id IS NOT NULL AND header_type IS NOT NULL")
    )


def bubbles(kv: DataFrame) -> DataFrame:
    """Bubble bodies. A tool result is measured, its content is not kept."""
    pattern = "^bubbleId:([^:]+):(.+)$"
    value = F.col("value").cast("string")
    rows = (
        kv.where(F.startswith("key", F.lit("bubbleId:")) & F.col("key").rlike(pattern))
        .where(is_json(value) & F.startswith(F.ltrim(value), F.lit("{")))
        .select(
            "store_path",
            F.regexp_extract("key", pattern, 1).alias("composer_id"),
            F.regexp_extract("key", pattern, 2).alias("bubble_id"),
            F.from_json(value, _BUBBLE).alias("b"),
        )
    )
    result = F.col("b.toolFormerData.result")
    kind = F.schema_of_variant(result)
    chars = F.when(kind == "STRING", utf16_length(F.try_variant_get(result, "$", "string"))).when(
        kind != "VOID", utf16_length(F.to_json(result))
    )
    tool = string_or_null(F.col("b.toolFormerData.name"))
    text = F.when(
        F.schema_of_variant("b.text") == "STRING", F.try_variant_get(F.col("b.text"), "$", "string")
    )
    return rows.select(
        "store_path", "composer_id", "bubble_id",
        _number(F.col("b.type")).cast("int").alias("type"),
        text.alias("text"),
        F.col("b.tokenCount.inputTokens").alias("input_tokens"),
        F.col("b.tokenCount.outputTokens").alias("output_tokens"),
        string_or_null(F.col("b.modelInfo.modelName")).alias("model_name"),
        tool.alias("tool_name"),
        F.when(tool.isNotNull(), string_or_null(F.col("b.toolFormerData.status"))).alias("tool_status"),
        F.when(tool.isNotNull(), chars).alias("tool_result_chars"),
    )


def composer_export(kv: DataFrame) -> DataFrame:
    """Headers with their bodies, one row per header. Composers without any body vanish."""
    comp = composers(kv)
    key = ["store_path", "composer_id"]
    joined = headers(comp).join(
        bubbles(kv).withColumn("has_body", F.lit(True)), [*key, "bubble_id"], "left"
    )
    alive = joined.where("has_body").select(*key).distinct()
    return joined.join(alive, key, "left_semi").withColumn(
        "has_body", F.coalesce("has_body", F.lit(False))
    )


def composer_refs(kv: DataFrame, stores: DataFrame) -> DataFrame:
    """One file ref per live composer, with the size and time of its physical store."""
    alive = composer_export(kv).select("store_path", "composer_id").distinct()
    return alive.join(stores, "store_path").select(
        F.lit("cursor").alias("source_kind"),
        F.concat("store_path", F.lit(COMPOSER_MARKER), "composer_id").alias("path"),
        "size_bytes",
        "mtime_ms",
    )


def _as_records(rows: DataFrame, raw: Column) -> DataFrame:
    """Record rows of an export; they are hashed like the lines of a file read in splits."""
    none = F.lit(None).cast("string")
    return rows.select(
        F.lit("cursor").alias("source_kind"), "path", F.col("line_no").cast("bigint").alias("line_no"), F.to_json(raw).alias("raw"),
        F.lit(False).alias("is_malformed"), none.alias("file_hash"), none.alias("raw_hash"), F.lit(True).alias("is_split"),
    )


def export_records(kv: DataFrame) -> DataFrame:
    """Records of every live composer: its own facts as line 0, its bubbles in conversation order behind."""
    key = ["store_path", "composer_id"]
    path = F.concat("store_path", F.lit(COMPOSER_MARKER), "composer_id").alias("path")
    bodies = composer_export(kv)
    alive = composers(kv).join(bodies.select(*key).distinct(), key, "left_semi")
    own = F.struct(
        F.col("composer_id").alias("composerId"), "name", F.col("workspace_name").alias("workspaceName"),
        F.col("created_at").alias("createdAt"), F.col("last_updated_at").alias("lastUpdatedAt"),
        F.when(F.col("model_name").isNotNull(), F.struct(F.col("model_name").alias("modelName"))).alias("modelConfig"),
    )
    tokens = F.struct(F.col("input_tokens").alias("inputTokens"), F.col("output_tokens").alias("outputTokens"))
    tool = F.struct(F.col("tool_name").alias("name"), F.col("tool_status").alias("status"), F.col("tool_result_chars").alias("resultChars"))
    bubble = F.struct(
        F.col("bubble_id").alias("bubbleId"), F.coalesce("type", "header_type").alias("type"), "text",
        F.when(F.coalesce("input_tokens", "output_tokens").isNotNull(), tokens).alias("tokenCount"),
        F.when(F.col("model_name").isNotNull(), F.struct(F.col("model_name").alias("modelName"))).alias("modelInfo"),
        F.when(F.col("tool_name").isNotNull(), tool).alias("toolFormerData"),
    )
    heads = _as_records(alive.select("*", path, F.lit(0).alias("line_no")), F.struct(own.alias("composer")))
    lines = _as_records(bodies.select("*", path, (F.col("pos") + 1).alias("line_no")), F.struct(bubble.alias("bubble")))
    return heads.unionByName(lines)


def transcript_records(records: DataFrame) -> DataFrame:
    """Terminal transcripts as records in the same shape."""
    bubble = F.struct(F.col("bubble_id").alias("bubbleId"), "type", "text", F.col("tool_names").alias("tools"))
    turns = transcript_export(records)
    return _as_records(turns.withColumn("line_no", F.col("pos")), F.struct(bubble.alias("bubble")))


_TURN = "role STRING, message VARIANT"


def transcript_export(records: DataFrame) -> DataFrame:
    """Terminal transcripts in the same shape: turns of user and assistant, numbered b0, b1, ...

    Text parts are joined by a newline; of tool calls only the names are kept.
    """
    r = records.withColumn("_t", F.from_json("raw", _TURN)).where(
        F.col("_t.role").isin("user", "assistant")
    )
    message = F.col("_t.message")
    content = F.try_variant_get(message, "$.content", "variant")
    as_parts = F.try_variant_get(content, "$", "array<variant>")
    parts = F.when(F.schema_of_variant(content).like("ARRAY%"), as_parts)

    def of_type(kind: str, name: str) -> Column:
        wanted = F.filter(
            parts,
            lambda p: (_text_at(p, "$.type") == kind) & _text_at(p, f"$.{name}").isNotNull(),
        )
        return F.transform(wanted, lambda p: _text_at(p, f"$.{name}"))

    text = F.coalesce(
        string_or_null(message), string_or_null(content), F.array_join(of_type("text", "text"), "\n"),
        F.lit(""),
    )
    turns = r.select(
        "path", "line_no",
        F.when(F.col("_t.role") == "user", 1).otherwise(2).alias("type"),
        text.alias("text"),
        F.coalesce(of_type("tool_use", "name"), F.lit([]).cast("array<string>")).alias("tool_names"),
    )
    numbered = running_sum(turns, ["path"], "line_no", F.lit(1), "_n")
    return numbered.select(
        "path",
        (F.col("_n") - 1).alias("pos"),
        F.concat(F.lit("b"), (F.col("_n") - 1).cast("string")).alias("bubble_id"),
        "type", "text", "tool_names",
    )
