import hashlib
import json

from pyspark.sql import functions as F

from sessionmill.operators import usage as U
from sessionmill.operators.identity import resolve_identity, session_facts
from sessionmill.sources.files import list_files, raw_hashes, sidecar_records, sidecars_as_records
from sessionmill.sources.records import (
    content_hash,
    content_hash_of_text,
    explode_json_array,
    explode_ndjson,
    file_hashes,
    read_ndjson,
    typed_records,
)


def one_block_hash(data):
    part = hashlib.sha256(hashlib.sha256(data).hexdigest().encode()).hexdigest()
    return hashlib.sha256(f"v1/blocks\n{len(data)}\n{part}".encode()).hexdigest()


def chat(role, model=None, usage=None, **top):
    message = {"role": role, **({"model": model} if model else {}), **({"usage": usage} if usage else {})}
    return json.dumps({**top, "message": message})


def records(spark, *raws, kind="claude-code", path="/p/s.jsonl"):
    rows = [(kind, path, i, r, False) for i, r in enumerate(raws)]
    df = spark.createDataFrame(rows, "source_kind string, path string, line_no bigint, raw string, is_malformed boolean")
    return typed_records(df)


def test_ndjson_lines(spark):
    df = spark.createDataFrame([('{"a":1}\r\n\n ﻿not json  \n{"b":2} x\n{"b":2}',)], "text string")
    rows = explode_ndjson(df).collect()
    assert [json.loads(r.raw) for r in rows] == [{"a": 1}, {"_raw": "not json"}, {"_raw": '{"b":2} x'}, {"b": 2}]
    assert [r.line_no for r in rows] == [0, 2, 3, 4]
    assert [r.is_malformed for r in rows] == [False, True, True, False]


def test_json_array(spark):
    df = spark.createDataFrame([("a", '[{"x":1},5]'), ("b", '{"x":1}'), ("c", "[1"), ("d", "[]")], "f string, text string")
    assert [(r.f, r.raw) for r in explode_json_array(df).collect()] == [("a", '{"x":1}'), ("a", "5")]


def test_strings_are_told_from_other_values(spark):
    r = records(
        spark,
        json.dumps({"timestamp": 5, "cwd": {"a": 1}, "sessionId": "", "message": "hello"}),
        json.dumps({"timestamp": "t", "cwd": "/w", "message": {"role": "assistant", "model": 7, "usage": {"input_tokens": "5", "output_tokens": 2}}}),
        json.dumps([1]), json.dumps("text"), "null",
    ).orderBy("line_no").collect()
    assert (r[0].ts, r[0].cwd, r[0].native_id, r[0].role) == (None, None, None, None)
    assert (r[1].ts, r[1].cwd, r[1].model, r[1].input_tokens, r[1].output_tokens) == ("t", "/w", None, None, 2.0)
    assert all(x.role is None for x in r[2:])


def test_message_costs(spark):
    usage = {"input_tokens": 1_000_000, "output_tokens": 1_000_000}
    m = U.with_tier(U.session_metrics(records(spark, chat("user"), chat("assistant", "claude-sonnet-4", usage)))).first()
    assert m.total_cost_usd == 18.0 and m.tier == "full" and m.turn_count == 1


def test_metrics(spark):
    m = U.session_metrics(records(
        spark, chat("user", timestamp="2026-01-01T10:00:00Z"),
        chat("assistant", "claude-sonnet-4", {"input_tokens": 1000, "output_tokens": 500, "cache_read_input_tokens": 200}, timestamp="2026-01-01T10:01:00Z"),
    )).first()
    assert (m.total_tokens, m.turn_count, m.model_provider) == (1700, 1, "anthropic")
    assert (m.started_at, m.ended_at) == ("2026-01-01T10:00:00Z", "2026-01-01T10:01:00Z")


def test_primary_model_and_ties(spark):
    rows = [chat("assistant", m, {"output_tokens": n}) for m, n in [("haiku", 100), ("opus", 5000), ("b", 5000)]]
    r = records(spark, *rows)
    assert U.session_metrics(r).first().primary_model == "opus"
    assert U.session_model_usage(r).count() == 3


def test_no_usage(spark):
    m = U.session_metrics(records(spark, chat("user"), chat("user"))).first()
    assert (m.total_cost_usd, m.primary_model, m.turn_count, m.started_at) == (0.0, None, 2, None)
    assert not m.has_answer


def codex(spark):
    total = {"input_tokens": 1_000_000, "cached_input_tokens": 100_000, "output_tokens": 100_000,
             "reasoning_output_tokens": 25_000, "total_tokens": 1_100_000}
    return records(
        spark,
        json.dumps({"type": "session_meta", "payload": {"id": "x", "cwd": "/w", "git": {"branch": "main"}}}),
        json.dumps({"type": "turn_context", "payload": {"model": "gpt-5"}}),
        json.dumps({"type": "event_msg", "payload": {"type": "user_message"}}),
        json.dumps({"type": "event_msg", "payload": {"type": "agent_message"}}),
        json.dumps({"type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": total}}}),
        kind="codex",
    )


def test_codex(spark):
    m = U.session_metrics(codex(spark)).first()
    assert (m.input_tokens, m.cache_read_tokens, m.output_tokens, m.reasoning_tokens) == (900_000, 100_000, 100_000, 25_000)
    assert (m.total_tokens, m.turn_count, m.model_provider, m.primary_model) == (1_100_000, 1, "openai", "gpt-5")
    assert abs(m.total_cost_usd - 15.9) < 1e-9 and m.has_answer


def test_codex_without_usage(spark):
    m = U.session_metrics(codex(spark).where("line_no < 4")).first()
    assert (m.total_cost_usd, m.total_tokens, m.reasoning_tokens, m.primary_model) == (0.0, 0.0, 0.0, None)
    assert U.session_model_usage(codex(spark).where("line_no < 4")).count() == 0


def test_identity(spark):
    native = "0b6f1f6e-2d3c-4c61-9f4e-2d6a4c7f2a11"
    raw = json.dumps({"sessionId": native})
    main = records(spark, raw, path="/h/.claude/projects/-h-p/s.jsonl")
    copy = records(spark, raw, path="/h/.claude/projects/-h-p--claude-worktrees-001-x/s.jsonl")
    rows = {r.path.split("/")[-2]: r for r in resolve_identity(session_facts(main.unionByName(copy))).collect()}
    assert rows["-h-p"].session_id == native and rows["-h-p"].derivation == "native"
    other = rows["-h-p--claude-worktrees-001-x"]
    assert other.session_id != native and other.derivation == "path-hash" and other.native_session_id == native
    row = resolve_identity(session_facts(codex(spark))).first()
    assert (row.session_cwd, row.recorded_branch, row.native_session_id) == ("/w", "main", "x")


def chunked_hash(raws, size=65_536):
    """Digest of the chunk digests; `raws` has one record per line."""
    digests = [hashlib.sha256(("v0.2\n[" + ",".join(raws[i : i + size]) + "]").encode()).hexdigest() for i in range(0, len(raws), size)]
    return hashlib.sha256(("v0.2/chunks\n" + "".join(digests)).encode()).hexdigest()


def test_content_hash_of_rows_and_of_texts(spark):
    raws = [json.dumps({"i": i, "t": "é"}, ensure_ascii=False) for i in range(10)]
    rows = [("a", i, r) for i, r in enumerate(raws)] + [("b", 0, raws[0])]
    df = spark.createDataFrame(rows, "k string, line_no bigint, raw string").repartition(5)
    whole = {r.k: r.content_hash for r in content_hash(df, ["k"]).collect()}
    assert whole == {"a": chunked_hash(raws), "b": chunked_hash(raws[:1])}
    cut = {r.k: r.content_hash for r in content_hash(df, ["k"], chunk_lines=4).collect()}
    assert cut["a"] == chunked_hash(raws, 4) and cut["b"] == whole["b"]
    text = "\n".join(raws) + "\n\nbad line\n"
    row = spark.createDataFrame([(text,)], "t string").select(content_hash_of_text(F.col("t")).alias("h")).first()
    assert row.h == chunked_hash([*raws, '{"_raw":"bad line"}'])


def test_file_scan_does_not_depend_on_splits(spark, tmp_path):
    d = tmp_path / ".claude" / "projects" / "p"
    d.mkdir(parents=True)
    lines = [json.dumps({"i": i, "pad": "x" * (i % 50)}) for i in range(3000)]
    (d / "big.jsonl").write_text("\r\n".join(lines) + "\r\n\r\nbroken\n")
    (d / "small.jsonl").write_text('{"a":1}\n')
    (d / "empty.jsonl").write_text("")
    glob = str(d / "*.jsonl")
    want = [*lines, '{"_raw":"broken"}']
    results = []
    try:
        for size, limit in (("16384", 10**9), ("16384", 1000), ("70000", 1000), ("100m", 1000)):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            df = read_ndjson(spark, glob, "claude-code", whole_limit=limit)
            rows = df.where("path LIKE '%big%'").orderBy("line_no").collect()
            assert [r.raw for r in rows] == want and rows[-1].is_malformed
            assert [r.line_no for r in rows] == [*range(3000), 3001]
            assert {r.is_split for r in rows} == {limit < 10**9} and df.count() == 3002
            results.append({r.path[-9:]: r for r in file_hashes(df, files=list_files(spark, glob, "claude-code")).collect()})
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r["big.jsonl"].content_hash for r in results} == {chunked_hash(want)}
    assert {r["big.jsonl"].raw_hash for r in results} == {one_block_hash((d / "big.jsonl").read_bytes())}
    assert {r["all.jsonl"].raw_hash for r in results} == {one_block_hash(b'{"a":1}\n')}
    listed = {r.path.rsplit("/", 1)[1]: r for r in list_files(spark, glob, "claude-code", "m1").collect()}
    # Spark does not list files without any byte.
    assert set(listed) == {"big.jsonl", "small.jsonl"}
    assert listed["small.jsonl"].size_bytes == 8 and listed["small.jsonl"].path.startswith("/")


def test_hash_of_appended_records(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a":1}\n')
    (tmp_path / "b.jsonl").write_text('{"b":1}\n')
    df = read_ndjson(spark, str(tmp_path / "*.jsonl"), "claude-code")
    path = str(tmp_path / "a.jsonl")
    more = spark.createDataFrame([("claude-code", path, 2**62, "{}")], "source_kind string, path string, line_no bigint, raw string")
    got = {r.path: r.content_hash for r in file_hashes(df, more).collect()}
    digests = [hashlib.sha256(f"v0.2\n[{x}]".encode()).hexdigest() for x in ('{"a":1}', "{}")]
    assert got[path] == hashlib.sha256(("v0.2/chunks\n" + "".join(digests)).encode()).hexdigest()
    assert got[str(tmp_path / "b.jsonl")] == chunked_hash(['{"b":1}'])


def test_sidecars(spark, tmp_path):
    d = tmp_path / "p" / "s1" / "tool-results"
    d.mkdir(parents=True)
    (d / "zzz.txt").write_text("b" * 20)
    (d / "aaa.txt").write_text("é" * 10)
    (d / "emoji.txt").write_text("😀")
    (d / "other.log").write_text("no")
    contents = spark.read.format("binaryFile").load(str(d / "*")).select(
        F.regexp_replace("path", "^file:/+", "/").alias("path"), "content"
    )
    rows = sidecars_as_records(sidecar_records(contents)).orderBy("line_no").collect()
    got = [json.loads(r.raw) for r in rows]
    assert [(g["file_id"], g["bytes"], g["chars"]) for g in got] == [("aaa", 20, 10), ("emoji", 4, 2), ("zzz", 20, 20)]
    assert all(r.path.endswith("/p/s1.jsonl") for r in rows)


def test_raw_hash_once_per_store(spark):
    refs = spark.createDataFrame([("/s.vscdb::composer::a",), ("/s.vscdb::composer::b",), ("/f",), ("/gone",)], "path string")
    contents = spark.createDataFrame([("/s.vscdb", bytearray(b"x")), ("/f", bytearray(b"y"))], "path string, content binary")
    got = {r.path: r.raw_hash for r in raw_hashes(refs, contents).collect()}
    x = one_block_hash(b"x")
    assert got == {"/s.vscdb::composer::a": x, "/s.vscdb::composer::b": x, "/f": one_block_hash(b"y")}
