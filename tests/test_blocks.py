"""Raw hashes by blocks and the growth of files, held against plain versions."""

import hashlib
import random

import pytest

from pyspark.sql import functions as F
from sessionmill.sources import blocks as B
from sessionmill.sources.files import raw_hashes


def plain_hash(data, block, fan):
    leaves = [hashlib.sha256(data[k : k + block]).hexdigest() for k in range(0, len(data), block)]
    parts = [hashlib.sha256("".join(leaves[k : k + fan]).encode()).hexdigest() for k in range(0, len(leaves), fan)]
    return hashlib.sha256(f"v1/blocks\n{len(data)}\n{''.join(parts)}".encode()).hexdigest()


def listing(spark, paths):
    return spark.createDataFrame([(str(p), p.stat().st_size if p.exists() else 10) for p in paths], "path string, size_bytes long")


def test_read_and_given_content_hash_alike(spark, tmp_path):
    rng = random.Random(1)
    files = {}
    for k, size in enumerate([1, 6, 7, 8, 27, 28, 29, 500]):
        p = tmp_path / f"a b+%20[{k}]{{x,y}}ü.jsonl"
        p.write_bytes(bytes(rng.choice(b"ab\n\xff\xc3") for _ in range(size)))
        files[str(p)] = p.read_bytes()
    refs = listing(spark, [tmp_path / p for p in files] + [tmp_path / "gone"])
    read = {r.path: r.raw_hash for r in B.block_hashes(B.file_blocks(refs, block=7), fan=4).collect()}
    assert read == {p: plain_hash(d, 7, 4) for p, d in files.items()}
    given = spark.createDataFrame([(p, bytearray(d)) for p, d in files.items()] + [("empty", bytearray())], "path string, content binary")
    made = {r.path: r.h for r in given.select("path", B.block_hash_of(F.col("content"), 7, 4).alias("h")).collect()}
    assert made == read | {"empty": plain_hash(b"", 7, 4)}


def test_stores_of_any_size(spark, tmp_path):
    """3 GB without data on disk: no row holds more than a block."""
    p = tmp_path / "state.vscdb"
    with p.open("wb") as f:
        f.truncate(3 << 30)
    refs = spark.createDataFrame([(f"{p}::composer::a",), (f"{p}::composer::b",)], "path string")
    got = {r.raw_hash for r in raw_hashes(refs, listing(spark, [p])).collect()}
    leaf = hashlib.sha256(bytes(B.BLOCK)).hexdigest()
    part = hashlib.sha256((leaf * (3 << 30 >> 22)).encode()).hexdigest()
    assert got == {hashlib.sha256(f"v1/blocks\n{3 << 30}\n{part}".encode()).hexdigest()}


def changed(old, new, block):
    """(status, from_byte) by comparing the bytes."""
    if old is None:
        return "new", 0
    if old == new:
        return "same", None
    if new.startswith(old):
        return "grown", len(old)
    at = next((k for k, (a, b) in enumerate(zip(old, new)) if a != b), min(len(old), len(new)))
    return "rewritten", min(at // block * block, len(new))


@pytest.mark.parametrize("block", [8, 64])
def test_growth_and_tails(spark, tmp_path, block):
    rng = random.Random(block)

    def text(n):
        return b"".join(bytes(rng.choice(b"xyz") for _ in range(rng.choice([0, 3, 5, 40]))) + b"\n" for _ in range(n))

    cases = {}
    for k in range(60):
        old = text(rng.randint(1, 12))
        old = old[:-1] if rng.random() < 0.3 and len(old) > 1 else old
        kind = k % 6
        if kind == 0:
            new = old
        elif kind == 1:
            new = old + text(rng.randint(1, 9))
        elif kind == 2:
            at = rng.randrange(len(old))
            new = old[:at] + b"Q" + old[at + 1 :] + (b"" if rng.random() < 0.5 else text(2))
        elif kind == 3:
            new = old[: max(1, rng.randrange(len(old)))]
        elif kind == 4:
            new, old = old, None
        else:
            new = old + b"w" * 50 + b"\n" + text(3)
        cases[tmp_path / f"f{k}.jsonl"] = (old, new)
    for p, (old, _) in cases.items():
        if old:
            p.write_bytes(old)
    known = B.file_blocks(listing(spark, [p for p in cases if p.exists()]), block=block).collect()
    known = spark.createDataFrame(known, B.BLOCKS)
    for p, (_, new) in cases.items():
        p.write_bytes(new)
    files = listing(spark, list(cases))
    seen = B.file_blocks(files, known, block=block)
    grown = B.growth(files, seen, known, block=block)
    got = {r.path: r for r in grown.collect()}
    lines = {}
    for r in B.tail_lines(seen, grown, block=block).collect():
        lines.setdefault(r.path, []).append((r.line_no, r.raw))
    for p, (old, new) in cases.items():
        status, at = changed(old, new, block)
        r = got[str(p)]
        assert (r.status, r.from_byte) == (status, at), (old, new)
        if at is not None:
            whole = new.decode().split("\n")
            whole = whole[:-1] if whole[-1] == "" else whole
            number = new[:at].count(b"\n")
            assert r.from_line == number
            assert sorted(lines.get(str(p), [])) == list(enumerate(whole))[number:] if at < len(new) else str(p) not in lines
        else:
            assert str(p) not in lines


def test_unchanged_blocks_are_not_read_again(spark, tmp_path):
    p = tmp_path / "log.jsonl"
    p.write_bytes(b"0123456\n" * 100)
    known = spark.createDataFrame(B.file_blocks(listing(spark, [p]), block=64).collect(), B.BLOCKS)
    p.write_bytes(b"0123456\n" * 103)
    files = listing(spark, [p])
    seen = B.file_blocks(files, known, block=64)
    grown = B.growth(files, seen, known, block=64)
    assert [(r.line_no, r.raw) for r in B.tail_lines(seen, grown, block=64).orderBy("line_no").collect()] == [(k, "0123456") for k in (100, 101, 102)]


def test_no_files(spark):
    none = spark.createDataFrame([], "path string, size_bytes long")
    known = spark.createDataFrame([], B.BLOCKS)
    seen = B.file_blocks(none, known)
    grown = B.growth(none, seen, known)
    assert B.block_hashes(seen).collect() == grown.collect() == B.tail_lines(seen, grown).collect() == []


def test_blocks_of_many_small_files_are_read_in_many_tasks(spark, tmp_path):
    """The rows that name the blocks are small, what they name is not."""
    from sessionmill.operators.ordering import durable

    for k in range(40):
        (tmp_path / str(k)).write_bytes(b"x" * k)
    (tmp_path / "0").unlink()
    read = durable(B.file_blocks(listing(spark, sorted(tmp_path.iterdir()))))
    assert read.count() == 39 and read.rdd.getNumPartitions() == B.reading_tasks(spark)
    assert sum(n > 0 for n in read.rdd.glom().map(len).collect()) > spark.sparkContext.defaultParallelism
