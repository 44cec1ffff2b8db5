import random
import re

import pytest
from pyspark.sql import functions as F

from sessionmill.plans.upload import ListedFiles
from sessionmill.sources import sinks
from sessionmill.sources.files import list_files

NAMES = ["plain", "with space", "a=b", "c:d/e", "%41", "q?*#[x]{y}^", "Ünï", "~1", "", None]


def bodies(spark, folder):
    read = spark.read.text(folder, wholetext=True)
    return {(r.manifest_id, r.body): r.value for r in read.selectExpr("cast(manifest_id AS string) manifest_id", "cast(body AS string) body", "value").collect()}


@pytest.mark.parametrize("lines", [7, 65_536])
def test_bodies_of_any_length_are_one_file_each(spark, tmp_path, lines):
    rng = random.Random(4)
    rows, want = [], {}
    for k, name in enumerate(NAMES):
        numbers = sorted(rng.sample(range(400), 1 if k == 1 else 90))
        texts = [rng.choice(["{}", "", "é" * rng.randrange(5), "x" * rng.randrange(300), None]) for _ in numbers]
        rows += [(f"m{k % 2}", name, n, t) for n, t in zip(numbers, texts, strict=True)]
        # Spark reads the folder of an empty name as a null one, so these two share it.
        want.setdefault((f"m{k % 2}", name or None), "".join(f"{t or ''}\n" for t in texts))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "manifest_id string, session_id string, line_no long, raw string").repartition(5)
    out = str(tmp_path / "bodies")
    told = {(r.manifest_id, r.body or None): r.size_bytes for r in sinks.write_bodies(df, out, lines).collect()}
    assert bodies(spark, out) == want and told == {k: len(v.encode()) for k, v in want.items()}
    assert not [p for p in (tmp_path / "bodies").iterdir() if p.name.startswith("_")]
    sinks.write_bodies(df.where("session_id = 'plain'"), out, lines)  # a batch made again leaves nothing behind
    assert bodies(spark, out) == {("m0", "plain"): want["m0", "plain"]}
    sinks.write_bodies(df.where("false"), out, lines)
    assert not (tmp_path / "bodies").exists() or not list((tmp_path / "bodies").iterdir())


def test_a_piece_moved_before_is_no_fault(spark, tmp_path):
    """A task that is made again after its executor was lost meets bodies that are in place already."""
    import pyarrow as pa

    out = str(tmp_path / "out")
    lines = pa.RecordBatch.from_pydict({"manifest_id": ["m"] * 3, "body": ["b"] * 3, "piece": [0, 0, 1], "raw": ["x", "y", "z"]})
    told = next(sinks._write_pieces(iter([lines]), f"{out}/{sinks._PIECES}")).to_pylist()
    first = pa.RecordBatch.from_pylist([{"manifest_id": "m", "body": "b", "pieces": told[:1], "size_bytes": told[0]["size_bytes"]}])
    both = pa.RecordBatch.from_pylist([{"manifest_id": "m", "body": "c", "pieces": told[1:], "size_bytes": told[1]["size_bytes"]}])
    for batch in (first, both, first, both):
        assert next(sinks._join_pieces(iter([batch]), out)).num_rows == 1
    assert (tmp_path / "out/manifest_id=m/body=b/part-0.txt").read_text() == "x\ny\n"
    other = pa.RecordBatch.from_pylist([{"manifest_id": "m", "body": "b", "pieces": [{"name": "gone"}], "size_bytes": 99}])
    with pytest.raises(FileNotFoundError):
        next(sinks._join_pieces(iter([other]), out))


def test_globs_are_listed_once_and_splits_only_for_large_files(spark, tmp_path, monkeypatch):
    import sessionmill.plans.upload as upload

    opened = []
    monkeypatch.setattr(upload, "open_ndjson", lambda s, g, real=upload.open_ndjson: opened.append(g) or real(s, g))
    for k in range(4):
        (tmp_path / f"{k}.jsonl").write_text("".join(f'{{"n": {n}}}\n' for n in range(5 * 10**k)))
    glob = str(tmp_path / "*.jsonl")
    listing = list_files(spark, glob, "claude-code")
    read = ListedFiles({"claude-code": glob}, whole_limit=2000)
    large = F.col("size_bytes") > 2000
    for wanted, split in ((listing, 2), (listing.where(~large), 0), (listing.where(large).drop("size_bytes"), 2)):
        got = read(wanted).groupBy("path").agg(F.count("*").alias("n"), F.max("line_no").alias("last"), F.max("is_split").alias("split")).collect()
        assert len(got) == wanted.count() and sum(r.split for r in got) == split
        assert all(r.n == r["last"] + 1 == 5 * 10 ** int(re.search(r"(\d)\.jsonl", r.path)[1]) for r in got)
    assert opened == [glob]
    assert ListedFiles({"claude-code": str(tmp_path / "none/*.x")})(listing).count() == 0


def test_many_files_are_listed_in_few_tasks_and_moved_in_many(spark, tmp_path):
    from sessionmill.sources.files import LISTING_TASKS_PER_CORE
    from sessionmill.sources.records import open_ndjson, read_ndjson

    sc, cores = spark.sparkContext, spark.sparkContext.defaultParallelism
    conf = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    rows = spark.range(5 * LISTING_TASKS_PER_CORE * cores).selectExpr("'m' AS manifest_id", "cast(id AS string) AS session_id", "0L AS line_no", "'{}' AS raw")
    done = sinks.write_bodies(rows, str(tmp_path))
    assert done.rdd.getNumPartitions() == sinks.MOVE_TASKS_PER_CORE * cores and done.count() == rows.count()
    glob, before = f"{tmp_path}/*/*/*.txt", spark.conf.get(conf)
    ways = [lambda: list_files(spark, glob, "claude-code"), lambda: open_ndjson(spark, glob), lambda: read_ndjson(spark, glob, "claude-code", 1)]
    for k, way in enumerate(ways):
        sc.setJobGroup(f"listing-{k}", "")
        way()
        stages = [s for j in sc.statusTracker().getJobIdsForGroup(f"listing-{k}") for s in sc.statusTracker().getJobInfo(j).stageIds]
        tasks = [sc.statusTracker().getStageInfo(s).numTasks for s in stages]
        assert tasks and max(tasks) <= LISTING_TASKS_PER_CORE * cores and spark.conf.get(conf) == before
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert list_files(spark, glob, "claude-code").count() == rows.count()


def test_small_files_are_read_without_a_scan(spark, tmp_path, monkeypatch):
    """The same rows as by a scan, whatever names and bytes; only wanted ones, and none for those gone or not listed."""
    import gzip

    import sessionmill.plans.upload as upload
    from sessionmill.operators.ordering import durable
    from sessionmill.sources.records import read_ndjson

    opened = []
    monkeypatch.setattr(upload, "open_ndjson", lambda s, g, real=upload.open_ndjson: opened.append(g) or real(s, g))
    names = ["plain", "with space", "a=b+c", "%41", "q?*#[x]{y}^", "Ünï", *map(str, range(40))]
    for k, name in enumerate(names):
        (tmp_path / f"{name}.jsonl").write_bytes(b'{"k": %d}\r\n\n not json \xff\xfe\n{"n": "\xc3\xa9"}' % k)
    for odd, data in (("blank", b"\n \n"), ("empty", b""), ("_hidden", b"{}\n"), (".hidden", b"{}\n")):
        (tmp_path / f"{odd}.jsonl").write_bytes(data)
    glob = f"{tmp_path}/*.jsonl*"
    key = lambda df: sorted(map(repr, df.select(*[F.col(c).cast("binary") if c == "raw" else c for c in df.columns]).collect()))
    want = read_ndjson(spark, glob, "claude-code")
    listing = list_files(spark, glob, "claude-code")
    read = ListedFiles({"claude-code": glob})
    got = durable(read(listing))
    assert key(got) == key(want) and got.count() == 3 * len(names) and not opened
    # An empty frame of the session's parallelism stands in front.
    assert got.rdd.getNumPartitions() >= sinks.MOVE_TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    hidden = listing.limit(1).withColumn("path", F.lit(f"{tmp_path}/_hidden.jsonl"))
    some = listing.where("path LIKE '%plain%' OR path LIKE '%7.jsonl'").unionByName(hidden)
    assert key(read(some)) == key(want.where("path LIKE '%plain%' OR path LIKE '%7.jsonl'")) and not opened
    rows = read(listing)
    (tmp_path / "plain.jsonl").unlink()
    assert key(rows) == key(want.where("path NOT LIKE '%plain%'"))
    # A scan unpacks compressed files, so they are left to it.
    (tmp_path / "z.jsonl.gz").write_bytes(gzip.compress(b'{"z": 1}\n'))
    packed = list_files(spark, glob, "claude-code")
    assert key(ListedFiles({"claude-code": glob})(packed)) == key(read_ndjson(spark, glob, "claude-code")) and opened == [glob]


def test_a_listing_at_hand_is_not_made_again(spark, tmp_path, monkeypatch):
    import sessionmill.plans.upload as upload
    from sessionmill.sources.files import kept_listing

    for k in range(600):
        (tmp_path / f"{k}.jsonl").write_text("{}\n")
    glob = f"{tmp_path}/*.jsonl"
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    found = kept_listing(spark, glob, "claude-code")
    assert found.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism and "Scan binaryFile" not in found._jdf.queryExecution().toString()
    assert spark.conf.get("spark.sql.files.openCostInBytes") == cost
    listed = []
    monkeypatch.setattr(upload, "kept_listing", lambda *a, real=upload.kept_listing: listed.append(a) or real(*a))
    assert ListedFiles({"claude-code": glob}, found={"claude-code": found})(found).count() == 600 and not listed
    read = ListedFiles({"claude-code": glob})
    assert read(found).count() == read(found.limit(5)).count() + 595 == 600 and len(listed) == 1
