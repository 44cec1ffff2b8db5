"""The ledger of past uploads: versioned read, upsert, and writes that follow what has changed."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionmill.operators.ordering import durable, latest_per_key
from sessionmill.sources.files import existing

LEDGER_VERSION = 2
LEDGER_SCHEMA = (
    "session_id string, content_hash string, last_uploaded_at string, manifest_id string, "
    "source_file_path string, mtime_ms double, byte_size_on_disk bigint, derivation string, "
    "policy_version string, endpoint string, user_id string"
)
_OPTIONAL = [
    ("source_file_path", "string"), ("mtime_ms", "double"), ("byte_size_on_disk", "bigint"),
    ("derivation", "string"), ("policy_version", "string"), ("endpoint", "string"), ("user_id", "string"),
]


def migrate(raw: DataFrame) -> DataFrame:
    """Older versions keep their entries and lack the optional columns; unknown newer versions and
    entries that break the schema count as an empty ledger."""
    for name, kind in _OPTIONAL:
        if name not in raw.columns:
            raw = raw.withColumn(name, F.lit(None).cast(kind))
    ok = (
        (F.col("schema_version") <= LEDGER_VERSION)
        & (F.col("session_id") != "")
        & F.col("content_hash").rlike("^[a-f0-9]{64}$")
        & (F.col("manifest_id") != "")
    )
    names = [f.split()[0] for f in LEDGER_SCHEMA.split(", ")]
    return raw.where(ok).select(*names)


OWNER = ["endpoint", "user_id"]


def _owned(ledger: DataFrame) -> DataFrame:
    """Entries without an owner, from older versions, belong to the unnamed one."""
    for name in OWNER:
        value = F.coalesce(name, F.lit("")) if name in ledger.columns else F.lit("")
        ledger = ledger.withColumn(name, value)
    return ledger


def of_user(ledger: DataFrame, endpoint: str, user_id: str) -> DataFrame:
    """The entries of one endpoint and user."""
    return _owned(ledger).where((F.col("endpoint") == endpoint) & (F.col("user_id") == user_id))


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entries of `new` replace those of `old` with the same owner and id; the last one in `new` wins.

    Of entries of one time the one with the greatest path, then hash, counts as last.
    """
    columns = old.columns
    old, new, key = _owned(old), _owned(new), [*OWNER, "session_id"]
    ties = [c for c in ("source_file_path", "content_hash") if c in new.columns]
    newest = latest_per_key(new, key, F.struct("last_uploaded_at", *ties))
    return old.join(newest, key, "left_anti").unionByName(newest).select(*columns)


BUCKETS = 64
_PLACE = "owner string, generation int, bucket int"
_COMMIT = "owner string, generation int, run_id string, buckets array<int>"


def _owner_key(endpoint: str, user_id: str) -> str:
    """Folder name of an owner; starts with a letter, so that it is never taken for a number."""
    return "o" + hashlib.sha256(f"{len(endpoint)}:{endpoint}{user_id}".encode()).hexdigest()[:24]


def _bucket() -> Column:
    return F.pmod(F.xxhash64("session_id"), F.lit(BUCKETS)).cast("int")


def _commits(spark: SparkSession, path: str, owner: str | None = None) -> DataFrame | None:
    commits = existing(lambda: spark.read.schema(_COMMIT).parquet(f"{path}/commits"))
    return commits if commits is None or owner is None else commits.where(F.col("owner") == owner)


def _generations(commits: DataFrame) -> DataFrame:
    """The generation in force of each owner's buckets."""
    return commits.select("owner", "generation", F.explode("buckets").alias("bucket")).groupBy("owner", "bucket").agg(
        F.max("generation").alias("generation")
    )


def read_ledger(
    spark: SparkSession, path: str, endpoint: str | None = None, user_id: str = "", buckets: list[int] | None = None
) -> DataFrame:
    """The ledger as last committed, of one owner if an endpoint is given; an absent ledger is empty.

    Of one owner only the folders in force are read, at most one per bucket.
    """
    owner = None if endpoint is None else _owner_key(endpoint, user_id)
    commits = _commits(spark, path, owner)
    empty = spark.createDataFrame([], LEDGER_SCHEMA)
    if commits is None:
        return empty
    reader = spark.read.schema(f"{LEDGER_SCHEMA}, schema_version int, {_PLACE}").option("basePath", f"{path}/data")
    current = _generations(commits)
    if owner is None:
        found = existing(lambda: reader.parquet(f"{path}/data"))
        return empty if found is None else migrate(found.join(current, ["owner", "generation", "bucket"], "left_semi"))
    rows = current.collect()  # one per bucket
    folders = [
        f"{path}/data/owner={owner}/generation={r.generation}/bucket={r.bucket}" for r in rows if buckets is None or r.bucket in buckets
    ]
    return migrate(reader.parquet(*folders)) if folders else empty


def write_ledger(changes: DataFrame, path: str, run_id: str = "", endpoint: str = "", user_id: str = "") -> list[int]:
    """Take up the changed entries of one owner; returns the buckets written.

    Entries lie in buckets by session id. Only buckets that hold a changed entry are merged and written, as the
    owner's next generation, so a run writes in proportion to what it sent. One more row commits them and
    names the run. A job that dies half way leaves no commit: the old generations stay in force and the next
    attempt writes over the leftover. Owners share no folder, so runs of different owners do not meet; one writer per
    owner.
    """
    spark, owner = changes.sparkSession, _owner_key(endpoint, user_id)
    changes = durable(changes.withColumns({"endpoint": F.lit(endpoint), "user_id": F.lit(user_id)}))
    touched = sorted(r.b for r in changes.select(_bucket().alias("b")).distinct().collect())  # at most BUCKETS
    commits = _commits(spark, path, owner)
    last = None if commits is None else commits.agg(F.max("generation")).first()[0]
    following = 0 if last is None else last + 1
    if touched:
        merged = upsert(read_ledger(spark, path, endpoint, user_id, touched), changes)
        (
            merged.withColumns({"schema_version": F.lit(LEDGER_VERSION), "bucket": _bucket()})
            .repartition("bucket")
            .write.mode("overwrite")
            .partitionBy("bucket")
            .parquet(f"{path}/data/owner={owner}/generation={following}")
        )
    commit = spark.createDataFrame([(owner, following, run_id, touched)], _COMMIT)
    commit.write.mode("append").partitionBy("owner").parquet(f"{path}/commits")
    return touched


def is_committed(spark: SparkSession, path: str, run_id: str, endpoint: str = "", user_id: str = "") -> bool:
    """Whether a run's entries are in the owner's ledger already."""
    commits = _commits(spark, path, _owner_key(endpoint, user_id))
    return commits is not None and not commits.where(F.col("run_id") == run_id).isEmpty()
