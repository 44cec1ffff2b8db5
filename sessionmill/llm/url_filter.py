"""URL filter: rules in sorted digest arrays that every executor memory-maps.

A rule is a host and a path prefix. Its key is the 64-bit xxhash of host + path. Keys lie sorted in a
binary file beside the rule strings, Spark's file distribution brings the file to each executor (also to
those that start later), and tasks map it. A url's candidates are its host and parent domains, each with
every rule length that its path has; they are found by one binary search per batch and confirmed against
the stored strings, so a collision of digests cannot decide. A list larger than `SHARD_BYTES` becomes
several files; the driver holds one at a time.

Defined cases: a null url, or one without `://`, has an empty host and path and fits no rule. The longest
rule wins, of equally long ones the longer host. A url that fits no rule gets the default verdict. Of
rules listed twice, a block wins. Rules with a null host or path are ignored. Repeated rows are judged one
by one; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHARD_BYTES = 256 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_OUT = "page_id long, host string, path string, rule string, verdict string"


class DigestArray:
    """One memory-mapped file: count, sorted keys, string offsets, allow flags, strings."""

    def __init__(self, path: str):
        raw = np.memmap(path, dtype=np.uint8, mode="r")
        n = int(raw[:8].view(np.int64)[0])
        self.keys = raw[8 : 8 + 8 * n].view(np.uint64)
        self.ends = raw[8 + 8 * n : 16 + 16 * n].view(np.int64)
        self.allow = raw[16 + 16 * n : 16 + 17 * n]
        self.text = raw[16 + 17 * n :]

    @staticmethod
    def pack(rules: list[tuple[str, bool]]) -> bytes:
        digests = np.array([xxhash.xxh64_intdigest(text) for text, _ in rules], dtype=np.uint64)
        order = np.argsort(digests, kind="stable")
        strings = [rules[i][0].encode() for i in order]
        ends = np.concatenate([[0], np.cumsum([len(s) for s in strings], dtype=np.int64)]).astype(np.int64)
        allow = np.array([rules[i][1] for i in order], dtype=np.uint8)
        return b"".join([np.int64(len(rules)).tobytes(), digests[order].tobytes(), ends.tobytes(), allow.tobytes(), *strings])

    def find(self, digests: np.ndarray, strings: list[str]) -> dict[int, bool]:
        """Position in `strings` -> allow flag, for those that are rules."""
        found = {}
        at = np.searchsorted(self.keys, digests)
        for i in np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == digests)) if len(self.keys) else ():
            k, text = int(at[i]), strings[i].encode()
            while k < len(self.keys) and self.keys[k] == digests[i]:  # equal digests lie side by side
                if bytes(self.text[self.ends[k] : self.ends[k + 1]]) == text:
                    found[int(i)] = bool(self.allow[k])
                    break
                k += 1
        return found


class UrlRules:
    """Rules made ready for executors; build it once, use it for any number of tables."""

    def __init__(self, spark: SparkSession, rules: Iterable[tuple[str, str, str]], shard_bytes: int = SHARD_BYTES):
        merged: dict[str, tuple[str, bool]] = {}
        self.files: list[str] = []
        self.lengths: set[int] = set()
        self.labels = 0
        size = 0
        for host, path, verdict in rules:
            if host is None or path is None:
                continue
            allow = verdict == "allow" and merged.get(host + path, ("", True))[1]
            size += 0 if host + path in merged else 17 + len((host + path).encode())
            merged[host + path] = (host + path, allow)
            self.lengths.add(len(path))
            self.labels = max(self.labels, host.count(".") + 1)
            if size >= shard_bytes:
                self._ship(spark, list(merged.values()))
                merged, size = {}, 0
        self._ship(spark, list(merged.values()))

    def _ship(self, spark: SparkSession, rules: list[tuple[str, bool]]) -> None:
        blob = DigestArray.pack(rules)
        name = f"url-rules-{hashlib.sha256(blob).hexdigest()[:32]}.bin"
        path = os.path.join(os.path.realpath(tempfile.gettempdir()), name)
        if not os.path.exists(path):
            with tempfile.NamedTemporaryFile(dir=os.path.dirname(path), delete=False) as f:
                f.write(blob)
            os.replace(f.name, path)
        spark.sparkContext.addFile(path)
        self.files.append(name)


def host_and_path(url: str = "url") -> list:
    """Columns host (A-Z lower-cased) and path of a url, by SQL functions."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)"))
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)
    return [F.translate(host, _UPPER, _LOWER).alias("host"), path.alias("path")]


def _candidates(host: str, path: str, lengths: list[int], labels: int) -> list[tuple[int, int, str]]:
    """(rule length, host length, host + path prefix) for the host and its parents of at most `labels` labels."""
    parts = host.split(".")
    out = []
    for k in range(max(0, len(parts) - labels), len(parts)):
        parent = ".".join(parts[k:])
        for n in lengths:
            if n > len(path):
                break
            out.append((len(parent) + n, len(parent), parent + path[:n]))
    return out


def judge_urls(pages: DataFrame, rules: UrlRules, default: str = "allow") -> DataFrame:
    """One row per page: page_id, host, path, rule (host + path prefix, or null), verdict."""
    files, lengths, labels = rules.files, sorted(rules.lengths), rules.labels

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = [DigestArray(SparkFiles.get(name)) for name in files]
        for batch in batches:
            strings, owners, sizes = [], [], []
            for row, (host, path) in enumerate(zip(batch["host"].to_pylist(), batch["path"].to_pylist(), strict=True)):
                for size, host_size, text in _candidates(host, path, lengths, labels) if host else ():
                    strings.append(text)
                    owners.append(row)
                    sizes.append((size, host_size))
            digests = np.array([xxhash.xxh64_intdigest(s) for s in strings], dtype=np.uint64)
            best: dict[int, tuple[tuple[int, int], bool, str]] = {}
            for array in arrays:
                for i, allow in array.find(digests, strings).items():
                    old = best.get(owners[i])
                    if old is None or (sizes[i], not allow) > (old[0], not old[1]):
                        best[owners[i]] = (sizes[i], allow, strings[i])
            hits = [best.get(row) for row in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["page_id"],
                    batch["host"],
                    batch["path"],
                    pa.array([h and h[2] for h in hits], pa.string()),
                    pa.array([default if h is None else "allow" if h[1] else "block" for h in hits], pa.string()),
                ],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    return pages.select(F.col("page_id").cast("long").alias("page_id"), *host_and_path()).mapInArrow(judge, _OUT)
