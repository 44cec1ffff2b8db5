"""Which hook triggers start an upload.

A trigger is dropped while the last *started* one is less than the cooldown ago, so each decision
depends on the previous one. Started triggers are at least one cooldown apart, and what happens in
a stretch of time depends on the past only through the first trigger it can start. That makes the
chain cuttable: time is cut into blocks, every block works out for each possible first start where
its chain ends, and only those summaries are walked in order per endpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Cooldown between two uploads, and how long a block verdict is believed.
COOLDOWN_MS = 120_000
BLOCK_TTL_MS = 12 * 60 * 60 * 1000
# A block holds at most as many distinct milliseconds, whatever the number of triggers.
BLOCK_MS = 3_600_000


def _whole_groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Batches of a sorted partition, cut so that no group is split."""
    held: list[pd.DataFrame] = []
    for pdf in frames:
        if pdf.empty:
            continue
        last = pdf[keys].iloc[-1]
        open_ = (pdf[keys] == last).all(axis=1).to_numpy()
        cut = int(np.argmax(open_))
        if held and (cut > 0 or not (held[-1][keys].iloc[-1] == last).all()):
            yield pd.concat([*held, pdf.iloc[:cut]], ignore_index=True)
            held = []
        elif cut > 0:
            yield pdf.iloc[:cut].reset_index(drop=True)
        held.append(pdf.iloc[cut:])
    if held:
        yield pd.concat(held, ignore_index=True)


def _chains(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group number, offset in its block, and next start in the same block (or the row count)."""
    same = (pdf["endpoint"] == pdf["endpoint"].shift()) & (pdf["block"] == pdf["block"].shift())
    group = (~same).to_numpy().cumsum() - 1
    offset = (pdf["ts_ms"] - pdf["block"] * BLOCK_MS).to_numpy()
    # Groups laid out one behind the other, further apart than a cooldown.
    position = group * (BLOCK_MS + COOLDOWN_MS) + offset
    after = np.searchsorted(position, position + COOLDOWN_MS, side="left")
    n = len(position)
    inside = (after < n) & (group[np.minimum(after, n - 1)] == group)
    return group, offset, np.where(inside, after, n)


def _summaries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per block: which first start (up to `upper_ts`) leads to which last start (`end_ts`)."""
    for pdf in _whole_groups(frames, ["endpoint", "block"]):
        group, offset, after = _chains(pdf)
        n = len(pdf)
        last, hop = np.append(np.arange(n), n), np.append(after, n)
        # A chain has at most BLOCK_MS / COOLDOWN_MS + 1 starts in a block; double until there.
        for _ in range((BLOCK_MS // COOLDOWN_MS + 1).bit_length()):
            last = np.where(hop < n, last[hop], last)
            hop = hop[hop]
        # Only a trigger in the first cooldown, or the first one behind it, can be a first start.
        begins = np.append(True, group[1:] != group[:-1])
        early = offset < COOLDOWN_MS
        first = early | begins | np.append(False, early[:-1])
        ts = pdf["ts_ms"].to_numpy()
        end = ts[last[:n]]
        cand = np.flatnonzero(first)
        runs = np.append((group[cand][1:] != group[cand][:-1]) | (end[cand][1:] != end[cand][:-1]), True)
        keep = cand[runs]
        yield pd.DataFrame(
            {"endpoint": pdf["endpoint"].to_numpy()[keep], "block": pdf["block"].to_numpy()[keep],
             "upper_ts": ts[keep], "end_ts": end[keep]}
        )


def _walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The start in force when each block begins. An endpoint has one entry per hour or so."""
    for pdf in _whole_groups(frames, ["endpoint"]):
        out = []
        for endpoint, rows in pdf.groupby("endpoint", sort=False):
            upper, end = rows["upper_ts"].to_numpy(), rows["end_ts"].to_numpy()
            blocks, at = np.unique(rows["block"].to_numpy(), return_index=True)
            last = rows["stored_ms"].iloc[0]
            last = None if pd.isna(last) else int(last)
            for block, lo, hi in zip(blocks, at, [*at[1:], len(rows)], strict=True):
                out.append((endpoint, int(block), last))
                earliest = upper[lo] if last is None else last + COOLDOWN_MS
                i = lo if last is None else lo + int(np.searchsorted(upper[lo:hi], earliest))
                if i < hi:
                    last = int(end[i])
        frame = pd.DataFrame(out, columns=["endpoint", "block", "entry_ms"])
        yield frame.astype({"entry_ms": "Int64"})


def _starts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Started triggers of each block, given the start in force at its begin."""
    for pdf in _whole_groups(frames, ["endpoint", "block"]):
        group, _, after = _chains(pdf)
        ts = pdf["ts_ms"].to_numpy()
        entry = pdf["entry_ms"].fillna(-(2**62)).to_numpy().astype("int64")
        allowed = ts >= entry + COOLDOWN_MS
        starts = []
        begins = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(pdf))
        for lo, hi in zip(begins[:-1], begins[1:], strict=True):
            # Times are sorted, so the first allowed one is the first start.
            i = lo + int(np.argmax(allowed[lo:hi])) if allowed[hi - 1] else hi
            while i < hi:
                starts.append(i)
                i = after[i]
        yield pd.DataFrame({"endpoint": pdf["endpoint"].to_numpy()[starts], "ts_ms": ts[starts]})


def started_triggers(triggers: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """(endpoint, ts_ms) of the triggers that start an upload.

    Duplicates collapse before the shuffle, which bounds a block by its milliseconds. A busy
    endpoint is spread over one group per block. `stored` (endpoint, last_ms) are the last starts before;
    where the first trigger is older than that the clock was set back, and it starts one.
    """
    distinct = triggers.select("endpoint", "ts_ms").distinct()
    blocks = distinct.withColumn("block", F.floor(F.col("ts_ms") / BLOCK_MS))

    def clustered(df: DataFrame) -> DataFrame:
        return df.repartition("endpoint", "block").sortWithinPartitions("endpoint", "block", "ts_ms")

    summaries = clustered(blocks).mapInPandas(
        _summaries, "endpoint string, block bigint, upper_ts bigint, end_ts bigint"
    )
    if stored is None:
        summaries = summaries.withColumn("stored_ms", F.lit(None).cast("bigint"))
    else:
        first = distinct.groupBy("endpoint").agg(F.min("ts_ms").alias("_first"))
        valid = stored.join(first, "endpoint").where("last_ms <= _first")
        summaries = summaries.join(valid.select("endpoint", F.col("last_ms").alias("stored_ms")), "endpoint", "left")
    entries = (
        summaries.repartition("endpoint")
        .sortWithinPartitions("endpoint", "block", "upper_ts")
        .mapInPandas(_walk, "endpoint string, block bigint, entry_ms bigint")
    )
    return clustered(blocks.join(entries, ["endpoint", "block"])).mapInPandas(
        _starts, "endpoint string, ts_ms bigint"
    )


def blocked(until_ms: Column, now_ms: Column) -> Column:
    """A verdict that cannot be read does not block."""
    return F.coalesce(until_ms > now_ms, F.lit(False))


def hook_actions(triggers: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Action of every trigger: not_logged_in, then blocked, then cooldown, else spawned.

    Only triggers that pass the first two gates take part in the cooldown. Of several triggers in
    the same millisecond one starts, the one with the smallest id.
    """
    gate = F.when(~F.col("logged_in"), "not_logged_in").when(
        blocked(F.col("blocked_until_ms"), F.col("ts_ms")), "blocked"
    )
    gated = triggers.withColumn("gate", gate)
    started = started_triggers(gated.where("gate IS NULL"), stored).withColumn("_started", F.lit(True))
    first = (
        gated.where("gate IS NULL")
        .groupBy("endpoint", "ts_ms")
        .agg(F.min("trigger_id").alias("trigger_id"))
        .join(started, ["endpoint", "ts_ms"])
        .select("endpoint", "trigger_id", "_started")
    )
    return gated.join(first, ["endpoint", "trigger_id"], "left").select(
        *triggers.columns,
        F.coalesce("gate", F.when(F.col("_started"), "spawned").otherwise("cooldown")).alias("action"),
    )


def block_verdicts(responses: DataFrame) -> DataFrame:
    """Last block verdict per endpoint and until when it holds."""
    return responses.where("blocked").groupBy("endpoint").agg(
        (F.max("ts_ms") + F.lit(BLOCK_TTL_MS)).alias("blocked_until_ms")
    )
