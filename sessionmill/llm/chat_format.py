"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant in turn, beginning with user and
ending with assistant. For each turn the repair may keep it, relabel it, merge it into the turn before (same
role), or put empty turns before it; empty turns may also follow the last one. A dynamic program over the
automaton's states (start, system, user, assistant: the role of the last turn) finds the cheapest repair.

One turn is a 4 x 4 matrix of costs, and a run of turns is their min-plus product. So a conversation of any
length is cut into pieces, range partitioned by (conversation, turn): each piece yields its matrix, the few
matrices of a conversation fix the state at every border, and each piece is then traced back by itself.
Rendered turns come out as rows in order, one per source turn or empty turn, and their `rendered` parts
join to the formatted text; a conversation is never gathered into one row.

Defined cases: order is by turn, then role, then text (nulls first). Rows equal in all four columns count
once. Role names are taken in any case and trimmed, with the usual aliases; a null or unknown role can
become any role at a low price. A null text counts as empty. Null conversation ids form one conversation.
Among repairs of equal cost, the one whose roles come first in the order system, user, assistant wins, turn
by turn from the end. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, islice, product
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionmill.llm.common import checkpointed

ROLES = ("system", "user", "assistant")
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "developer": "system"}
MERGE, RELABEL, RELABEL_UNKNOWN, INSERT = 2, 3, 1, 5
START, SYSTEM, USER, ASSISTANT = range(4)
_NEVER = 1 << 40
#: Empty turns to put between a state and the next turn of another role; None: not possible.
_BETWEEN = {
    (START, SYSTEM): (),
    (START, USER): (),
    (START, ASSISTANT): ("user",),
    (SYSTEM, USER): (),
    (SYSTEM, ASSISTANT): ("user",),
    (USER, USER): ("assistant",),
    (USER, ASSISTANT): (),
    (ASSISTANT, USER): (),
    (ASSISTANT, ASSISTANT): ("user",),
}
_END = {START: (), SYSTEM: ("user", "assistant"), USER: ("assistant",), ASSISTANT: ()}


def step_cost(state: int, role: int, given: str | None) -> tuple[int, str, tuple[str, ...]]:
    """Cheapest way to take a turn as `role` (1-3) from a state: cost, action, empty turns before it."""
    own = 0 if given == ROLES[role - 1] else RELABEL if given else RELABEL_UNKNOWN
    options = []
    if state == role:
        options.append((MERGE + own, "merge", ()))
    if (state, role) in _BETWEEN:
        empty = _BETWEEN[state, role]
        options.append((INSERT * len(empty) + own, "relabel" if own else "keep", empty))
    return min(options, default=(_NEVER, "", ()), key=lambda o: o[0])


def end_cost(state: int) -> int:
    return INSERT * len(_END[state])


def _matrix(given: str | None) -> np.ndarray:
    m = np.full((4, 4), _NEVER, dtype=np.int64)
    for state, role in product(range(4), (SYSTEM, USER, ASSISTANT)):
        m[state, role] = step_cost(state, role, given)[0]
    return m


_MATRICES = {given: _matrix(given) for given in (*ROLES, None)}


def min_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), _NEVER)


def piece_matrix(given: list[str | None]) -> np.ndarray:
    total = np.full((4, 4), _NEVER, dtype=np.int64)
    np.fill_diagonal(total, 0)
    for role in given:
        total = min_plus(total, _MATRICES[role])
    return total


def best_path(given: list[str | None], first: int, last: int) -> list[int]:
    """States after each turn of a cheapest way from state `first` to state `last`."""
    costs = [np.where(np.arange(4) == first, 0, _NEVER)]
    for role in given:
        costs.append(np.minimum((costs[-1][:, None] + _MATRICES[role]).min(axis=0), _NEVER))
    path = [last]
    for k in range(len(given) - 1, 0, -1):
        path.append(int(np.argmin(costs[k] + _MATRICES[given[k]][:, path[-1]])))
    return path[::-1] if given else []


def _role(column: str) -> F.Column:
    low = F.lower(F.trim(F.col(column)))
    for alias, role in ALIASES.items():
        low = F.when(low == alias, F.lit(role)).otherwise(low)
    return F.when(low.isin(*ROLES), low)


def pieces(conversations: DataFrame) -> DataFrame:
    """Turns with their piece (a range partition) and their order; checkpointed, so both stay as they are."""
    order = ["unnamed", "conv_id", "turn", "role", "text"]
    turns = conversations.select("conv_id", "turn", "role", "text").distinct()
    turns = turns.withColumn("unnamed", F.col("conv_id").isNull()).withColumn("conv_id", F.coalesce(F.col("conv_id").cast("long"), F.lit(0)))
    return checkpointed(
        turns.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(
            "unnamed",
            "conv_id",
            F.spark_partition_id().alias("piece"),
            F.monotonically_increasing_id().alias("place"),
            F.col("role").alias("source_role"),
            _role("role").alias("given"),
            F.coalesce("text", F.lit("")).alias("text"),
        )
    )


_KEY = ["unnamed", "conv_id"]
_SUMMARY = pa.schema([("unnamed", pa.bool_()), ("conv_id", pa.int64()), ("piece", pa.int32()), ("matrix", pa.list_(pa.int64()))])
_BORDER = pa.schema([*list(_SUMMARY)[:3], ("first", pa.int32()), ("last", pa.int32()), ("final", pa.bool_())])
_MADE = pa.schema(
    [
        *list(_SUMMARY)[:3],
        ("place", pa.int64()),
        ("at", pa.int32()),
        *[(name, pa.string()) for name in ("action", "role", "source_role", "text")],
        ("opens", pa.bool_()),
        ("turn", pa.int64()),
        ("part", pa.int64()),
        ("closes", pa.bool_()),
        ("ends", pa.bool_()),
    ]
)


def _sql(schema: pa.Schema) -> str:
    names = {pa.bool_(): "boolean", pa.int64(): "long", pa.int32(): "int", pa.string(): "string"}
    return ", ".join(f"{f.name} {names.get(f.type, 'array<long>')}" for f in schema)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Runs of rows with equal keys; a run may go over the end of a batch."""
    rows = (row for batch in batches for row in batch.to_pylist())
    for key, run in groupby(rows, key=itemgetter(*keys)):
        yield key, list(run)


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    for part in iter(lambda: list(islice(rows, size)), []):
        columns = zip(*part, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per conversation in this piece its matrix; rows come in order."""
    found = ((*key, piece_matrix([r["given"] for r in rows]).ravel().tolist()) for key, rows in _groups(batches, [*_KEY, "piece"]))
    yield from _batched(found, _SUMMARY)


def _border_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    ending = np.array([end_cost(s) for s in range(4)])
    for key, rows in _groups(batches, _KEY):
        matrices = [np.array(r["matrix"], dtype=np.int64).reshape(4, 4) for r in rows]
        costs = [np.where(np.arange(4) == START, 0, _NEVER)]
        for m in matrices:
            costs.append(np.minimum((costs[-1][:, None] + m).min(axis=0), _NEVER))
        ends = [int(np.argmin(costs[-1] + ending))]
        for k in range(len(matrices) - 1, 0, -1):
            ends.append(int(np.argmin(costs[k] + matrices[k][:, ends[-1]])))
        state = START
        for k, (row, end) in enumerate(zip(rows, ends[::-1], strict=True)):
            yield (*key, row["piece"], state, end, k + 1 == len(rows))
            state = end


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """States at the borders of a conversation's pieces: one row per piece, at most as many as partitions."""
    yield from _batched(_border_rows(batches), _BORDER)


def _traced(rows: list[dict]) -> list[tuple]:
    """(place, at, action, role, source_role, text, opens) of one piece of one conversation."""
    given = [r["given"] for r in rows]
    state, out = rows[0]["first"], []
    for row, now in zip(rows, best_path(given, state, rows[0]["last"]), strict=True):
        _, action, empty = step_cost(state, now, row["given"])
        out += [(row["place"], k, "insert", e, None, "", True) for k, e in enumerate(empty)]
        out.append((row["place"], len(empty), action, ROLES[now - 1], row["source_role"], row["text"], action != "merge"))
        state = now
    if rows[0]["final"]:
        out += [(rows[-1]["place"], 10 + k, "insert", e, None, "", True) for k, e in enumerate(_END[state])]
    return out


def _trace_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for key, rows in _groups(batches, [*_KEY, "piece"]):
        made = _traced(rows)
        turn = part = 0
        for k, row in enumerate(made):
            turn, part = (turn + 1, 0) if row[-1] else (turn, part + 1 if k else 0)
            last = k + 1 == len(made)
            yield (*key, *row, turn, part, last or made[k + 1][-1], last)


def _trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repaired rows of each piece. `turn` is 0 for parts of a turn that an earlier piece began."""
    yield from _batched(_trace_rows(batches), _MADE)


def repair_roles(conversations: DataFrame) -> DataFrame:
    """Rows of the repaired conversations: conv_id, out_turn, part, action, role, source_role, text, rendered.

    `part` counts the source turns merged into one turn. In the order (out_turn, part), the `rendered` strings of
    a conversation join to its text in a chat markup.
    """
    key, by_piece = _KEY, [*_KEY, "piece"]
    turns = pieces(conversations)
    # The checkpoint keeps rows in order within their partition, and a partition is a piece.
    summed = turns.select(*by_piece, "given").mapInArrow(_summaries, _sql(_SUMMARY))
    borders = summed.repartition(*key).sortWithinPartitions(*by_piece).mapInArrow(_borders, _sql(_BORDER))
    made = checkpointed(
        turns.join(borders, by_piece)
        .repartition(*by_piece)
        .sortWithinPartitions(*by_piece, "place")
        .mapInArrow(_trace, _sql(_MADE))
    )
    # What earlier pieces hold: one row per conversation and piece goes through the windows.
    sizes = made.groupBy(*by_piece).agg(
        F.max("turn").alias("turns"),
        (F.max(F.struct("turn", "part")).getField("part") + 1).alias("held"),  # parts of the piece's last turn
        F.min(F.struct("place", "at", "opens")).getField("opens").alias("begins"),
    )
    order = Window.partitionBy(*key).orderBy("piece")
    offsets = (
        sizes.withColumn("turn_base", F.coalesce(F.sum("turns").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("run", F.sum(F.when(F.col("turns") > 0, 1).otherwise(0)).over(order))
        .withColumn("carried", F.sum("held").over(Window.partitionBy(*key, "run").orderBy("piece")))
        .withColumn("part_base", F.coalesce(F.lag("carried").over(order), F.lit(0)))
        .withColumn("next_begins", F.coalesce(F.lead("begins").over(order), F.lit(True)))
        .select(*by_piece, "turn_base", "part_base", "next_begins")
    )
    closes = F.when(F.col("ends"), F.col("next_begins")).otherwise(F.col("closes"))
    opening = F.when(F.col("opens"), F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"))).otherwise(F.lit("\n"))
    return made.join(offsets, by_piece).select(
        F.when(~F.col("unnamed"), F.col("conv_id")).alias("conv_id"),
        (F.col("turn_base") + F.col("turn") - 1).alias("out_turn"),
        (F.col("part") + F.when(F.col("turn") == 0, F.col("part_base")).otherwise(0)).alias("part"),
        "action",
        "role",
        "source_role",
        "text",
        F.concat(opening, "text", F.when(closes, F.lit("<|im_end|>\n")).otherwise(F.lit(""))).alias("rendered"),
    )
