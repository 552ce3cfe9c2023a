"""Merge rounds on a disordered stream that loses no row.

Spark drops rows behind its watermark before any stateful operator sees them. Here no watermark is set and each key
keeps its own event time instead: rows wait in its state until the key has seen a row ``delay`` later, are then folded
in the order of their times, and a row behind what was folded already goes to the output as ``late``. A key that falls
silent is settled by a processing-time timeout. Each input row is a member of exactly one output row, or still in the
state:

* ``complete`` and ``expired``: groups, as in the batch merge;
* ``duplicate``: a row whose source its open group had already;
* ``late``: a row older than the rows folded so far.

Which rows are late depends on a key's rows and their chunks alone, not on other keys. State of a key: the rows of one
``delay`` and the members of one open group (one for each source). A key's new rows are folded chunk by chunk, never
gathered.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from jobframe.streaming.merge import OUTPUT_SCHEMA

_COLUMNS = [c.split()[0] for c in OUTPUT_SCHEMA.split(", ")]
STATE_SCHEMA = "latest long, settled long, waiting string, group string"


def _output(key, rows, status):
    members = [{"id": r[3], "source": r[2], "payload": r[4], "ts": pd.Timestamp(r[0], unit="us").isoformat()} for r in rows]
    return (key, pd.Timestamp(rows[0][0], unit="us"), status, ",".join(r[3] for r in rows), ",".join(r[2] for r in rows),
            json.dumps(members))


def _fold(key, ready, group, out, n: int, limit: int):
    """The open group after ``ready``, rows (time in microseconds, number, source, id, payload) in order."""
    for row in ready:
        if group and row[0] - group[0][0] > limit:
            out.append(_output(key, group, "expired"))
            group = []
        if any(m[2] == row[2] for m in group):
            out.append(_output(key, [row], "duplicate"))
            continue
        group = [*group, row]
        if len(group) == n:
            out.append(_output(key, group, "complete"))
            group = []
    return group


def _rounds(n: int, limit: int, delay: int, idle_ms: int):
    def keep(state: GroupState, latest, settled, waiting, group) -> None:
        if latest is not None:
            state.update((latest, settled, json.dumps(waiting), json.dumps(group)))
            if waiting or group:
                state.setTimeoutDuration(max(idle_ms, 1))

    def run(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        k = key[0]
        latest, settled, waiting, group = state.get if state.exists else (None, None, "[]", "[]")
        waiting, group = json.loads(waiting), json.loads(group)
        if state.hasTimedOut:
            out: list = []
            group = _fold(k, sorted(waiting), group, out, n, limit)
            if group:
                out.append(_output(k, group, "expired"))
            keep(state, latest, latest, [], [])
            yield pd.DataFrame(out, columns=_COLUMNS)
            return
        for chunk in rows:
            out = []
            for row in zip(chunk["ts"], chunk["seq"], chunk["source"], chunk["id"], chunk["payload"], strict=True):
                row = [int(row[0]), int(row[1]), *row[2:]]
                if settled is not None and row[0] < settled:
                    out.append(_output(k, [row], "late"))
                else:
                    waiting.append(row)
                    latest = row[0] if latest is None else max(latest, row[0])
            if latest is not None:
                settled = latest - delay if settled is None else max(settled, latest - delay)
                group = _fold(k, sorted(r for r in waiting if r[0] <= settled), group, out, n, limit)
                waiting = [r for r in waiting if r[0] > settled]
            yield pd.DataFrame(out, columns=_COLUMNS)
        keep(state, latest, settled, waiting, group)

    return run


def merge_rounds_any_order(jobs: DataFrame, sources: list[str], timeout_secs: int, delay_secs: float = 60.0,
                           idle_secs: float | None = None, key: str = "correlation_key", ts: str = "arrival_ts",
                           seq: str = "arrival_seq") -> tuple[DataFrame, DataFrame]:
    """(merged groups and rejects as one stream with a status, see above; the jobs that take no part: without a key or
    time, or from other sources).

    ``delay_secs`` is the disorder that is put right; a key without new rows for ``idle_secs`` of the clock on the wall
    (by default the time limit and the delay) is settled and its open group expires."""
    idle = float(max(timeout_secs, 1)) + delay_secs if idle_secs is None else idle_secs
    known = F.col(key).isNotNull() & F.col("source").isin(sources) & F.col(ts).isNotNull()
    src = jobs.where(known).select(
        F.col(key).cast("string").alias("key"), "source", "id", "payload",
        F.unix_micros(F.col(ts).cast("timestamp")).alias("ts"), F.coalesce(F.col(seq), F.lit(0)).cast("long").alias("seq"))
    merged = src.groupBy("key").applyInPandasWithState(
        _rounds(len(sources), int(max(timeout_secs, 1)) * 1_000_000, int(delay_secs * 1_000_000), int(idle * 1000)),
        OUTPUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.ProcessingTimeTimeout)
    return merged, jobs.where(~F.coalesce(known, F.lit(False)))
