"""Merge rounds with a time limit on a stream (J3 + J6, W3).

Keyed streaming state holds the one open group of a correlation key: the set of
sources present, the arrival time of its *first* job and the kept jobs (at most
N). Within a micro-batch a key's new jobs are folded in arrival order:

* a job arriving more than ``timeout`` after the group's first job finds the group
  expired (discarded, reported with status ``expired``) and opens a new one;
* a job from a source already in the group is dropped while the group is open;
* the group is emitted (status ``complete``) as soon as every source is present.

An event-time timeout at ``first + timeout`` reports groups that no later job
touches once the watermark passes it. The state per key is bounded by N jobs, and
per trigger a key's work is bounded by the micro-batch, never by the key's
history.
"""

from __future__ import annotations

import json
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT_SCHEMA = ("key string, group_start timestamp, status string, member_ids string, "
                 "member_sources string, members string")
STATE_SCHEMA = "mask long, t0 timestamp, members string"


def _set_timeout(state: GroupState, deadline: pd.Timestamp) -> None:
    """Wake up at ``deadline``, or as soon as Spark allows if the watermark has passed it already."""
    state.setTimeoutTimestamp(max(int(deadline.timestamp() * 1000), state.getCurrentWatermarkMs() + 1))


def _fold(sources: list[str], timeout_s: float):
    full = (1 << len(sources)) - 1
    bit = {s: 1 << i for i, s in enumerate(sources)}
    limit = pd.Timedelta(seconds=timeout_s)

    def emit(key, t0, members, status):
        return (key, t0, status, ",".join(m["id"] for m in members),
                ",".join(m["source"] for m in members), json.dumps(members))

    def fn(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        k = key[0]
        out = []
        if state.hasTimedOut:
            mask, t0, members = state.get
            out.append(emit(k, t0, json.loads(members), "expired"))
            state.remove()
            yield pd.DataFrame(out, columns=["key", "group_start", "status", "member_ids", "member_sources",
                                             "members"])
            return
        if state.exists:
            mask, t0, members = state.get
            members = json.loads(members)
            t0 = pd.Timestamp(t0)
        else:
            mask, t0, members = 0, None, []
        batch = pd.concat(list(pdfs)).sort_values(["ts", "seq"])
        for ts, src, jid, payload in zip(batch["ts"], batch["source"], batch["id"], batch["payload"]):
            ts = pd.Timestamp(ts)
            if mask and ts - t0 > limit:
                out.append(emit(k, t0, members, "expired"))
                mask, t0, members = 0, None, []
            if not mask:
                t0 = ts
            b = bit[src]
            if mask & b:
                continue  # duplicate source while the group is open
            mask |= b
            members.append({"id": jid, "source": src, "payload": payload, "ts": ts.isoformat()})
            if mask == full:
                out.append(emit(k, t0, members, "complete"))
                mask, t0, members = 0, None, []
        if mask:
            state.update((mask, t0.to_pydatetime(), json.dumps(members)))
            _set_timeout(state, t0 + limit)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["key", "group_start", "status", "member_ids", "member_sources", "members"])

    return fn


def merge_rounds_stream(jobs: DataFrame, sources: list[str], timeout_secs: int, key: str = "correlation_key",
                        ts: str = "arrival_ts", seq: str = "arrival_seq", watermark: str = "1 minute") -> DataFrame:
    """Streaming merged groups: rows with status ``complete`` or ``expired``.

    ``watermark`` must cover the arrival disorder of the input: Spark drops rows
    older than the watermark (and only counts them in the query progress)."""
    src = (jobs.where(F.col(key).isNotNull() & F.col("source").isin(sources))
           .select(F.col(key).cast("string").alias("key"), "source", "id", "payload",
                   F.col(ts).cast("timestamp").alias("ts"), F.col(seq).alias("seq"))
           .withWatermark("ts", watermark))
    return src.groupBy("key").applyInPandasWithState(
        _fold(sources, float(max(timeout_secs, 1))), OUTPUT_SCHEMA, STATE_SCHEMA, "append",
        GroupStateTimeout.EventTimeTimeout)


# ── J5: correlation by expression (greedy first matching group) ──────────────

THETA_STATE = "groups string"


def _theta_fold(sources: list[str], timeout_s: float, match):
    limit = pd.Timedelta(seconds=timeout_s)
    need = set(sources)

    def fn(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        k = key[0]
        out = []
        groups = json.loads(state.get[0]) if state.exists else []
        if state.hasTimedOut:
            # only the groups whose deadline the watermark passed expire
            wm = pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")
            live = []
            for g in groups:
                if pd.Timestamp(g["t0"]) + limit < wm:
                    out.append((k, pd.Timestamp(g["t0"]), "expired", ",".join(m["id"] for m in g["members"]),
                                ",".join(m["source"] for m in g["members"]), json.dumps(g["members"])))
                else:
                    live.append(g)
            if live:
                state.update((json.dumps(live),))
                _set_timeout(state, min(pd.Timestamp(g["t0"]) for g in live) + limit)
            else:
                state.remove()
            yield pd.DataFrame(out, columns=["key", "group_start", "status", "member_ids", "member_sources",
                                             "members"])
            return
        batch = pd.concat(list(pdfs)).sort_values(["ts", "seq"])
        for ts, src, jid, payload in zip(batch["ts"], batch["source"], batch["id"], batch["payload"]):
            ts = pd.Timestamp(ts)
            live = []
            for g in groups:  # groups older than the limit are discarded on arrival
                if ts - pd.Timestamp(g["t0"]) > limit:
                    out.append((k, pd.Timestamp(g["t0"]), "expired", ",".join(m["id"] for m in g["members"]),
                                ",".join(m["source"] for m in g["members"]), json.dumps(g["members"])))
                else:
                    live.append(g)
            groups = live
            job = {"id": jid, "source": src, "payload": payload, "ts": ts.isoformat()}
            body = json.loads(payload) if payload else None
            target = None
            for g in groups:  # the first group (creation order) with any matching member
                try:
                    if any(match(json.loads(m["payload"]) if m["payload"] else None, body) for m in g["members"]):
                        target = g
                        break
                except Exception:  # an evaluation error drops the job
                    target = "error"
                    break
            if target == "error":
                continue
            if target is None:
                target = {"t0": ts.isoformat(), "members": []}
                groups.append(target)
            if any(m["source"] == src for m in target["members"]):
                continue  # duplicate source while the group is open
            target["members"].append(job)
            if {m["source"] for m in target["members"]} >= need:
                out.append((k, pd.Timestamp(target["t0"]), "complete",
                            ",".join(m["id"] for m in target["members"]),
                            ",".join(m["source"] for m in target["members"]), json.dumps(target["members"])))
                groups.remove(target)
        if groups:
            state.update((json.dumps(groups),))
            first = min(pd.Timestamp(g["t0"]) for g in groups)
            _set_timeout(state, first + limit)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["key", "group_start", "status", "member_ids", "member_sources", "members"])

    return fn


def merge_theta_stream(jobs: DataFrame, sources: list[str], match, timeout_secs: int, block_key: str,
                       ts: str = "arrival_ts", seq: str = "arrival_seq", watermark: str = "1 minute") -> DataFrame:
    """Join each arriving job to the first open group (creation order) holding a
    member ``a`` with ``match(a_payload, b_payload)``; otherwise open a new group.

    ``block_key`` is the equality part of the correlation expression (required at
    scale: groups only match inside a block); ``match`` is the residual predicate on
    the two payloads (dicts). State per block is the open groups, each living at
    most ``timeout_secs`` from its first job, so it is bounded by the block's jobs
    within one timeout."""
    src = (jobs.where(F.col(block_key).isNotNull() & F.col("source").isin(sources))
           .select(F.col(block_key).cast("string").alias("key"), "source", "id", "payload",
                   F.col(ts).cast("timestamp").alias("ts"), F.col(seq).alias("seq"))
           .withWatermark("ts", watermark))
    return src.groupBy("key").applyInPandasWithState(
        _theta_fold(sources, float(max(timeout_secs, 1)), match), OUTPUT_SCHEMA, THETA_STATE, "append",
        GroupStateTimeout.EventTimeTimeout)
