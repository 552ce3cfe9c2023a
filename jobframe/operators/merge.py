"""Correlation of several sources.

* ``merge_any``            J2/J4: forward every job, set its correlation key.
* ``first_complete_groups`` J3: the first group per key = the first job of each
  source; a grouped aggregate with map-side partial aggregation (``min_by``), so
  a key holding a third of all rows still shuffles one row per map partition.
* ``assign_rounds``        J3 rounds (no timeout): the exact per-key state machine
  "one open group per key, first job per source kept, later duplicates dropped
  while open, emit when every source is present" run as a *distributed prefix
  scan*: rows are range-partitioned by (key, arrival), so a hot key is spread
  over many partitions; each partition summarises its boundary key segments by
  the first row of each of the N sources and the outcomes of fresh starts; the
  summaries are composed per key (at most one row per partition a key spans, never
  per data row); a second pass replays each partition from its now-known entry
  state. Every group then has at most N members and is merged with a group-by.
* ``merged_jobs``          J7/J8: merged payload / envelope of a complete group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobframe.functions.json import compact_json, scalar_as_string
from jobframe.session import checkpoint_dir

def correlation_value(payload: Column, key: str) -> Column:
    """Top-level field; string/number/bool → string; else NULL."""
    return scalar_as_string(payload, key)


def merge_any(jobs: DataFrame, key: str | None = None) -> DataFrame:
    """Forward each job at once; with a key, the payload value replaces the
    correlation key (it may become NULL, overwriting a header key)."""
    if key is None:
        return jobs
    return jobs.withColumn("correlation_key", correlation_value(F.col("payload"), key))


def _source_number(sources: list[str]) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in sources]), F.col("source")).cast("int") - 1


def first_complete_groups(jobs: DataFrame, sources: list[str], key: str = "correlation_key",
                          order: tuple[str, ...] = ("arrival_ts", "arrival_seq")) -> DataFrame:
    """J3 first group per key: the earliest job of every source; keys lacking a
    source yield nothing. One row per key with ``members`` sorted by arrival."""
    ord_struct = F.struct(*[F.col(c) for c in order])
    member = F.struct(*[F.col(c) for c in order], F.col("source"), F.col("id"), F.col("payload"),
                      F.col("labels"))
    aggs = [F.expr(f"min_by(_member, _ord) FILTER (WHERE source = '{s}')").alias(f"_m{i}")
            for i, s in enumerate(sources)]
    g = (jobs.where(F.col(key).isNotNull() & F.col("source").isin(sources))
         .select(F.col(key).alias("key"), "source", member.alias("_member"), ord_struct.alias("_ord"))
         .groupBy("key").agg(*aggs))
    complete = F.lit(True)
    for i in range(len(sources)):
        complete = complete & F.col(f"_m{i}").isNotNull()
    members = sort_members(F.array(*[F.col(f"_m{i}") for i in range(len(sources))]), order)
    return g.where(complete).select("key", F.lit(0).alias("round"), members.alias("members"))


def sort_members(arr: Column, order: tuple[str, ...]) -> Column:
    """Sort member structs by arrival (the structs also hold a map, which is not orderable)."""
    def cmp(a, b):
        c = F.lit(0)
        for name in reversed(order):
            c = F.when(a[name] < b[name], F.lit(-1)).when(a[name] > b[name], F.lit(1)).otherwise(c)
        return c
    return F.array_sort(arr, cmp)


# ── exact rounds: distributed prefix scan ─────────────────────────────────────

def assign_rounds(jobs: DataFrame, sources: list[str], key: str = "correlation_key",
                  order: tuple[str, ...] = ("arrival_ts", "arrival_seq"),
                  num_partitions: int | None = None) -> DataFrame:
    """Label every job with its merge round and whether it was kept, for any number of sources.

    ``round`` counts the groups completed before the job within its key; a kept
    job belongs to group (key, round). Jobs without a key or from other sources
    are not part of the merge.
    """
    return _assign(jobs, sources, key, order, num_partitions, NEVER, F.lit(0).cast("bigint"))


def rounds_groups(labelled: DataFrame, sources: list[str], key: str = "correlation_key",
                  order: tuple[str, ...] = ("arrival_ts", "arrival_seq"), complete: bool = True) -> DataFrame:
    """Complete groups from ``assign_rounds`` output: each has exactly one kept
    job per source (at most N rows per group, so the group-by is bounded). With
    ``complete`` false the groups that lack a source (expired, or open at the end)."""
    member = F.struct(*[F.col(c) for c in order], F.col("source"), F.col("id"), F.col("payload"),
                      F.col("labels"))
    g = (labelled.where("kept").groupBy(F.col(key).alias("key"), "round")
         .agg(sort_members(F.collect_list(member), order).alias("members")))
    return g.where((F.size("members") == len(sources)) == complete)


# ── J7 / J8 ──────────────────────────────────────────────────────────────────

def _json_str(c: Column) -> Column:
    """JSON text of a string value."""
    return F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)


def merged_jobs(groups: DataFrame, pipeline_id: str, key: str | None) -> DataFrame:
    """J7 + J8: merged payload (first value wins per field, in arrival order; key
    field and ``correlation_key`` as strings; ``sources`` and ``jobs`` last) and
    envelope (content-derived id, source ``merge:<pipeline>``, first-wins labels).

    Built in stages so that each higher-order sub-result (parsed member maps, the
    correlation value, the first-wins field map) is evaluated once per group."""
    empty = F.create_map().cast("map<string,string>")
    # which fields there are (the last of a repeated key) and which are strings comes from the parsed value, the text
    # of all others from the payload as written, so numbers keep their form
    def texts(m):
        typed = F.try_variant_get(F.try_parse_json(m["payload"]), "$", "map<string,variant>")
        raw = F.map_entries(F.from_json(m["payload"], "map<string,string>"))
        return F.coalesce(F.transform_values(typed, lambda k, v: F.when(
            F.schema_of_variant(v) == "STRING", F.to_json(v)).otherwise(F.coalesce(compact_json(
                F.element_at(F.filter(raw, lambda e: e["key"] == k), -1)["value"]), F.lit("null")))), empty)

    maps = F.transform("members", texts)
    corr = F.lit(None).cast("string")
    if key:
        vals = F.transform("members", lambda m: correlation_value(m["payload"], key))
        corr = F.element_at(F.filter(vals, lambda v: v.isNotNull()), 1)
    g1 = groups.select("*", maps.alias("_maps"), corr.alias("_corr"))
    first_wins = F.aggregate(
        "_maps", empty,
        lambda acc, m: F.map_concat(acc, F.transform_values(
            F.map_filter(m, lambda k, v: ~F.array_contains(F.map_keys(acc), k)), lambda k, v: v)))
    g2 = g1.select("*", first_wins.alias("_fw"))
    reserved = ["sources", "jobs"] + ([key, "correlation_key"] if key else [])
    base = F.map_filter("_fw", lambda k, v: ~k.isin(reserved))
    fields = F.transform(F.map_entries(base), lambda e: F.concat(_json_str(e["key"]), F.lit(":"), e["value"]))
    extra = F.array().cast("array<string>")
    if key:
        cj = _json_str(F.col("_corr"))
        extra = F.when(F.col("_corr").isNotNull(), F.array(
            F.concat(_json_str(F.lit(key)), F.lit(":"), cj),
            F.concat(F.lit('"correlation_key":'), cj))).otherwise(F.array().cast("array<string>"))
    src_obj = F.concat(F.lit('"sources":{'), F.array_join(F.transform(
        F.array_distinct(F.transform("members", lambda m: m["source"])),
        lambda s: F.concat(_json_str(s), F.lit(":"),
                           F.element_at(F.filter("members", lambda m: m["source"] == s), 1)["payload"])),
        ","), F.lit("}"))
    jobs_arr = F.concat(F.lit('"jobs":['), F.array_join(F.transform("members", lambda m: F.concat(
        F.lit('{"id":'), _json_str(m["id"]), F.lit(',"source":'), _json_str(m["source"]),
        F.lit(',"payload":'), F.coalesce(m["payload"], F.lit("null")), F.lit("}"))), ","), F.lit("]"))
    payload = F.concat(F.lit("{"), F.array_join(F.concat(fields, extra, F.array(src_obj, jobs_arr)), ","),
                       F.lit("}"))
    labels = F.aggregate(F.transform("members", lambda m: F.coalesce(m["labels"], empty)), empty,
                         lambda acc, m: F.map_concat(acc, F.map_filter(m, lambda k, v: ~F.array_contains(F.map_keys(acc), k))))
    out = g2.select(
        "*",
        F.sha2(F.array_join(F.transform("members", lambda m: m["id"]), ","), 256).alias("merged_id"),
        F.lit(f"merge:{pipeline_id}").alias("merged_source"),
        payload.alias("merged_payload"),
        F.col("_corr").alias("merged_correlation_key"),
        labels.alias("merged_labels"),
    )
    return out.drop("_maps", "_corr", "_fw")


# ── exact rounds with or without a time limit: a prefix scan over partitions ──
#
# State of a key = (sources of the open group, its first arrival t0, groups started).
# What a segment does to it depends on the sources only through the first row of each
# source (the last one missing completes the group) and on t0 only through e = the
# first row later than t0 + timeout, which never lies beyond the first row later than
# (first time + timeout). A summary therefore ships, for N sources, N places of first
# rows with the outcome of a fresh start right after each, and the outcomes of fresh
# starts at the rows up to e: N entries and the distinct outcomes, not 2^N states.
# A fresh start at i ends at its completion or expiry, after which the next fresh start
# is determined, so outcomes are the ends of chains found by pointer doubling.

NEVER = 1 << 60  # a time limit that no group reaches


def _first_and_last(sid: np.ndarray, n: int):
    """Index of the first and of the last row of each source; m and -1 for none."""
    first, last = np.full(n, len(sid)), np.full(n, -1)
    idx = np.arange(len(sid))
    first[sid[::-1]] = idx[::-1]
    last[sid] = idx
    return first, last


def _completions(sid: np.ndarray, n: int, end: np.ndarray | None = None) -> np.ndarray:
    """Row at which a group that starts at each row has every source (m if none before ``end``)."""
    m = len(sid)
    idx, out = np.arange(m), np.full(m, -1)
    for s in range(n):
        near = np.minimum.accumulate(np.where(sid == s, idx, m)[::-1])[::-1]
        out = np.maximum(out, near if end is None else np.where(near < end, near, m))
    return out


def _summary(pid, key, t: np.ndarray, sid: np.ndarray, n: int, limit: int):
    """What a boundary segment does to any state that may enter it (see above)."""
    m = len(t)
    idx = np.arange(m)
    comp = _completions(sid, n)
    exp = np.searchsorted(t, t + limit, side="right")        # first row later than t_i + limit
    jump = np.where((exp < m) & (exp <= comp), exp, np.where(comp < m, comp + 1, m + 1))
    count, last = np.ones(m, dtype=np.int64), idx            # chain from each row: its length and its last start
    while (jump < m).any():
        on = jump < m
        to = np.where(on, jump, 0)
        count, last, jump = (np.where(on, count + count[to], count), np.where(on, last[to], last),
                             np.where(on, jump[to], jump))
    still = jump == m + 1                                    # open at the segment's end
    # outcome of a fresh start: its open group's first row and time (-1: none open), groups started; row m: nothing
    opened = np.append(np.where(still, last, -1), -1)
    time = np.append(np.where(still, t[last], -1), -1)
    count = np.append(count, 0)
    first, lasts = _first_and_last(sid, n)
    reach = min(int(np.searchsorted(t, t[0] + limit, side="right")), m)
    new = np.ones(reach + 1, dtype=bool)
    outs = np.stack([opened, time, count], axis=1)
    new[1:] = (outs[1:reach + 1] != outs[:reach]).any(axis=1)
    new[[c + 1 for c in first.tolist() if c + 1 <= reach]] = True  # so "expiry before completion" is one answer in a run
    at = np.flatnonzero(new)
    thr = np.where(at > 0, t[np.maximum(at - 1, 0)], -NEVER)
    after = np.minimum(first + 1, m)
    return (pid, key, m, at.tolist(), thr.tolist(), *(x[at].tolist() for x in (opened, time, count)), first.tolist(),
            lasts.tolist(), *(x[after].tolist() for x in (opened, time, count)))


_SUMMARY = ("_pid int, _key string, m bigint, starts array<bigint>, thr array<bigint>, og array<bigint>, ot array<bigint>, "
            "oc array<bigint>, first array<bigint>, last array<bigint>, ag array<bigint>, at array<bigint>, ac array<bigint>")


def _summaries(n: int, limit: int):
    def run(it):
        segs: list[tuple] = []  # (pid, key, times, sources) of the first and of the open segment, as arrays
        for pdf in it:
            if pdf.empty:
                continue
            keys = pdf["_key"].to_numpy()
            pid = int(pdf["_pid"].iloc[0])
            ts, sid = pdf["_t"].to_numpy().astype(np.int64), pdf["_sid"].to_numpy().astype(np.int64)
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])).tolist() + [len(keys)]
            for i, (a, b) in enumerate(zip(starts[:-1], starts[1:])):
                if i == 0 and segs and segs[-1][1] == keys[a]:
                    segs[-1][2].append(ts[a:b])
                    segs[-1][3].append(sid[a:b])
                elif not segs or b == len(keys):
                    segs = segs[:1] + [(pid, keys[a], [ts[a:b]], [sid[a:b]])]
        out = [_summary(p, k, np.concatenate(tt), np.concatenate(b), n, limit) for p, k, tt, b in segs]
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _SUMMARY.split(", ")])

    return run


def _after_segment(row, has: np.ndarray, t0: int, starts: int, limit: int):
    """State after a segment (its summary), from the open group's sources (none: nothing open), t0 and groups started."""
    m, first, last = int(row["m"]), np.asarray(row["first"]), np.asarray(row["last"])

    def outcome(opened, time, count):
        opened = int(opened)
        return (last >= opened) & (opened >= 0), int(time), starts + int(count)

    if not has.any():  # a fresh start at the first row
        return outcome(row["og"][0], row["ot"][0], row["oc"][0])
    lacking = np.flatnonzero(~has)
    s = int(lacking[first[lacking].argmax()])
    c = int(first[s])
    r = int(np.searchsorted(np.asarray(row["thr"], dtype=np.int64), t0 + limit, side="right")) - 1
    e = int(row["starts"][r])  # of a run of rows with one outcome
    if e < m and e <= c:
        return outcome(row["og"][r], row["ot"][r], row["oc"][r])
    if c < m:
        return outcome(row["ag"][s], row["at"][s], row["ac"][s])
    return has | (last >= 0), t0, starts


def _compose(n: int, limit: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        has, t0, starts, rows = np.zeros(n, dtype=bool), -1, 0, []
        for row in pdf.sort_values("_pid").to_dict("records"):  # a row for each partition that the key spans
            rows.append((int(row["_pid"]), row["_key"], has.astype(np.uint8).tobytes(), t0, starts))
            has, t0, starts = _after_segment(row, has, t0, starts, limit)
        return pd.DataFrame(rows, columns=["_pid", "_key", "_entry_has", "_entry_t0", "_entry_count"])

    return run


def _first_later(t: np.ndarray, lo: np.ndarray, hi: np.ndarray, than: np.ndarray) -> np.ndarray:
    """First index in [lo, hi) whose time is later than ``than``, else hi; t rises inside each range."""
    lo, hi = lo.copy(), hi.copy()
    while (lo < hi).any():
        mid = (lo + hi) // 2
        later = (lo < hi) & (t[np.minimum(mid, len(t) - 1)] > than)
        hi = np.where(later, mid, hi)
        lo = np.where((lo < hi) & ~later, mid + 1, lo)
    return lo


def _replay_batch(t: np.ndarray, sid: np.ndarray, seg_start: np.ndarray, n: int, limit: int, has: np.ndarray,
                  t0: np.ndarray, starts: np.ndarray):
    """Replay of all key segments of a batch at once, each from its entry state: ``has`` (segments, sources) says which
    sources the open group has (none: nothing is open).

    Fresh starts form a chain i -> ns(i) (completion + 1 or expiry row); the chains from the segments' first fresh
    starts are enumerated by doubling, then round numbers are a cumulative count of starts and a row is kept when its
    source has not occurred earlier in its group. Also returns the last segment's exit state."""
    m, k = len(t), len(seg_start)
    idx = np.arange(m)
    seg_end = np.append(seg_start[1:], m)
    seg = np.repeat(np.arange(k), seg_end - seg_start)
    end = seg_end[seg]
    comp, c = np.full(m, -1), np.full(k, -1)
    prev_same = np.full(m, -1)
    for s in range(n):
        on = sid == s
        near = np.minimum.accumulate(np.where(on, idx, m)[::-1])[::-1]
        near = np.where(near < end, near, m)  # first row from here in the segment with this source, m if none
        comp = np.maximum(comp, near)
        c = np.where(has[:, s], c, np.maximum(c, near[seg_start]))
        last = np.maximum.accumulate(np.where(on, idx, -1))
        prev_same = np.where(on, np.concatenate([[-1], last[:-1]]), prev_same)
    exp = _first_later(t, idx, end, t + limit)
    ns = np.where((exp < end) & (exp <= comp), exp, np.where(comp + 1 < end, comp + 1, m))
    # the first fresh start of each segment
    open_ = has.any(axis=1)
    e = _first_later(t, seg_start, seg_end, t0 + limit)
    first = np.where(~open_, seg_start, np.where((e < seg_end) & (e <= c), e, np.where(c + 1 < seg_end, c + 1, m)))
    entry_done = open_ & (first == m) & (c == seg_end - 1)  # the entry group completes on the segment's last row
    is_start = np.zeros(m, dtype=bool)
    nodes, jump = np.unique(first[first < m]), np.append(ns, m)
    while len(nodes):  # nodes within depth < 2^k, then square the jump
        step = jump[nodes]
        step = step[step < m]
        if not len(step):
            break
        nodes = np.union1d(nodes, step)
        jump = jump[jump]
    is_start[nodes] = True
    before = np.concatenate([[0], np.cumsum(is_start)])
    rounds = starts[seg] - 1 + before[1:] - before[seg_start][seg]
    last_start = np.maximum.accumulate(np.where(is_start, idx, -1))
    in_group = last_start >= seg_start[seg]
    kept = np.where(in_group, prev_same < last_start, ~has[seg, sid] & (prev_same < seg_start[seg]))
    a = int(seg_start[-1])
    begun = int(starts[-1] + is_start[a:].sum())
    present = np.zeros(n, dtype=bool)
    if entry_done[-1]:
        return rounds, kept, (present, -1, begun)
    if first[-1] == m:
        present |= has[-1]
        present[sid[a:]] = True
        return rounds, kept, (present, int(t0[-1]), begun)
    g = int(last_start[-1])
    if comp[g] < m:
        return rounds, kept, (present, -1, begun)
    present[sid[g:]] = True
    return rounds, kept, (present, int(t[g]), begun)


def _replay(n: int, limit: int):
    def run(it):
        cur, carry = None, None
        for pdf in it:
            if pdf.empty:
                continue
            keys = pdf["_key"].to_numpy()
            sid = pdf["_sid"].to_numpy().astype(np.int64)
            ts = pdf["_t"].to_numpy().astype(np.int64)
            seg_start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            has = np.zeros((len(seg_start), n), dtype=bool)
            for i, x in enumerate(pdf["_entry_has"].to_numpy()[seg_start]):
                if isinstance(x, bytes | bytearray):
                    has[i] = np.frombuffer(x, dtype=np.uint8) > 0
            t0, starts = (pdf[c].fillna(v).to_numpy().astype(np.int64)[seg_start]
                          for c, v in (("_entry_t0", -1), ("_entry_count", 0)))
            if keys[0] == cur:  # the open segment goes on
                has[0], t0[0], starts[0] = carry
            rounds, kept, carry = _replay_batch(ts, sid, seg_start, n, limit, has, t0, starts)
            cur = keys[-1]
            yield pdf.drop(columns=["_entry_has", "_entry_t0", "_entry_count", "_t", "_sid", "_pid", "_key"]).assign(
                round=rounds, kept=kept)

    return run


def _assign(jobs: DataFrame, sources: list[str], key: str, order: tuple[str, ...], num_partitions: int | None,
            limit: int, time: Column) -> DataFrame:
    n = len(sources)
    if not n:
        raise ValueError("a merge needs a source")
    spark = jobs.sparkSession
    parts = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = (jobs.where(F.col(key).isNotNull() & F.col("source").isin(sources))
            .withColumn("_key", F.col(key).cast("string")).withColumn("_sid", _source_number(sources)).withColumn("_t", time))
    ranged = (base.repartitionByRange(parts, "_key", *order)
              .withColumn("_pid", F.spark_partition_id())
              .sortWithinPartitions("_key", *order))
    checkpoint_dir(spark)
    ranged = ranged.checkpoint(eager=True)  # both passes must see identical partitions
    summ = ranged.select("_pid", "_key", "_t", "_sid").mapInPandas(_summaries(n, limit), _SUMMARY)
    entries = summ.groupBy("_key").applyInPandas(
        _compose(n, limit), "_pid int, _key string, _entry_has binary, _entry_t0 bigint, _entry_count bigint")
    # At most two rows per partition (its first and last key segment): bounded by
    # the partition count, never by the number of rows, so it can be broadcast.
    joined = ranged.join(F.broadcast(entries), ["_pid", "_key"], "left").sortWithinPartitions(
        "_pid", "_key", *order)
    schema = T.StructType([f for f in base.schema.fields if f.name not in ("_key", "_sid", "_t")])
    return joined.mapInPandas(_replay(n, limit), schema.add("round", T.LongType()).add("kept", T.BooleanType()))


def assign_rounds_timeout(jobs: DataFrame, sources: list[str], timeout_secs: int, key: str = "correlation_key",
                          order: tuple[str, ...] = ("arrival_ts", "arrival_seq"),
                          num_partitions: int | None = None) -> DataFrame:
    """Like ``assign_rounds`` with the group time limit (J6): a group lives
    ``timeout_secs`` (at least 1) from its first job, inclusive; a job arriving
    later finds it expired and opens a new group. ``round`` numbers the groups
    started within the key; groups with fewer than N kept jobs never completed.

    The per-partition summary of a boundary key has one entry per distinct
    fresh-start outcome within one timeout of the partition's first row for that
    key (plus one per source), not one per row."""
    time = F.unix_micros(F.col(order[0]).cast("timestamp"))
    return _assign(jobs, sources, key, order, num_partitions, int(max(timeout_secs, 1)) * 1_000_000, time)


# ── spec-driven entry point ──────────────────────────────────────────────────

def merge_for_pipeline(jobs: DataFrame, spec, order: tuple[str, ...] = ("arrival_ts", "arrival_seq"),
                       num_partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Apply ``spec.merge`` to the jobs routed to ``spec`` → (jobs, rejects).

    * one source or no merge section: unchanged (J9);
    * ``any``: forwarded at once, correlation key from the payload (J2);
    * ``all`` with ``correlation_key``: exact rounds with the group time limit
      (J3, J6) and merged envelopes (J7, J8); jobs without a key are rejected;
    * ``all`` with ``correlation_expr`` (J5): see ``jobframe.operators.theta``.

    Jobs of groups that never got all sources go to the rejects.
    """
    empty_rejects = jobs.sparkSession.createDataFrame([], "id string, source string, reason string")
    m = spec.merge
    if m is None or len(spec.sources) <= 1:
        return jobs, empty_rejects
    if m.strategy == "any":
        return merge_any(jobs, m.correlation_key), empty_rejects
    if m.strategy != "all":
        raise ValueError(f"unknown merge strategy {m.strategy!r}")
    if not m.correlation_key:
        if not m.correlation_expr:
            raise ValueError("merge 'all' needs a correlation key or expression")
        from jobframe.operators.theta import theta_groups

        groups, rest = theta_groups(jobs, list(spec.sources), m.correlation_expr, m.timeout_secs,
                                    payload_schema=spec.payload_schema, order=order)
        rejects = rest.select("id", "source", F.lit(INCOMPLETE).alias("reason"))
        return _merged_rows(groups, spec, None, order), rejects
    keyed = jobs.withColumn("_ck", correlation_value(F.col("payload"), m.correlation_key))
    rejects = keyed.where(F.col("_ck").isNull()).select(
        "id", "source", F.lit(f"missing correlation key '{m.correlation_key}'").alias("reason"))
    labelled = assign_rounds_timeout(keyed.where(F.col("_ck").isNotNull()), list(spec.sources),
                                     m.timeout_secs, key="_ck", order=order, num_partitions=num_partitions)
    groups = rounds_groups(labelled, list(spec.sources), key="_ck", order=order)
    rest = rounds_groups(labelled, list(spec.sources), key="_ck", order=order, complete=False)
    rejects = rejects.unionByName(rest.select(F.explode("members").alias("m")).select(
        "m.id", "m.source", F.lit(INCOMPLETE).alias("reason")))
    return _merged_rows(groups, spec, m.correlation_key, order), rejects


INCOMPLETE = "merge group never got all sources"


def _merged_rows(groups: DataFrame, spec, key: str | None, order: tuple[str, ...]) -> DataFrame:
    merged = merged_jobs(groups, spec.id, key)
    return merged.select(
        F.col("merged_id").alias("id"), F.col("merged_source").alias("source"),
        F.col("merged_payload").alias("payload"), F.col("merged_correlation_key").alias("correlation_key"),
        F.col("merged_labels").alias("labels"),
        F.element_at(F.col("members"), -1)[order[0]].alias(order[0]))
