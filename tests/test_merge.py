"""Order-dependent merge rounds against a brute-force fold."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from jobframe.operators.merge import assign_rounds, assign_rounds_timeout, merged_jobs, rounds_groups


def brute(rows, sources):
    full = (1 << len(sources)) - 1
    out, state = {}, {}
    for key, seq, src in sorted(rows, key=lambda r: (r[0], r[1])):
        st, cnt = state.get(key, (0, 0))
        b = 1 << sources.index(src)
        if st & b:
            out[seq] = (cnt, False)
        else:
            out[seq] = (cnt, True)
            st |= b
            if st == full:
                st, cnt = 0, cnt + 1
        state[key] = (st, cnt)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rounds_match_sequential_fold_with_hot_key(spark, seed):
    rnd = random.Random(seed)
    sources = ["a", "b", "c"]
    rows = []
    seq = 0
    for _ in range(3000):  # one hot key holding most rows, spread over many partitions
        key = "hot" if rnd.random() < 0.6 else f"k{rnd.randint(0, 40)}"
        rows.append((key, seq, rnd.choice(sources)))
        seq += 1
    base = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame(
        [(k, s, src, f"id{s}", "{}", {}, base + dt.timedelta(seconds=s)) for k, s, src in rows],
        "correlation_key string, arrival_seq long, source string, id string, payload string, "
        "labels map<string,string>, arrival_ts timestamp")
    got = {r.arrival_seq: (r["round"], r.kept)
           for r in assign_rounds(df, sources, num_partitions=8).select("arrival_seq", "round", "kept").collect()}
    assert got == brute(rows, sources)


def test_merged_payload_rules(spark):
    base = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([
        ("k1", 1, "a", "ja", '{"order": 7, "x": 1, "jobs": "shadowed"}', {"env": "a"}, base),
        ("k1", 2, "b", "jb", '{"order": "7", "x": 2, "y": true}', {"env": "b", "t": "b"}, base),
    ], "correlation_key string, arrival_seq long, source string, id string, payload string, "
       "labels map<string,string>, arrival_ts timestamp")
    g = rounds_groups(assign_rounds(df, ["a", "b"], num_partitions=2), ["a", "b"])
    row = merged_jobs(g, "pipe", "order").first()
    import json

    p = json.loads(row.merged_payload)
    assert p["x"] == 1 and p["y"] is True          # first value wins, later fields kept
    assert p["order"] == "7" and p["correlation_key"] == "7"
    assert [j["id"] for j in p["jobs"]] == ["ja", "jb"]
    assert set(p["sources"]) == {"a", "b"}
    assert row.merged_source == "merge:pipe"
    assert row.merged_labels == {"env": "a", "t": "b"}


def brute_timeout(rows, sources, limit_s):
    full = (1 << len(sources)) - 1
    out, state = {}, {}
    for key, seq, src, ts in sorted(rows, key=lambda r: (r[0], r[3], r[1])):
        mask, t0, starts = state.get(key, (0, None, 0))
        if mask and ts - t0 > limit_s:
            mask = 0
        if not mask:
            t0, starts = ts, starts + 1
        b = 1 << sources.index(src)
        if mask & b:
            out[seq] = (starts - 1, False)
        else:
            out[seq] = (starts - 1, True)
            mask |= b
            if mask == full:
                mask = 0
        state[key] = (mask, t0, starts)
    return out


@pytest.mark.parametrize("seed,limit", [(11, 30), (12, 5), (13, 200)])
def test_rounds_with_timeout_match_sequential_fold(spark, seed, limit):
    from jobframe.operators.merge import assign_rounds_timeout

    rnd = random.Random(seed)
    sources = ["a", "b", "c"]
    rows, t = [], 0
    for seq in range(2500):
        t += rnd.choice([0, 1, 2, 5, 20])
        key = "hot" if rnd.random() < 0.6 else f"k{rnd.randint(0, 30)}"
        rows.append((key, seq, rnd.choice(sources), t))
    base = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame(
        [(k, s, src, f"id{s}", "{}", {}, base + dt.timedelta(seconds=ts)) for k, s, src, ts in rows],
        "correlation_key string, arrival_seq long, source string, id string, payload string, "
        "labels map<string,string>, arrival_ts timestamp")
    got = {r.arrival_seq: (r["round"], r.kept) for r in
           assign_rounds_timeout(df, sources, limit, num_partitions=8).select("arrival_seq", "round", "kept").collect()}
    assert got == brute_timeout(rows, sources, limit)


def test_rounds_across_small_arrow_batches(spark):
    """Segments that continue across Arrow batches inside one partition."""
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        test_rounds_match_sequential_fold_with_hot_key(spark, 4)
        test_rounds_with_timeout_match_sequential_fold(spark, 14, 20)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_merge_for_pipeline_dispatch(spark):
    import json

    from jobframe.operators.merge import merge_for_pipeline
    from jobframe.spec import MapStep, MergeSpec, PipelineSpec

    base = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([
        ("a1", "a", '{"order": 1, "x": "a"}', base, 0),
        ("b1", "b", '{"order": 1, "y": "b"}', base + dt.timedelta(seconds=5), 1),
        ("a2", "a", '{"order": 2}', base, 2),
        ("b2", "b", '{"order": 2}', base + dt.timedelta(seconds=120), 3),   # after the 60 s limit
        ("c1", "a", '{"nokey": 1}', base, 4),
    ], "id string, source string, payload string, arrival_ts timestamp, arrival_seq long") \
        .withColumn("correlation_key", F.lit(None).cast("string")) \
        .withColumn("labels", F.create_map().cast("map<string,string>"))
    steps = (MapStep(id="m"),)
    spec_all = PipelineSpec(id="p", steps=steps, sources=("a", "b"),
                            merge=MergeSpec("all", correlation_key="order", timeout_secs=60))
    out, rej = merge_for_pipeline(df, spec_all, num_partitions=2)
    rows = out.collect()
    assert len(rows) == 1 and rows[0].correlation_key == "1" and rows[0].source == "merge:p"
    p = json.loads(rows[0].payload)
    assert p["x"] == "a" and p["y"] == "b" and [j["id"] for j in p["jobs"]] == ["a1", "b1"]
    # the job without a key, and those of the group that expired (nothing vanishes)
    assert sorted((r.id, r.reason) for r in rej.collect()) == [
        ("a2", "merge group never got all sources"), ("b2", "merge group never got all sources"),
        ("c1", "missing correlation key 'order'")]
    spec_any = PipelineSpec(id="q", steps=steps, sources=("a", "b"), merge=MergeSpec("any", correlation_key="order"))
    assert sorted((r.id, r.correlation_key) for r in merge_for_pipeline(df, spec_any)[0].collect())[:2] == \
        [("a1", "1"), ("a2", "2")]
    single = PipelineSpec(id="r", steps=steps, sources=("a",), merge=MergeSpec("all", correlation_key="order"))
    assert merge_for_pipeline(df, single)[0].count() == 5


def _replay_segment_loop(t, bits, full, limit, mask, t0, starts):
    m = len(t)
    rounds = [0] * m
    kept = [False] * m
    for i in range(m):
        if mask and t[i] - t0 > limit:
            mask = 0  # the open group expired: discarded
        if not mask:
            t0 = t[i]
            starts += 1
        rounds[i] = starts - 1
        b = bits[i]
        if mask & b:
            continue
        kept[i] = True
        mask |= b
        if mask == full:
            mask = 0
    return rounds, kept, mask, t0, starts


def _sets(masks, n):
    """Bit masks as rows of booleans, one for each source."""
    import numpy as np

    return np.array([[bool(x >> s & 1) for s in range(n)] for x in masks]).reshape(-1, n)


def _mask(has):
    return sum(1 << s for s, x in enumerate(has) if x)


def test_vectorised_timeout_replay_equals_loop():
    """The numpy segment replay and the plain loop agree on random segments."""
    import numpy as np

    from jobframe.operators.merge import _replay_batch

    rnd = random.Random(7)
    for _ in range(1500):
        n = rnd.choice([1, 2, 3])
        m = rnd.randint(1, 120)
        t = np.cumsum([rnd.choice([0, 1, 2, 5, 30]) for _ in range(m)]).astype(np.int64) + 1000
        bits = np.array([1 << rnd.randrange(n) for _ in range(m)], dtype=np.int64)
        limit = rnd.choice([1, 5, 20, 100])
        full = (1 << n) - 1
        mask = rnd.randrange(full) if rnd.random() < 0.6 else 0
        t0 = int(t[0]) - rnd.randint(0, 40) if mask else -1
        starts = rnd.randint(0, 5) + (1 if mask else 0)
        a = _replay_segment_loop(t.tolist(), bits.tolist(), full, limit, mask, t0, starts)
        one = lambda x: np.array([x], dtype=np.int64)
        rounds, kept, out = _replay_batch(t, np.log2(bits).astype(int), one(0), n, limit, _sets([mask], n), one(t0), one(starts))
        assert list(a[0]) == list(rounds) and list(a[1]) == list(kept)
        assert (a[2], a[4]) == (_mask(out[0]), out[2])
        if a[2]:
            assert a[3] == out[1]  # the open group's start time (unused when nothing is open)

    # many segments at once, one of them open from the batch before
    for _ in range(300):
        n = rnd.choice([1, 2, 3])
        full, limit = (1 << n) - 1, rnd.choice([1, 5, 20, 100])
        parts = []
        for _ in range(rnd.randint(1, 12)):
            m = rnd.randint(1, 30)
            t = np.cumsum([rnd.choice([0, 1, 2, 5, 30]) for _ in range(m)]).astype(np.int64) + 1000
            mask = rnd.randrange(full) if rnd.random() < 0.4 else 0
            parts.append((t, np.array([1 << rnd.randrange(n) for _ in range(m)], dtype=np.int64), mask,
                          int(t[0]) - rnd.randint(0, 40) if mask else -1, rnd.randint(0, 5) + (1 if mask else 0)))
        want = [_replay_segment_loop(t.tolist(), b.tolist(), full, limit, x, t0, c) for t, b, x, t0, c in parts]
        seg_start = np.cumsum([0] + [len(p[0]) for p in parts[:-1]])
        has, t0, starts = zip(*(p[2:] for p in parts))
        sid = np.log2(np.concatenate([p[1] for p in parts])).astype(int)
        rounds, kept, out = _replay_batch(np.concatenate([p[0] for p in parts]), sid, seg_start, n, limit, _sets(has, n),
                                          np.array(t0), np.array(starts))
        assert rounds.tolist() == [r for w in want for r in w[0]] and kept.tolist() == [k for w in want for k in w[1]]
        mask, t0, starts = want[-1][2:]
        assert (_mask(out[0]), out[2]) == (mask, starts) and (not mask or out[1] == t0)


def test_summaries_equal_the_loop():
    """What a segment's summary does to a state is what its rows do, with and without a time limit."""
    import numpy as np

    from jobframe.operators import merge

    rnd = random.Random(11)
    names = [c.split()[0] for c in merge._SUMMARY.split(", ")]
    for _ in range(1500):
        n, m = rnd.choice([1, 2, 3, 5]), rnd.randint(1, 40)
        t = np.cumsum([rnd.choice([0, 1, 2, 5, 30]) for _ in range(m)]).astype(np.int64) + 1000
        sid = np.array([rnd.randrange(n) for _ in range(m)])
        limit = rnd.choice([1, 5, 20, 100, merge.NEVER])
        row = dict(zip(names, merge._summary(0, "k", t, sid, n, limit)))
        for _ in range(6):
            mask = rnd.randrange((1 << n) - 1) if rnd.random() < 0.8 else 0
            t0 = int(t[0]) - rnd.randint(0, 40) if mask else -1
            *_, want, want_t0, starts = _replay_segment_loop(t.tolist(), (1 << sid).tolist(), (1 << n) - 1, limit, mask, t0, 3)
            has, got_t0, got = merge._after_segment(row, _sets([mask], n)[0], t0, 3, limit)
            assert (_mask(has), got) == (want, starts) and (not want or got_t0 == want_t0)


def test_forty_sources_with_a_hot_key(spark):
    rnd = random.Random(4)
    sources = [f"s{i}" for i in range(40)]
    rows = [("hot" if rnd.random() < 0.7 else f"k{rnd.randint(0, 5)}", seq, rnd.choice(sources)) for seq in range(6000)]
    base = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame(
        [(k, s, src, f"id{s}", "{}", {}, base + dt.timedelta(seconds=s)) for k, s, src in rows],
        "correlation_key string, arrival_seq long, source string, id string, payload string, "
        "labels map<string,string>, arrival_ts timestamp")
    got = {r.arrival_seq: (r["round"], r.kept)
           for r in assign_rounds(df, sources, num_partitions=6).select("arrival_seq", "round", "kept").collect()}
    want = brute(rows, sources)
    assert got == want and max(r for r, _ in want.values()) > 5
    timed = assign_rounds_timeout(df, sources, 400, num_partitions=6)
    got = {r.arrival_seq: (r["round"], r.kept) for r in timed.select("arrival_seq", "round", "kept").collect()}
    assert got == brute_timeout([(k, s, src, s) for k, s, src in rows], sources, 400)
