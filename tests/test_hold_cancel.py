import datetime as dt
import random

import pytest

from jobframe.operators.cancel import apply_cancellations, live_signals, removed_ids
from jobframe.operators.hold import release_holds


def simulate(events):
    """Reference behaviour: one resume wakes one waiter; an unused resume is remembered once."""
    out = {}
    per = {}
    for p, ts, kind, jid in sorted(events, key=lambda e: (e[0], e[1], e[2], e[3] or "")):
        flag, queue = per.get(p, (False, []))
        if kind == 0:
            if flag:
                out[jid] = (ts, "flag")
                flag = False
            else:
                queue = queue + [jid]
        else:
            if queue:
                out[queue[0]] = (ts, "resume")
                queue = queue[1:]
            else:
                flag = True
        per[p] = (flag, queue)
    return out


@pytest.mark.parametrize("seed", [5, 6])
def test_release_matches_simulation(spark, seed):
    rnd = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    holds, resumes, events = [], [], []
    for i in range(400):
        p = rnd.choice(["p1", "p2"])
        ts = base + dt.timedelta(seconds=rnd.randint(0, 5000))
        if rnd.random() < 0.55:
            holds.append((f"h{i}", p, ts))
            events.append((p, ts, 0, f"h{i}"))
        else:
            resumes.append((p, ts))
            events.append((p, ts, 1, None))
    h = spark.createDataFrame(holds, "job_id string, pipeline_id string, hold_ts timestamp")
    r = spark.createDataFrame(resumes, "pipeline_id string, resume_ts timestamp")
    got = {row.job_id: (row.released_ts, row.released_by) for row in release_holds(h, r).collect()
           if row.released_ts is not None}
    assert got == simulate(events)


def test_cancel_ttl_edges(spark):
    base = dt.datetime(2024, 1, 1, 12, 0, 0)
    jobs = spark.createDataFrame([("a", base), ("b", base), ("c", base), ("d", base)], "id string, start_ts timestamp")
    sig = spark.createDataFrame([
        ("a", base - dt.timedelta(seconds=60)),      # exactly TTL old → cancelled
        ("b", base - dt.timedelta(seconds=61)),      # older than TTL → runs
        ("c", base + dt.timedelta(seconds=1)),       # after start → runs
    ], "job_id string, signal_ts timestamp")
    runnable, cancelled = apply_cancellations(jobs, sig, ttl_secs=60)
    assert {r.id for r in cancelled.collect()} == {"a"}
    assert {r.id for r in runnable.collect()} == {"b", "c", "d"}


def test_signal_consumed_by_completion(spark):
    base = dt.datetime(2024, 1, 1)
    sig = spark.createDataFrame([("a", base), ("b", base)], "job_id string, signal_ts timestamp")
    done = spark.createDataFrame([("a", base + dt.timedelta(seconds=5))], "job_id string, completed_ts timestamp")
    assert {r.job_id for r in live_signals(sig, done).collect()} == {"b"}


def test_empty_snapshot_cancels_everything(spark):
    prev = spark.createDataFrame([("f", "keep"), ("f", "rm")], "file string, id string")
    empty = spark.createDataFrame([], "file string, id string")
    cur = spark.createDataFrame([("f", "keep")], "file string, id string")
    assert {r.id for r in removed_ids(prev, cur).collect()} == {"rm"}
    assert {r.id for r in removed_ids(prev, empty).collect()} == {"keep", "rm"}


def test_release_with_one_hot_pipeline_across_partitions(spark):
    rnd = random.Random(9)
    base = dt.datetime(2024, 1, 1)
    holds, resumes, events = [], [], []
    for i in range(1500):
        ts = base + dt.timedelta(seconds=rnd.randint(0, 20000))
        if rnd.random() < 0.5:
            holds.append((f"h{i}", "hot", ts))
            events.append(("hot", ts, 0, f"h{i}"))
        else:
            resumes.append(("hot", ts))
            events.append(("hot", ts, 1, None))
    h = spark.createDataFrame(holds, "job_id string, pipeline_id string, hold_ts timestamp")
    r = spark.createDataFrame(resumes, "pipeline_id string, resume_ts timestamp")
    got = {row.job_id: (row.released_ts, row.released_by)
           for row in release_holds(h, r, num_partitions=8).collect() if row.released_ts is not None}
    assert got == simulate(events)
