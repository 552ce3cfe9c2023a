"""A disordered stream: every row comes out once, groups are those of the ordered rows."""

import datetime as dt
import json
import random
import time

from jobframe.streaming.disorder import merge_rounds_any_order
from jobframe.streaming.merge import OUTPUT_SCHEMA

BASE = dt.datetime(2024, 1, 1)
SCHEMA = "correlation_key string, source string, id string, payload string, arrival_ts timestamp, arrival_seq long"


def write(folder, name, rows):
    """rows: (key, source, second, seq)"""
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("".join(json.dumps(
        {"correlation_key": k, "source": s, "id": f"{k}-{n}", "payload": "{}", "arrival_ts": (BASE + dt.timedelta(seconds=t)).isoformat(),
         "arrival_seq": n}) + "\n" for k, s, t, n in rows))


def run(spark, folder, tmp_path, sources, timeout, delay, idle):
    """One batch of the new files; with a time limit by the clock, availableNow would never end."""
    jobs = spark.readStream.schema(SCHEMA).json(str(folder))
    merged, _ = merge_rounds_any_order(jobs, sources, timeout, delay, idle)
    q = (merged.writeStream.format("parquet").option("path", str(tmp_path / "out"))
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(once=True).start())
    q.awaitTermination(100)
    assert q.exception() is None
    return spark.read.schema(OUTPUT_SCHEMA).parquet(str(tmp_path / "out")).collect()


def brute(rows, sources, timeout, delay):
    """Status of every row, from chunks of rows in the order in which they come."""
    out = {}
    for key in {r[0] for c in rows for r in c}:
        latest = settled = None
        waiting, group = [], []

        def close(status):
            out[frozenset(r[3] for r in group)] = (key, status)
            group.clear()

        def fold(ready):
            for r in sorted(ready, key=lambda r: (r[2], r[3])):
                if group and r[2] - group[0][2] > timeout:
                    close("expired")
                if r[1] in [m[1] for m in group]:
                    out[frozenset([r[3]])] = (key, "duplicate")
                    continue
                group.append(r)
                if len(group) == len(sources):
                    close("complete")

        for chunk in rows:
            own = [r for r in chunk if r[0] == key]
            for r in own:
                if settled is not None and r[2] < settled:
                    out[frozenset([r[3]])] = (key, "late")
                else:
                    waiting.append(r)
                    latest = r[2] if latest is None else max(latest, r[2])
            if own and latest is not None:
                settled = latest - delay if settled is None else max(settled, latest - delay)
                fold([r for r in waiting if r[2] <= settled])
                waiting = [r for r in waiting if r[2] > settled]
        fold(waiting)
        if group:
            close("expired")
    return out


def test_no_row_of_a_disordered_stream_is_lost(spark, tmp_path):
    rnd = random.Random(3)
    sources, n, chunks = ["a", "b", "c"], 0, []
    for part in range(4):
        chunk = []
        for _ in range(60):
            late = rnd.choice([0, 0, 0, 5, 20, 200])
            chunk.append((rnd.choice(["hot", "hot", "k1", "k2"]), rnd.choice(sources), part * 100 + rnd.randrange(100) - late, n))
            n += 1
        chunks.append(chunk)
    folder = tmp_path / "in"
    for i, chunk in enumerate(chunks):  # stopped and started again for each: the state goes on
        write(folder, f"f{i}", chunk)
        got = run(spark, folder, tmp_path, sources, 30, 10, 3600)
    seen = [m["id"] for r in got for m in json.loads(r["members"])]
    assert len(seen) == len(set(seen))
    statuses = {r["status"] for r in got}
    assert {"complete", "expired", "late", "duplicate"} <= statuses
    want = {ids: v for ids, v in brute(chunks, sources, 30, 10).items()}
    have = {frozenset(int(i.rsplit("-", 1)[1]) for i in r["member_ids"].split(",")): (r["key"], r["status"]) for r in got}
    # groups still open and rows that still wait are in the state; all others are as the fold says
    assert have.items() <= want.items()
    left = {i for ids in want for i in ids} - {i for ids in have for i in ids}
    for key in ("hot", "k1", "k2"):
        latest = max(r[2] for c in chunks for r in c if r[0] == key)
        waits = [r for c in chunks for r in c if r[0] == key and r[3] in left and r[2] > latest - 10]
        assert len([r for c in chunks for r in c if r[0] == key and r[3] in left]) <= len(waits) + len(sources) - 1


def test_silent_key_is_settled_by_the_clock(spark, tmp_path):
    folder = tmp_path / "in"
    write(folder, "a", [("k", "a", 0, 0), ("k", "b", 1, 1), ("k", "a", 50, 2), ("x", "b", 3, 3)])
    got = run(spark, folder, tmp_path, ["a", "b"], 30, 10, 0.5)
    assert {(r["member_ids"], r["status"]) for r in got} == {("k-0,k-1", "complete")}
    time.sleep(1)
    write(folder, "b", [("y", "a", 0, 4)])
    got = run(spark, folder, tmp_path, ["a", "b"], 30, 10, 0.5)
    assert {("k-2", "expired"), ("x-3", "expired")} <= {(r["member_ids"], r["status"]) for r in got}
    write(folder, "c", [("k", "b", 20, 5), ("k", "b", 55, 6)])
    got = run(spark, folder, tmp_path, ["a", "b"], 30, 10, 0.5)
    assert ("k-5", "late") in {(r["member_ids"], r["status"]) for r in got}


def test_jobs_that_take_no_part(spark):
    df = spark.createDataFrame([("k", "a", "1", "{}", BASE, 1), (None, "a", "2", "{}", BASE, 2), ("k", "z", "3", "{}", BASE, 3),
                                ("k", "a", "4", "{}", None, 4)], SCHEMA)
    _, rest = merge_rounds_any_order(df, ["a", "b"], 30)  # a table here: the rejects need no state
    assert sorted(r["id"] for r in rest.collect()) == ["2", "3", "4"]
