"""Structured Streaming paths: foreachBatch pipeline, tail source, stateful merge."""

import datetime as dt
import json
import os
import time

from pyspark.sql import functions as F

from jobframe.plans.pipeline import run_pipeline
from jobframe.sources.tail import tail_jsonl
from jobframe.spec import ConditionStep, PipelineSpec, TransformStep
from jobframe.streaming.merge import merge_rounds_stream
from jobframe.streaming.runner import start_pipeline_stream

SPEC = PipelineSpec(id="s", payload_schema="v int", sinks=("out",), steps=(
    ConditionStep(id="gate", expr="job.payload.v > 1", action="emit"),
    TransformStep(id="t", expr="CAST(job.payload.v * 10 AS STRING)"),
))


def test_foreach_batch_pipeline_equals_batch(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    for i in range(3):
        (src / f"f{i}.jsonl").write_text("\n".join(json.dumps({"id": f"j{i}{k}", "v": k}) for k in range(4)) + "\n")
    lines = spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).text(str(src))
    jobs = lines.select(F.get_json_object("value", "$.id").alias("id"), F.lit("s").alias("source"),
                        F.col("value").alias("payload"), F.lit(None).cast("string").alias("correlation_key"),
                        F.create_map().cast("map<string,string>").alias("labels"))
    q = start_pipeline_stream(jobs, SPEC, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out" / "deliveries"))
    assert got.select("epoch").distinct().count() == 3
    batch = run_pipeline(spark.read.text(str(src)).select(
        F.get_json_object("value", "$.id").alias("id"), F.lit("s").alias("source"), F.col("value").alias("payload"),
        F.lit(None).cast("string").alias("correlation_key"), F.create_map().cast("map<string,string>").alias("labels")),
        SPEC)
    assert sorted(r.job_id + r.status for r in got.collect()) == sorted(r.id + r.status for r in batch.collect())


def test_tail_reads_appended_complete_lines_once(spark, tmp_path):
    d = tmp_path / "tail"
    d.mkdir()
    f = d / "a.jsonl"
    f.write_text('{"id":"one"}\n{"id":"two"}\n{"id":"par')
    jobs = tail_jsonl(spark, str(d), "tail")
    q = jobs.writeStream.format("memory").queryName("tail_out").option(
        "checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
        assert sorted(r.id for r in spark.table("tail_out").collect()) == ["one", "two"]
        with open(f, "a") as fh:
            fh.write('tial"}\nnot json\n{"id":"three"}\n')
        time.sleep(0.5)
        q.processAllAvailable()
        assert sorted(r.id for r in spark.table("tail_out").collect()) == ["one", "partial", "three", "two"]
    finally:
        q.stop()


def test_stream_merge_with_timeout(spark, tmp_path):
    src = tmp_path / "merge"
    src.mkdir()
    base = dt.datetime(2024, 1, 1, 0, 0, 0)
    # key k1: a@0 a@5 b@10 → (a@0,b@10); key k2: a@0, b@100 (timeout 60 → a expires, b opens)
    # key k3: b@0 only → expires when the watermark passes 60 s
    batches = [
        [("k1", "a", 0), ("k2", "a", 0), ("k3", "b", 0)],
        [("k1", "a", 5), ("k1", "b", 10)],
        [("k2", "b", 100), ("k9", "a", 400)],
    ]
    seq = 0
    for i, rows in enumerate(batches):
        recs = []
        for key, s, off in rows:
            recs.append(json.dumps({"correlation_key": key, "source": s, "id": f"{key}-{s}-{off}", "payload": "{}",
                                    "arrival_ts": (base + dt.timedelta(seconds=off)).isoformat(),
                                    "arrival_seq": seq}))
            seq += 1
        p = src / f"b{i}.json"
        p.write_text("\n".join(recs) + "\n")
        os.utime(p, (1_700_000_000 + i, 1_700_000_000 + i))
    jobs = (spark.readStream.schema("correlation_key string, source string, id string, payload string, "
                                    "arrival_ts timestamp, arrival_seq long")
            .option("maxFilesPerTrigger", 1).json(str(src)))
    out = merge_rounds_stream(jobs, ["a", "b"], 60, watermark="0 seconds")
    q = out.writeStream.format("memory").queryName("merge_out").outputMode("append").option(
        "checkpointLocation", str(tmp_path / "mck")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    from jobframe.streaming.monitor import dropped_by_watermark

    assert dropped_by_watermark(q) == 0  # files arrive in event-time order: nothing late
    rows = {(r.key, r.status, r.member_ids) for r in spark.table("merge_out").collect()}
    assert ("k1", "complete", "k1-a-0,k1-b-10") in rows
    assert ("k2", "expired", "k2-a-0") in rows
    assert ("k3", "expired", "k3-b-0") in rows
    assert not any(r[0] == "k1" and r[1] == "expired" for r in rows)


def test_stream_theta_merge_greedy_first_group(spark, tmp_path):
    from jobframe.streaming.merge import merge_theta_stream

    src = tmp_path / "theta"
    src.mkdir()
    base = dt.datetime(2024, 1, 1)
    # block k: a(q=5)@0, a(q=20)@1, b(q=10)@2 → b matches the first group whose member has q >= b.q: a(q=20)
    # b(q=1)@3 → first group a(q=5) matches; b(q=50)@4 → no match → new group (open until timeout)
    rows = [("k", "a", 5, 0), ("k", "a", 20, 1), ("k", "b", 10, 2), ("k", "b", 1, 3), ("k", "b", 50, 4),
            ("z", "a", 1, 500)]
    recs = [json.dumps({"blk": k, "source": s, "id": f"{s}{q}", "payload": json.dumps({"q": q}),
                        "arrival_ts": (base + dt.timedelta(seconds=o)).isoformat(), "arrival_seq": i})
            for i, (k, s, q, o) in enumerate(rows)]
    (src / "all.json").write_text("\n".join(recs) + "\n")
    jobs = spark.readStream.schema("blk string, source string, id string, payload string, "
                                   "arrival_ts timestamp, arrival_seq long").json(str(src))
    out = merge_theta_stream(jobs, ["a", "b"], lambda a, b: a["q"] >= b["q"], 60, "blk", watermark="0 seconds")
    q = out.writeStream.format("memory").queryName("theta_out").outputMode("append").option(
        "checkpointLocation", str(tmp_path / "tck")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    rows = {(r.key, r.status, r.member_ids) for r in spark.table("theta_out").collect()}
    assert ("k", "complete", "a20,b10") in rows
    assert ("k", "complete", "a5,b1") in rows


def test_stream_cancels_with_static_signals(spark, tmp_path):
    src = tmp_path / "csrc"
    src.mkdir()
    base = dt.datetime(2024, 1, 1, 12, 0, 0)
    recs = [json.dumps({"id": f"j{k}", "v": k, "arrival_ts": base.isoformat()}) for k in range(4)]
    (src / "a.jsonl").write_text("\n".join(recs) + "\n")
    lines = spark.readStream.schema("id string, v int, arrival_ts timestamp").json(str(src))
    jobs = lines.select("id", F.lit("s").alias("source"), F.to_json(F.struct("v")).alias("payload"),
                        F.lit(None).cast("string").alias("correlation_key"),
                        F.create_map().cast("map<string,string>").alias("labels"), "arrival_ts")
    signals = spark.createDataFrame([("j1", base - dt.timedelta(seconds=10)), ("j2", base - dt.timedelta(hours=2))],
                                    "job_id string, signal_ts timestamp")
    q = start_pipeline_stream(jobs, SPEC, str(tmp_path / "cout"), str(tmp_path / "cck"), signals=signals)
    q.awaitTermination(120)
    from jobframe.operators.state import latest_state, recover_incomplete

    cancelled = {r.id for r in spark.read.parquet(str(tmp_path / "cout" / "cancelled")).collect()}
    assert cancelled == {"j1"}            # j2's signal is older than the 1 h TTL
    view = latest_state(spark.read.parquet(str(tmp_path / "cout" / "state")).drop("epoch"))
    assert {(r.job_id, r.state) for r in view.collect()} == {
        ("j0", "success"), ("j1", "cancelled"), ("j2", "success"), ("j3", "success")}
    assert recover_incomplete(view).count() == 0


def test_tail_restarts_a_shrunk_file(spark, tmp_path):
    d = tmp_path / "shrink"
    d.mkdir()
    f = d / "a.jsonl"
    f.write_text('{"id":"one"}\n{"id":"two"}\n')
    q = tail_jsonl(spark, str(d), "tail").writeStream.format("memory").queryName("shrink_out").option(
        "checkpointLocation", str(tmp_path / "sk")).start()
    try:
        q.processAllAvailable()
        f.write_text('{"id":"new"}\n')  # truncated and rewritten: read again from byte 0
        time.sleep(0.5)
        q.processAllAvailable()
        assert sorted(r.id for r in spark.table("shrink_out").collect()) == ["new", "one", "two"]
    finally:
        q.stop()


def test_stream_merge_survives_a_late_row(spark, tmp_path):
    """A group opened behind the watermark (its deadline is past) expires instead of ending the stream."""
    import datetime as dt

    from jobframe.streaming.merge import merge_rounds_stream

    schema = "id string, source string, payload string, correlation_key string, arrival_ts timestamp, arrival_seq long"
    src = str(tmp_path / "in")
    for n, (h, m, s) in enumerate([(10, 0, 0), (12, 0, 0), (10, 0, 30), (12, 5, 0)]):
        row = (f"j{n}", "a", "{}", "k", dt.datetime(2024, 1, 1, h, m, s), n)
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        q = (merge_rounds_stream(stream, ["a", "b"], 60, watermark="1 minute").writeStream.format("parquet")
             .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck"))
             .trigger(availableNow=True).start())
        q.awaitTermination()
        assert q.exception() is None
    out = {r["member_ids"]: r["status"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert set(out.values()) == {"expired"} and {"j0", "j1"} <= set(out)
