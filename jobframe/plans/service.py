"""One batch of the whole record path, composed from the operators:

global size gate (A2) → cancellation by signals (C4) → fan-out with label overlay
(J1, P3) → merge per pipeline (J2–J9) → compiled DAG (D-1…) → dispatch (K1–K8).

Returns (deliveries, state events, rejects). All outputs are DataFrames; a
stream runs the same function inside ``foreachBatch``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobframe.operators.cancel import mark_cancellations
from jobframe.operators.dispatch import deliveries, run_duration
from jobframe.operators.fanout import fan_out, route_table, unrouted
from jobframe.operators.merge import merge_for_pipeline
from jobframe.operators.state import run_events
from jobframe.plans.pipeline import run_pipeline
from jobframe.session import checkpoint_dir
from jobframe.spec import DEFAULT_CANCEL_TTL_SECS, DEFAULT_GLOBAL_MAX_PAYLOAD_BYTES, PipelineSpec

DELIVERY_COLS = ["pipeline_id", "job_id", "sink_id", "scope", "step_id", "status", "steps"]


def run_batch(jobs: DataFrame, pipelines: list[PipelineSpec], signals: DataFrame | None = None,
              start_col: str = "arrival_ts", ttl_secs: int = DEFAULT_CANCEL_TTL_SECS,
              global_max_bytes: int = DEFAULT_GLOBAL_MAX_PAYLOAD_BYTES,
              enabled_sinks: set[str] | None = None):
    """The source is read once whatever the number of pipelines: jobs are gated, marked as cancelled (a signal hits
    every pipeline of a job) and fanned out once, into a table in the shared folder with a partition for each
    pipeline; each pipeline then reads its own partition."""
    spark = jobs.sparkSession
    too_big = F.octet_length("payload") > global_max_bytes
    rejects = [jobs.where(too_big).select("id", "source", F.lit("payload exceeds max_payload_bytes").alias("reason"))]
    jobs = jobs.where(~F.coalesce(too_big, F.lit(False)))
    routes = route_table(spark, pipelines)
    rejects.append(unrouted(jobs, routes).select("id", "source", F.lit("no pipeline consumes the source")
                                                .alias("reason")))
    jobs = _mark(jobs, signals, start_col, ttl_secs)
    path = f"{checkpoint_dir(spark).rstrip('/')}/service/{uuid.uuid4().hex}"
    fan_out(jobs, routes).write.partitionBy("pipeline_id").parquet(path)
    routed = spark.read.parquet(path)
    out_deliveries, out_state = [], []
    for spec in pipelines:
        mine = routed.where(F.col("pipeline_id") == spec.id).drop("pipeline_id")
        if spec.merge is not None and len(spec.sources) > 1:  # a merged job has an id, and signals, of its own
            mine, merge_rejects = merge_for_pipeline(mine.drop("cancelled"), spec, order=(start_col, "id")
                                                     if "arrival_seq" not in mine.columns else (start_col, "arrival_seq"))
            rejects.append(merge_rejects)
            mine = _mark(mine, signals, start_col, ttl_secs)
        runnable = mine.where(~F.col("cancelled")).drop("cancelled")
        res = run_pipeline(runnable, spec)
        out_state.append(run_events(mine, spec.id, start_col, mine.where("cancelled"), res, run_duration(spec, "steps")))
        out_deliveries.append(deliveries(res, spec, enabled_sinks).select(*DELIVERY_COLS))
    return _union(out_deliveries), _union(out_state), _union(rejects)


def _mark(jobs: DataFrame, signals: DataFrame | None, start_col: str, ttl_secs: int) -> DataFrame:
    if signals is None:
        return jobs.withColumn("cancelled", F.lit(False))
    return mark_cancellations(jobs, signals, ttl_secs, start_col=start_col)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
