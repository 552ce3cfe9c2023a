"""Queries for the core record path: envelope, DAG run and dispatch."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobframe.operators.dispatch import deliveries
from jobframe.operators.envelope import envelope
from jobframe.plans.catalog import query, table
from jobframe.operators.state import latest_state, recover_incomplete
from jobframe.plans.pipeline import run_pipeline
from jobframe.plans.service import run_batch
from jobframe.spec import (
    ConditionStep,
    FailurePolicy,
    MapStep,
    OutputField,
    Outputs,
    PipelineSpec,
    Route,
    TransformStep,
)


def event_jobs(spark, sf_dir):
    """events → jobs: payload = event columns + props.k, id from the string field ``event_key``."""
    ev = table(spark, sf_dir, "events")
    payload = F.to_json(F.struct(
        F.concat(F.lit("ev-"), F.col("event_id").cast("string")).alias("event_key"),
        F.col("event_id"), F.col("user_id"), F.col("event_type"), F.col("value"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    ))
    return envelope(ev, "events", payload, F.col("event_id"), id_field="event_key",
                    labels={"origin": "events"}, keep=["event_id", "user_id"])


FLAGSHIP = PipelineSpec(
    id="score",
    payload_schema="event_key string, event_id bigint, user_id bigint, event_type string, value double, k bigint",
    steps=(
        MapStep(id="tag", set=(
            ("job.payload.bucket",
             "CASE WHEN job.payload.k < 34 THEN 'low' WHEN job.payload.k < 67 THEN 'mid' ELSE 'high' END"),
            ("job.payload.meta.big", "job.payload.value >= 100"),
        )),
        ConditionStep(id="gate", expr="job.payload.value >= 100", action="emit"),
        TransformStep(
            id="score",
            expr=("named_struct('stdout', to_json(named_struct('k', job.payload.k, 'bucket', job.payload.bucket,"
                  " 'score', job.payload.k * 2)), 'exit_code',"
                  " CASE WHEN job.payload.event_type = 'error' THEN 3 ELSE 0 END)"),
            outputs=Outputs("json", (OutputField("score", "score"), OutputField("bucket", "bucket"))),
            routing=(Route("steps.score.exit_code = 0", ("ok_sink",)),),
        ),
    ),
    sinks=("all_sink",),
    failure=FailurePolicy("dead_letter", "dlq"),
)


def flagship(spark, sf_dir):
    jobs = event_jobs(spark, sf_dir)
    res = run_pipeline(jobs, FLAGSHIP)
    d = deliveries(res, FLAGSHIP)
    return d.select(
        "job_id", "sink_id", "scope", "step_id", "status",
        F.array_join("steps", ",").alias("steps"),
        F.col("step_results.score.outputs")["score"].alias("score_out"),
        F.col("step_results.score.outputs")["bucket"].alias("bucket_out"),
        F.col("step_results.score.exit_code").alias("score_exit"),
    )


query("flagship_events_pipeline", sql="""
WITH j AS (
  SELECT 'ev-' || CAST(event_id AS VARCHAR) AS job_id, event_type, value,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events
), r AS (
  SELECT *, CASE WHEN k < 34 THEN 'low' WHEN k < 67 THEN 'mid' ELSE 'high' END AS bucket,
         value >= 100 AS ran_score,
         value >= 100 AND event_type = 'error' AS failed
  FROM j
)
SELECT job_id, 'ok_sink' AS sink_id, 'route' AS scope, 'score' AS step_id, 'success' AS status,
       'score' AS steps, CAST(k * 2 AS VARCHAR) AS score_out, '"' || bucket || '"' AS bucket_out, 0 AS score_exit
FROM r WHERE ran_score AND NOT failed
UNION ALL
SELECT job_id, 'all_sink', 'pipeline', NULL, CASE WHEN failed THEN 'failure' ELSE 'success' END,
       CASE WHEN ran_score AND failed THEN 'tag,gate,score' ELSE 'tag,gate' END,
       CASE WHEN ran_score AND NOT failed THEN CAST(k * 2 AS VARCHAR) END,
       CASE WHEN ran_score AND NOT failed THEN '"' || bucket || '"' END,
       CASE WHEN ran_score THEN CASE WHEN failed THEN -1 ELSE 0 END END
FROM r
UNION ALL
SELECT job_id, 'dlq', 'dead_letter', NULL, 'failure', 'tag,gate,score', NULL, NULL, -1
FROM r WHERE failed
""")(flagship)


# ── §3.1 end to end: gate → fan-out → cancel → DAG → dispatch ────────────────

def _service_specs():
    from jobframe.spec import ConditionStep as C
    from jobframe.spec import PipelineSpec as P
    from jobframe.spec import Route as R
    from jobframe.spec import TransformStep as T

    schema = "event_key string, event_id bigint, user_id bigint, event_type string, value double, k bigint"
    clicks = P(id="p_clicks", payload_schema=schema, sources=("click", "view"), sinks=("click_sink",),
               labels=(("tier", "gold"),), steps=(
                   C(id="gate", expr="job.payload.k >= 50", action="emit"),
                   T(id="t", expr="concat(job.labels['tier'], ':', CAST(job.payload.k AS STRING))",
                     routing=(R("job.payload.value > 100", ("big_sink",)),)),
               ))
    money = P(id="p_money", payload_schema=schema, sources=("click", "purchase"), sinks=("money_sink",),
              failure=FailurePolicy("dead_letter", "money_dlq"), steps=(
                  C(id="check", expr="job.payload.value < 400", reason="too much"),
              ))
    return [clicks, money]


@query("service_run", sql="""
WITH j AS (
  SELECT 'ev-' || CAST(event_id AS VARCHAR) AS job_id, event_id, ts, user_id, event_type, value,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events
), c AS (
  SELECT j.*, EXISTS (SELECT 1 FROM events s WHERE s.event_type = 'error' AND s.event_id + 1 = j.event_id
                      AND s.ts <= j.ts AND s.ts >= j.ts - INTERVAL 3600 SECOND) AS cancelled
  FROM j
), clicks AS (SELECT * FROM c WHERE event_type IN ('click', 'view') AND NOT cancelled),
money AS (SELECT * FROM c WHERE event_type IN ('click', 'purchase') AND NOT cancelled)
SELECT 'p_clicks' AS pipeline_id, job_id, 'big_sink' AS sink_id, 'route' AS scope, 't' AS step_id,
       'success' AS status, 't' AS steps FROM clicks WHERE k >= 50 AND value > 100
UNION ALL
SELECT 'p_clicks', job_id, 'click_sink', 'pipeline', NULL, 'success',
       CASE WHEN k < 50 THEN 'gate' WHEN value > 100 THEN 'gate' ELSE 'gate,t' END FROM clicks
UNION ALL
SELECT 'p_money', job_id, 'money_sink', 'pipeline', NULL, CASE WHEN value < 400 THEN 'success' ELSE 'failure' END,
       'check' FROM money
UNION ALL
SELECT 'p_money', job_id, 'money_dlq', 'dead_letter', NULL, 'failure', 'check' FROM money WHERE value >= 400
""")
def service_run(spark, sf_dir):
    jobs, signals = _service_inputs(spark, sf_dir)
    d, _, _ = run_batch(jobs, _service_specs(), signals=signals, ttl_secs=3600)
    return d.select("pipeline_id", "job_id", "sink_id", "scope", "step_id", "status",
                    F.array_join("steps", ",").alias("steps"))


def _service_inputs(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    payload = F.to_json(F.struct(
        F.concat(F.lit("ev-"), F.col("event_id").cast("string")).alias("event_key"),
        F.col("event_id"), F.col("user_id"), F.col("event_type"), F.col("value"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k")))
    jobs = envelope(ev, F.col("event_type"), payload, F.col("event_id"), id_field="event_key",
                    keep=["ts"]).withColumnRenamed("ts", "arrival_ts")
    signals = ev.where(F.col("event_type") == "error").select(
        F.concat(F.lit("ev-"), (F.col("event_id") + 1).cast("string")).alias("job_id"),
        F.col("ts").alias("signal_ts"))
    return jobs, signals


# ── ST1–ST4, W7: the service's own log, cut by a crash, recovered and replayed ─

SLOW_SPEC = PipelineSpec(
    id="p_slow", payload_schema="event_id bigint, k bigint", sources=("click", "view"), sinks=("slow_sink",),
    steps=(TransformStep(id="t", expr=("named_struct('stdout', CAST(job.payload.k AS STRING), "
                                       "'duration_ms', job.payload.k * 600000)")),))


@query("service_replay", sql="""
WITH cut AS (SELECT max(ts) - INTERVAL 6 HOUR AS stop FROM events),
j AS (SELECT 'ev-' || CAST(event_id AS VARCHAR) AS job_id, event_id, ts, CAST(props->>'$.k' AS BIGINT) AS k,
             EXISTS (SELECT 1 FROM events s WHERE s.event_type = 'error' AND s.event_id + 1 = e.event_id
                     AND s.ts <= e.ts AND s.ts >= e.ts - INTERVAL 3600 SECOND) AS cancelled
      FROM events e WHERE event_type IN ('click', 'view'))
SELECT job_id, 'running' AS state, CAST(k AS VARCHAR) AS stdout, 'success' AS status
FROM j, cut WHERE NOT cancelled AND ts <= stop AND ts + to_milliseconds(k * 600000) > stop
""")
def service_replay(spark, sf_dir):
    """The log of a run as it stood six hours before the last event: jobs that had begun and not ended are found by
    the latest-state view and run again from what the log holds of them."""
    jobs, signals = _service_inputs(spark, sf_dir)
    _, log, _ = run_batch(jobs, [SLOW_SPEC], signals=signals, ttl_secs=3600)
    end = table(spark, sf_dir, "events").agg(F.max("ts")).first()[0]
    at = F.lit(end).cast("timestamp_ntz") - F.expr("INTERVAL 6 HOURS")
    left = recover_incomplete(latest_state(log.where(F.col("updated_at") <= at)))
    again = run_pipeline(left.withColumnRenamed("job_id", "id").drop("pipeline_id"), SLOW_SPEC)
    return again.select(F.col("id").alias("job_id"), "state", F.col("steps.t.stdout").alias("stdout"), "status")
