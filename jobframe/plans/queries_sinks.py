"""Queries for dispatch and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobframe.functions.hmac import hmac_sql
from jobframe.functions.render import render_checked
from jobframe.operators.dispatch import deliveries
from jobframe.operators.sinks import queue_outbox, result_json, step_rows, webhook_outbox
from jobframe.plans.catalog import query, table
from jobframe.plans.pipeline import run_pipeline
from jobframe.plans.queries_steps import ORDER_SCHEMA, order_jobs
from jobframe.spec import ConditionStep, FailurePolicy, MapStep, PipelineSpec, Route, TransformStep

DISPATCH_SPEC = PipelineSpec(
    id="orders_dispatch",
    payload_schema=ORDER_SCHEMA,
    steps=(
        TransformStep(
            id="price", success_exit_codes=(0, 2),
            expr=("named_struct('stdout', CAST(job.payload.total AS STRING), 'exit_code', "
                  "CASE WHEN job.payload.status = 'P' THEN 2 ELSE 0 END, "
                  "'duration_ms', CAST(job.payload.total / 1000 AS BIGINT))"),
            routing=(Route("steps.price.exit_code = 0", ("ok_sink", "audit")),
                     Route("job.payload.total > 200000", ("big_sink",)),
                     Route("CAST(NULL AS BOOLEAN)", ("never",))),
        ),
        MapStep(id="tag", set=(("job.payload.x", "job.payload.total / 100"),), sinks=("tag_sink",)),
        ConditionStep(id="check", expr="job.payload.priority <> '5-LOW'", reason="low priority",
                      failure=FailurePolicy("dead_letter", "step_dlq")),
        TransformStep(id="finish", expr="'done'"),
    ),
    sinks=("all_sink", "disabled_sink"),
    failure=FailurePolicy("dead_letter", "dlq"),
)
ENABLED = {"ok_sink", "audit", "big_sink", "tag_sink", "all_sink", "dlq", "step_dlq"}


def dispatch_deliveries(spark, sf_dir, enabled=None):
    res = run_pipeline(order_jobs(spark, sf_dir), DISPATCH_SPEC)
    return deliveries(res, DISPATCH_SPEC, ENABLED if enabled is None else enabled)


DELIVERIES_SQL = """
WITH o AS (
  SELECT 'o-' AS pfx, o_orderkey, o_totalprice, o_orderstatus, o_orderpriority,
    CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 0 END AS price_exit,
    o_orderpriority = '5-LOW' AS failed
  FROM orders
), j AS (
  SELECT *, price_exit = 0 AS hit1, o_totalprice > 200000 AS hit2 FROM o
), d AS (
  SELECT o_orderkey, 'ok_sink' AS sink_id, 'route' AS scope, 'price' AS step_id,
         CASE WHEN price_exit = 0 THEN 'success' ELSE 'failure' END AS status, 'price' AS steps FROM j WHERE hit1
  UNION ALL
  SELECT o_orderkey, 'audit', 'route', 'price', CASE WHEN price_exit = 0 THEN 'success' ELSE 'failure' END, 'price'
  FROM j WHERE hit1
  UNION ALL
  SELECT o_orderkey, 'big_sink', 'route', 'price', CASE WHEN price_exit = 0 THEN 'success' ELSE 'failure' END, 'price'
  FROM j WHERE hit2
  UNION ALL
  SELECT o_orderkey, 'tag_sink', 'step', 'tag', 'success', 'tag' FROM j
  UNION ALL
  SELECT o_orderkey, 'all_sink', 'pipeline', NULL, CASE WHEN failed THEN 'failure' ELSE 'success' END,
         CASE WHEN hit1 OR hit2 THEN '' ELSE 'price,' END || CASE WHEN failed THEN 'check' ELSE 'check,finish' END
  FROM j
  UNION ALL
  SELECT o_orderkey, 'dlq', 'dead_letter', NULL, 'failure', 'price,tag,check' FROM j WHERE failed
  UNION ALL
  SELECT o_orderkey, 'step_dlq', 'step_dead_letter', 'check', 'failure', 'check' FROM j WHERE failed
)
SELECT o_orderkey, sink_id, scope, step_id, status, steps FROM d
"""


@query("deliveries_all", sql=DELIVERIES_SQL)
def deliveries_all(spark, sf_dir):
    d = dispatch_deliveries(spark, sf_dir)
    return d.select(F.get_json_object("payload", "$.order").cast("bigint").alias("o_orderkey"), "sink_id", "scope",
                    "step_id", "status", F.array_join("steps", ",").alias("steps"))


@query("dead_letters", sql="""
SELECT o_orderkey, sink_id, scope, step_id, status, steps FROM (""" + DELIVERIES_SQL + """) x
WHERE scope IN ('dead_letter', 'step_dead_letter')
""")
def dead_letters(spark, sf_dir):
    return deliveries_all(spark, sf_dir).where(F.col("scope").isin("dead_letter", "step_dead_letter"))


NOW = "2026-01-01T00:00:00Z"

#: The parts of every message over orders, as the library prints them.
MESSAGE_SQL = """
WITH p AS (
  SELECT *, '{"order":' || o_orderkey || ',"cust":' || o_custkey || ',"status":"' || o_orderstatus || '","total":'
      || CAST(o_totalprice AS VARCHAR) || ',"priority":"' || o_orderpriority || '"}' AS payload,
    CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 0 END AS price_exit, o_orderpriority = '5-LOW' AS failed,
    CAST(trunc(o_totalprice / 1000) AS BIGINT) AS ms
  FROM orders
), j AS (
  SELECT *, sha256(concat_ws('|', 'orders', CAST(o_orderkey AS VARCHAR), payload)) AS job_id,
    price_exit = 0 OR o_totalprice > 200000 AS handled,
    '{"stdout":"' || CAST(o_totalprice AS VARCHAR) || '","exit_code":' || price_exit || ',"duration_ms":' || ms
      || ',"attempt":1,"outputs":{}}' AS price_json,
    '{"exit_code":0,"duration_ms":0,"attempt":1,"outputs":{}}' AS tag_json,
    CASE WHEN failed THEN '{"stderr":"Pipeline error: low priority","exit_code":-1,"duration_ms":0,"attempt":0,"outputs":{}}'
         ELSE '{"exit_code":0,"duration_ms":0,"attempt":1,"outputs":{}}' END AS check_json,
    '{"stdout":"done","exit_code":0,"duration_ms":0,"attempt":1,"outputs":{}}' AS finish_json
  FROM p
), m AS (
  SELECT *, 'dlq' AS sink_id, 'failure' AS status, ms AS duration,
         '{"price":' || price_json || ',"tag":' || tag_json || ',"check":' || check_json || '}' AS steps FROM j WHERE failed
  UNION ALL
  SELECT *, 'step_dlq', 'failure', 0, '{"check":' || check_json || '}' FROM j WHERE failed
  UNION ALL
  SELECT *, 'big_sink', CASE WHEN price_exit = 0 THEN 'success' ELSE 'failure' END, ms, '{"price":' || price_json || '}'
  FROM j WHERE o_totalprice > 200000
  UNION ALL
  SELECT *, 'all_sink', CASE WHEN failed THEN 'failure' ELSE 'success' END, ms,
         '{' || CASE WHEN handled THEN '' ELSE '"price":' || price_json || ',' END || '"check":' || check_json
             || CASE WHEN failed THEN '' ELSE ',"finish":' || finish_json END || '}' FROM j
), b AS (
  SELECT o_orderkey, o_orderpriority, job_id, sink_id, status, duration,
         '{"pipeline_id":"orders_dispatch","job":{"id":"' || job_id || '","source":"orders","payload":' || payload
         || '},"status":"' || status || '","duration_ms":' || duration || ',"steps":' || steps
         || ',"occurred_at":"{NOW}"}' AS line
  FROM m
)
""".replace("{NOW}", NOW)


def _messages(spark, sf_dir, *sinks):
    d = dispatch_deliveries(spark, sf_dir, set(sinks))
    return d.withColumn("o_orderkey", F.get_json_object("payload", "$.order").cast("bigint"))


@query("step_rows", sql=MESSAGE_SQL + f"""
, s AS (
  SELECT j.*, 'price' AS step_id, price_exit AS exit_code, CAST(o_totalprice AS VARCHAR) AS stdout, '' AS stderr,
         ms AS duration_ms, 1 AS attempt FROM j WHERE NOT handled
  UNION ALL
  SELECT j.*, 'check', CASE WHEN failed THEN -1 ELSE 0 END, '',
         CASE WHEN failed THEN 'Pipeline error: low priority' ELSE '' END, 0, CASE WHEN failed THEN 0 ELSE 1 END
  FROM j
  UNION ALL
  SELECT j.*, 'finish', 0, 'done', '', 0, 1 FROM j WHERE NOT failed
)
SELECT sha256(concat_ws('|', job_id, 'orders_dispatch', 'all_sink', 'pipeline', step_id)) AS result_id, job_id,
       'orders_dispatch' AS pipeline_id, step_id, '{NOW}' AS occurred_at, exit_code, stdout, stderr,
       CAST(duration_ms AS BIGINT) AS duration_ms, attempt,
       CASE WHEN failed THEN 'failure' ELSE 'success' END AS status, o_orderkey
FROM s
""")
def step_rows_q(spark, sf_dir):
    rows = step_rows(_messages(spark, sf_dir, "all_sink"), NOW, sink="all_sink", keep=["o_orderkey"])
    return rows.drop("sink_id")


@query("result_lines", sql=MESSAGE_SQL + "SELECT o_orderkey, sink_id, line FROM b")
def result_lines(spark, sf_dir):
    """K6, K9: whole messages of the pipeline, of its dead letters and of single steps."""
    d = _messages(spark, sf_dir, "dlq", "step_dlq", "big_sink", "all_sink")
    return d.select("o_orderkey", "sink_id", result_json(d, NOW).alias("line"))


# ── K12 / K13 ────────────────────────────────────────────────────────────────

HOOK_SECRET = "hook-secret"


@query("webhook_outbox", sql=MESSAGE_SQL + f"""
SELECT o_orderkey, 'https://hooks.example/' || status || '/' || CAST(o_orderkey AS VARCHAR) AS url, line AS body,
  {hmac_sql('line', HOOK_SECRET)} AS signature, '250,500,1000,2000' AS retry_delays_ms,
  job_id || ' in ' || CAST(duration AS VARCHAR) AS header_job
FROM b WHERE sink_id = 'all_sink'
""")
def webhook_outbox_q(spark, sf_dir):
    """The body is the result; url and headers are rendered strictly from it."""
    d = _messages(spark, sf_dir, "all_sink")
    out = webhook_outbox(d, render_checked("https://hooks.example/{{ status }}/{{ o_orderkey }}", {})["text"],
                         result_json(d, NOW), HOOK_SECRET,
                         headers={"x-job": render_checked("{{ job_id }} in {{ duration_ms }}", {})["text"]})
    return out.select("o_orderkey", "url", "body", "signature",
                      F.array_join(F.transform("retry_delays_ms", lambda x: x.cast("string")), ",").alias("retry_delays_ms"),
                      F.col("headers")["x-job"].alias("header_job"))


@query("queue_outbox", sql=MESSAGE_SQL + """
SELECT o_orderkey, CASE WHEN status = 'success' THEN 'orders.ok.' || o_orderpriority ELSE 'orders.failed' END AS routing_key,
  line AS body
FROM b WHERE sink_id = 'big_sink'
""")
def queue_outbox_q(spark, sf_dir):
    d = _messages(spark, sf_dir, "big_sink")
    out = queue_outbox(d, result_json(d, NOW), F.concat(F.lit("orders.ok."), F.get_json_object("payload", "$.priority")),
                       F.lit("orders.failed"))
    return out.select("o_orderkey", "routing_key", "body")


# ── E3 ───────────────────────────────────────────────────────────────────────

TEMPLATE = "{{ c_name }} ({{ n_name }}) owes {{ round(c_acctbal, 2) }} in {{ segment }} at {{ now }}"


@query("render_strict", sql=f"""
SELECT c.c_custkey,
  c.c_name || ' (' || n.n_name || ') owes ' || CAST(round(c.c_acctbal, 2) AS VARCHAR) || ' in '
    || CASE WHEN c.c_acctbal < 0 THEN NULL ELSE c.c_mktsegment END || ' at {NOW}' AS rendered,
  CASE WHEN c.c_acctbal < 0 THEN 'Template render error: undefined value in template ''{TEMPLATE}''' END AS error
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
""")
def render_strict(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    j = c.join(n, c.c_nationkey == n.n_nationkey).withColumn(
        "segment", F.when(F.col("c_acctbal") < 0, F.lit(None)).otherwise(F.col("c_mktsegment")))
    r = render_checked(TEMPLATE, {"now": NOW})
    return j.select("c_custkey", r["text"].alias("rendered"), r["error"].alias("error"))
