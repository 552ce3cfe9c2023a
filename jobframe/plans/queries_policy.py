"""Queries for policy precedence, retries, back-off and hold/resume."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobframe.operators.hold import release_holds
from jobframe.operators.policy import (
    backoff_ms,
    effective_jitter,
    max_attempts,
    resolve_attempts,
    step_task_global,
    unit_interval,
)
from jobframe.plans.catalog import query, table

GLOBAL_TIMEOUT = 600
GLOBAL_ATTEMPTS = 2
GLOBAL_JITTER = 0.1


@query("policy_resolve", sql=f"""
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey,
  coalesce(CASE WHEN p.p_size > 40 THEN p.p_size END, nullif(s.s_nationkey * 10, 0), {GLOBAL_TIMEOUT}) AS timeout_secs,
  greatest(coalesce(CASE WHEN p.p_size < 5 THEN 0 END, nullif(CASE WHEN s.s_acctbal > 5000 THEN 3 ELSE 0 END, 0),
                    {GLOBAL_ATTEMPTS}), 1) AS max_attempts,
  CASE WHEN (CASE WHEN p.p_retailprice > 1500 THEN 0.5 ELSE -1.0 END) BETWEEN 0 AND 1 THEN 0.5
       WHEN s.s_acctbal / 10000.0 BETWEEN 0 AND 1 THEN s.s_acctbal / 10000.0
       ELSE {GLOBAL_JITTER} END AS jitter
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
""")
def policy_resolve(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    # step policies come from parts, task policies from suppliers (both grow with the data:
    # ordinary shuffle joins, Catalyst/AQE pick the strategy)
    step = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        F.when(F.col("p_size") > 40, F.col("p_size")).alias("step_timeout"),
        F.when(F.col("p_size") < 5, F.lit(0)).alias("step_attempts"),
        F.when(F.col("p_retailprice") > 1500, F.lit(0.5)).otherwise(F.lit(-1.0)).alias("step_jitter"))
    task = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"),
        (F.col("s_nationkey") * 10).alias("task_timeout"),
        F.when(F.col("s_acctbal") > 5000, F.lit(3)).otherwise(F.lit(0)).alias("task_attempts"),
        (F.col("s_acctbal") / 10000.0).alias("task_jitter"))
    j = li.join(step, "l_partkey").join(task, "l_suppkey")
    return j.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        step_task_global(F.col("step_timeout"), F.col("task_timeout"), GLOBAL_TIMEOUT).alias("timeout_secs"),
        max_attempts(F.col("step_attempts"), F.col("task_attempts"), GLOBAL_ATTEMPTS).alias("max_attempts"),
        effective_jitter(F.col("step_jitter"), F.col("task_jitter"), GLOBAL_JITTER).alias("jitter"),
    )


@query("attempts_resolve", sql="""
SELECT l_orderkey,
  CASE WHEN min(l_linenumber) FILTER (WHERE l_returnflag = 'A' AND l_linenumber <= 3) IS NOT NULL
       THEN 'success' ELSE 'failure' END AS status,
  coalesce(min(l_linenumber) FILTER (WHERE l_returnflag = 'A' AND l_linenumber <= 3),
           max(l_linenumber) FILTER (WHERE l_returnflag <> 'A' AND l_linenumber <= 3)) AS attempt,
  CASE WHEN min(l_linenumber) FILTER (WHERE l_returnflag = 'A' AND l_linenumber <= 3) IS NULL
       THEN arg_max('exit ' || CAST(l_linenumber + 10 AS VARCHAR), l_linenumber)
              FILTER (WHERE l_returnflag <> 'A' AND l_linenumber <= 3) END AS error
FROM lineitem GROUP BY l_orderkey
""")
def attempts_resolve(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    attempts = li.select("l_orderkey", F.col("l_linenumber").alias("attempt"),
                         (F.col("l_returnflag") == "A").alias("success"),
                         F.concat(F.lit("exit "), (F.col("l_linenumber") + 10).cast("string")).alias("error"))
    return resolve_attempts(attempts, ["l_orderkey"], 3)


@query("backoff_schedule", sql="""
SELECT l_orderkey, l_linenumber AS attempt,
  CAST(floor(least(1000 * pow(2.0, l_linenumber - 1), 30000.0)
             * (1 - 0.2 * (CAST('0x' || substr(sha256(CAST(l_orderkey AS VARCHAR) || '#' || CAST(l_linenumber AS VARCHAR)), 1, 13) AS BIGINT)
                           / 4503599627370496.0))) AS BIGINT) AS delay_ms
FROM lineitem
""")
def backoff_schedule(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    u = unit_interval(F.col("l_orderkey"), F.col("l_linenumber"))
    return li.select("l_orderkey", F.col("l_linenumber").alias("attempt"),
                     backoff_ms(F.col("l_linenumber"), 1000, 30000, 0.2, u).alias("delay_ms"))


# ── F3 / F4 ──────────────────────────────────────────────────────────────────

def _resume_pipeline(v):
    return (F.when(v < 10, "1-URGENT").when(v < 25, "2-HIGH").when(v < 50, "3-MEDIUM")
            .when(v < 100, "4-NOT SPECIFIED").otherwise("5-LOW"))


@query("hold_release", sql="""
WITH h AS (
  SELECT o_orderpriority AS p, o_orderdate AS ts, 0 AS kind, CAST(o_orderkey AS VARCHAR) AS id, 1 AS d, o_orderkey
  FROM orders WHERE o_orderstatus = 'F'
), r AS (
  SELECT CASE WHEN value < 10 THEN '1-URGENT' WHEN value < 25 THEN '2-HIGH' WHEN value < 50 THEN '3-MEDIUM'
              WHEN value < 100 THEN '4-NOT SPECIFIED' ELSE '5-LOW' END AS p,
         make_timestamp(epoch_us(TIMESTAMP '1992-01-01') + (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) * 120) AS ts,
         1 AS kind, CAST(NULL AS VARCHAR) AS id, -1 AS d, NULL AS o_orderkey
  FROM events WHERE event_type = 'signup'
), ev AS (SELECT * FROM h UNION ALL SELECT * FROM r),
s AS (
  SELECT *, sum(d) OVER w AS s, sum(CASE WHEN kind = 0 THEN 1 ELSE 0 END) OVER w AS holds
  FROM ev WINDOW w AS (PARTITION BY p ORDER BY ts, kind, id ROWS UNBOUNDED PRECEDING)
), m AS (
  SELECT *, min(s) OVER (PARTITION BY p ORDER BY ts, kind, id ROWS UNBOUNDED PRECEDING) AS mn FROM s
), rel AS (
  SELECT *, holds - greatest(s - least(-1, mn) - 1, 0) AS released FROM m
), rel2 AS (
  SELECT *, coalesce(lag(released) OVER (PARTITION BY p ORDER BY ts, kind, id), 0) AS prev FROM rel
), fire AS (
  SELECT p, released AS n, ts AS released_ts, CASE WHEN kind = 0 THEN 'flag' ELSE 'resume' END AS released_by
  FROM rel2 WHERE released > prev
), hn AS (
  SELECT *, row_number() OVER (PARTITION BY p ORDER BY ts, id) AS n FROM h
)
SELECT hn.o_orderkey AS job_id, hn.p AS pipeline_id, hn.ts AS hold_ts, fire.released_ts, fire.released_by
FROM hn LEFT JOIN fire USING (p, n)
""")
def hold_release(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    holds = o.where(F.col("o_orderstatus") == "F").select(
        F.col("o_orderkey").alias("job_id"), F.col("o_orderpriority").alias("pipeline_id"),
        F.col("o_orderdate").alias("hold_ts"))
    ev = table(spark, sf_dir, "events")
    shifted = F.timestamp_micros(F.unix_micros(F.lit("1992-01-01 00:00:00").cast("timestamp")) +
                                 (F.unix_micros(F.col("ts").cast("timestamp")) -
                                  F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))) * 120)
    resumes = ev.where(F.col("event_type") == "signup").select(
        _resume_pipeline(F.col("value")).alias("pipeline_id"), shifted.cast("timestamp_ntz").alias("resume_ts"))
    out = release_holds(holds, resumes)
    return out.select("job_id", "pipeline_id", "hold_ts", "released_ts", "released_by")
