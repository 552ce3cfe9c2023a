"""Queries for DAG and step semantics (P4, P5, A7–A12, D-1…D-4, T1–T6, T8, F1, F2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobframe.operators.dispatch import deliveries
from jobframe.operators.envelope import envelope
from jobframe.plans.catalog import query, table
from jobframe.plans.pipeline import run_pipeline
from jobframe.spec import ConditionStep, FailurePolicy, MapStep, OutputField, Outputs, PipelineSpec, Route, TransformStep

ORDER_SCHEMA = "order bigint, cust bigint, status string, total double, priority string, x double"
LINE_SCHEMA = "order bigint, line int, qty double, price double, disc double, flag string, status string"


def ran_steps(spec: PipelineSpec) -> Column:
    """Comma-joined ids of the steps that ran, in declared order."""
    return F.array_join(F.filter(F.array(*[F.when(F.col("steps")[s.id].isNotNull(), F.lit(s.id))
                                           for s in spec.steps]), lambda x: x.isNotNull()), ",")


def order_jobs(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    st = F.struct(F.col("o_orderkey").alias("order"), F.col("o_custkey").alias("cust"),
                  F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"),
                  F.col("o_orderpriority").alias("priority"))
    return envelope(o, "orders", F.to_json(st), F.col("o_orderkey"), id_field=None, keep=["o_orderkey"],
                    payload_struct=st)


def line_jobs(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    st = F.struct(F.col("l_orderkey").alias("order"), F.col("l_linenumber").alias("line"),
                  F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"),
                  F.col("l_discount").alias("disc"), F.col("l_returnflag").alias("flag"),
                  F.col("l_linestatus").alias("status"))
    # ordinal = the natural key (stable under task retries, unlike a post-shuffle row id);
    # identical duplicate records get the same content-derived id
    return envelope(li, "lines", F.to_json(st), F.concat_ws(":", "l_orderkey", "l_linenumber"), id_field=None,
                    keep=["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag",
                          "l_linestatus"], payload_struct=st)


# ── P4 / P5 / D-3 ────────────────────────────────────────────────────────────

MAP_SPEC = PipelineSpec(
    id="map_nested",
    payload_schema=ORDER_SCHEMA,
    steps=(
        MapStep(id="m1", depends_on=(), set=(
            ("job.payload.status", "lower(job.payload.status)"),
            ("job.payload.meta.rank", "CAST(substring(job.payload.priority, 1, 1) AS INT)"),
        )),
        MapStep(id="m2", depends_on=(), set=(
            ("job.payload.status", "concat(job.payload.status, '!')"),
            ("job.payload.a.b.c", "job.payload.total"),
        )),
        MapStep(id="m3", depends_on=("m1", "m2"), set=(
            ("job.payload.x", "job.payload.total * 2"),
            ("job.payload.y", "coalesce(job.payload.x, -1)"),  # reads the step's entry: x is not set yet
            ("job.payload.meta.tag", "concat(job.payload.status, '#', CAST(job.payload.meta.rank AS STRING))"),
        )),
    ),
)


@query("map_nested", sql="""
SELECT o_orderkey, o_orderstatus || '!' AS status_out,
       CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS rank, o_totalprice AS abc,
       o_totalprice * 2 AS x, CAST(-1 AS DOUBLE) AS y,
       o_orderstatus || '!#' || substr(o_orderpriority, 1, 1) AS tag, 'm1,m2,m3' AS ran
FROM orders
""")
def map_nested(spark, sf_dir):
    res = run_pipeline(order_jobs(spark, sf_dir), MAP_SPEC)
    w = F.col("work_payload")
    return res.select(
        "o_orderkey",
        F.get_json_object(w, "$.status").alias("status_out"),
        F.get_json_object(w, "$.meta.rank").cast("int").alias("rank"),
        F.get_json_object(w, "$.a.b.c").cast("double").alias("abc"),
        F.get_json_object(w, "$.x").cast("double").alias("x"),
        F.get_json_object(w, "$.y").cast("double").alias("y"),
        F.get_json_object(w, "$.meta.tag").alias("tag"),
        ran_steps(MAP_SPEC).alias("ran"),
    )


# ── A8 / F1 / F2 ─────────────────────────────────────────────────────────────

FAIL_SPEC = PipelineSpec(
    id="condition_fail",
    payload_schema=ORDER_SCHEMA,
    steps=(
        MapStep(id="root", set=(("job.payload.x", "job.payload.total / 1000"),)),
        ConditionStep(id="check", depends_on=("root",), expr="job.payload.total > 100000"),
        ConditionStep(id="check2", depends_on=("root",), expr="job.payload.status <> 'P'", reason="pending order",
                      failure=FailurePolicy("stop")),
        TransformStep(id="side", depends_on=("root",), expr="concat('order ', CAST(job.payload.order AS STRING))"),
        MapStep(id="after", depends_on=("check", "check2", "side"), set=(("job.payload.y", "1"),)),
    ),
)


@query("condition_fail", sql="""
SELECT o_orderkey,
  CASE WHEN o_totalprice > 100000 AND o_orderstatus <> 'P' THEN 'success' ELSE 'failure' END AS status,
  CASE WHEN o_totalprice > 100000 THEN 0 ELSE -1 END AS check_exit,
  CASE WHEN o_totalprice > 100000 THEN NULL
       ELSE 'Pipeline error: Condition ''job.payload.total > 100000'' evaluated to false' END AS check_stderr,
  CASE WHEN o_orderstatus <> 'P' THEN NULL ELSE 'Pipeline error: pending order' END AS check2_stderr,
  'order ' || CAST(o_orderkey AS VARCHAR) AS side_stdout, 0 AS side_exit,
  CASE WHEN o_totalprice > 100000 AND o_orderstatus <> 'P' THEN 'root,check,check2,side,after'
       ELSE 'root,check,check2,side' END AS ran,
  o_orderstatus = 'P' AS held
FROM orders
""")
def condition_fail(spark, sf_dir):
    res = run_pipeline(order_jobs(spark, sf_dir), FAIL_SPEC)
    s = F.col("steps")
    return res.select("o_orderkey", "status", s["check"]["exit_code"].alias("check_exit"),
                      s["check"]["stderr"].alias("check_stderr"), s["check2"]["stderr"].alias("check2_stderr"),
                      s["side"]["stdout"].alias("side_stdout"), s["side"]["exit_code"].alias("side_exit"),
                      ran_steps(FAIL_SPEC).alias("ran"), "held")


# ── A9 / D-4 ─────────────────────────────────────────────────────────────────

SKIP_SPEC = PipelineSpec(
    id="condition_skip_to",
    payload_schema=LINE_SCHEMA + ", qty2 double",
    steps=(
        ConditionStep(id="check", expr="job.payload.flag <> 'R'", action="skip_to", skip_to="final"),
        MapStep(id="a", set=(("job.payload.qty2", "job.payload.qty * 2"),)),
        MapStep(id="b", set=(("job.payload.big", "job.payload.qty2 > 50"),)),
        TransformStep(id="final", expr=("concat('flag=', job.payload.flag, ';qty2=', "
                                        "coalesce(CAST(job.payload.qty2 AS STRING), 'none'))")),
        ConditionStep(id="back", expr="job.payload.qty > 10", action="skip_to", skip_to="a"),
        MapStep(id="last", set=(("job.payload.done", "true"),)),
    ),
)


@query("condition_skip_to", sql="""
SELECT l_orderkey, l_linenumber,
  CASE WHEN l_returnflag = 'R' THEN 'skipped_to: final' END AS check_stdout,
  CASE WHEN l_returnflag = 'R' THEN 'flag=R;qty2=none'
       ELSE 'flag=' || l_returnflag || ';qty2=' || CAST(l_quantity * 2 AS VARCHAR) END AS final_stdout,
  CASE WHEN l_quantity > 10 THEN NULL ELSE 'skipped_to: a' END AS back_stdout,
  CASE WHEN l_returnflag = 'R' THEN 'check,final,back,last' ELSE 'check,a,b,final,back,last' END AS ran,
  'success' AS status
FROM lineitem
""")
def condition_skip_to(spark, sf_dir):
    res = run_pipeline(line_jobs(spark, sf_dir), SKIP_SPEC)
    s = F.col("steps")
    return res.select("l_orderkey", "l_linenumber", s["check"]["stdout"].alias("check_stdout"),
                      s["final"]["stdout"].alias("final_stdout"), s["back"]["stdout"].alias("back_stdout"),
                      ran_steps(SKIP_SPEC).alias("ran"), "status")


# ── A10 / A11 / A12 ──────────────────────────────────────────────────────────

PREC_SPEC = PipelineSpec(
    id="signal_precedence",
    payload_schema=LINE_SCHEMA,
    steps=(
        MapStep(id="root", set=(("job.payload.seen", "true"),)),
        ConditionStep(id="c_emit", depends_on=("root",), expr="job.payload.qty < 45", action="emit"),
        ConditionStep(id="c_skip1", depends_on=("root",), expr="job.payload.disc < 0.08", action="skip_to",
                      skip_to="tail"),
        ConditionStep(id="c_skip2", depends_on=("root",), expr="job.payload.status = 'O'", action="skip_to",
                      skip_to="late"),
        ConditionStep(id="c_fail", depends_on=("root",), expr="job.payload.qty > 2", reason="tiny quantity"),
        ConditionStep(id="c_null", depends_on=("root",),
                      expr="CASE WHEN job.payload.flag = 'N' AND job.payload.qty = 1 THEN NULL ELSE true END"),
        MapStep(id="mid", depends_on=("c_emit", "c_skip1", "c_skip2", "c_fail", "c_null"), set=(("job.payload.m", "1"),)),
        MapStep(id="late", depends_on=("mid",), set=(("job.payload.l", "1"),)),
        MapStep(id="tail", depends_on=("late",), set=(("job.payload.t", "1"),)),
    ),
)


@query("signal_precedence", sql="""
WITH f AS (
  SELECT l_orderkey, l_linenumber,
    l_quantity <= 2 OR (l_returnflag = 'N' AND l_quantity = 1) AS failed,
    l_quantity >= 45 AS emit, l_linestatus <> 'O' AS s2, l_discount >= 0.08 AS s1
  FROM lineitem)
SELECT l_orderkey, l_linenumber,
  CASE WHEN failed THEN 'failure' ELSE 'success' END AS status,
  CASE WHEN failed OR emit THEN 'root,c_emit,c_skip1,c_skip2,c_fail,c_null'
       WHEN s2 THEN 'root,c_emit,c_skip1,c_skip2,c_fail,c_null,late,tail'
       WHEN s1 THEN 'root,c_emit,c_skip1,c_skip2,c_fail,c_null,tail'
       ELSE 'root,c_emit,c_skip1,c_skip2,c_fail,c_null,mid,late,tail' END AS ran
FROM f
""")
def signal_precedence(spark, sf_dir):
    res = run_pipeline(line_jobs(spark, sf_dir), PREC_SPEC)
    return res.select("l_orderkey", "l_linenumber", "status", ran_steps(PREC_SPEC).alias("ran"))


EMIT_SPEC = PipelineSpec(
    id="condition_emit",
    payload_schema=ORDER_SCHEMA,
    steps=(
        ConditionStep(id="gate", expr="job.payload.status = 'O'", action="emit"),
        TransformStep(id="work", expr="upper(job.payload.priority)"),
    ),
)


@query("condition_emit", sql="""
SELECT o_orderkey, 'success' AS status,
  CASE WHEN o_orderstatus = 'O' THEN NULL ELSE 'emitted' END AS gate_stdout,
  CASE WHEN o_orderstatus = 'O' THEN upper(o_orderpriority) END AS work_stdout,
  CASE WHEN o_orderstatus = 'O' THEN 'gate,work' ELSE 'gate' END AS ran
FROM orders
""")
def condition_emit(spark, sf_dir):
    res = run_pipeline(order_jobs(spark, sf_dir), EMIT_SPEC)
    s = F.col("steps")
    return res.select("o_orderkey", "status", s["gate"]["stdout"].alias("gate_stdout"),
                      s["work"]["stdout"].alias("work_stdout"), ran_steps(EMIT_SPEC).alias("ran"))


# ── A12 / P4 / D-1 / E2: errors of single records ────────────────────────────

MAP_ERR_SPEC = PipelineSpec(
    id="map_errors",
    payload_schema=LINE_SCHEMA,
    steps=(
        MapStep(id="ratio", set=(("job.payload.ratio", "job.payload.qty / job.payload.disc"),
                                 ("job.payload.code", "CAST(concat('1', job.payload.flag) AS INT)"))),
        MapStep(id="after", set=(("job.payload.seen", "true"),)),
    ),
)


@query("map_errors", sql="""
SELECT l_orderkey, l_linenumber, 'failure' AS status, -1 AS ratio_exit,
  CASE WHEN l_discount = 0 THEN 'Expression evaluation error: ''job.payload.qty / job.payload.disc'' has no value'
       ELSE 'Expression evaluation error: ''CAST(concat(''1'', job.payload.flag) AS INT)'' has no value' END AS ratio_error,
  'ratio' AS ran
FROM lineitem
""")
def map_errors(spark, sf_dir):
    """Zero divisors and a cast that never works: each fails its step (F1), none the job."""
    res = run_pipeline(line_jobs(spark, sf_dir), MAP_ERR_SPEC)
    s = F.col("steps")["ratio"]
    return res.select("l_orderkey", "l_linenumber", "status", s["exit_code"].alias("ratio_exit"),
                      s["stderr"].alias("ratio_error"), ran_steps(MAP_ERR_SPEC).alias("ran"))


COND_ERR_SPEC = PipelineSpec(
    id="condition_errors",
    payload_schema=LINE_SCHEMA,
    steps=(
        ConditionStep(id="gate", expr="job.payload.disc <> 0 OR job.payload.line % 2 = 0", action="emit"),
        ConditionStep(id="share", expr="job.payload.qty / job.payload.disc > 100"),
        MapStep(id="mark", set=(("job.payload.ratio", "job.payload.qty / job.payload.disc"),)),
    ),
)


@query("condition_errors", sql="""
SELECT l_orderkey, l_linenumber,
  CASE WHEN l_discount = 0 AND l_linenumber % 2 <> 0 THEN 'success'
       WHEN l_discount = 0 OR NOT l_quantity / l_discount > 100 THEN 'failure' ELSE 'success' END AS status,
  CASE WHEN l_discount = 0 AND l_linenumber % 2 <> 0 THEN NULL
       WHEN l_discount = 0 THEN 'Expression evaluation error: Condition ''job.payload.qty / job.payload.disc > 100'' did not evaluate to a boolean'
       WHEN NOT l_quantity / l_discount > 100 THEN 'Pipeline error: Condition ''job.payload.qty / job.payload.disc > 100'' evaluated to false'
  END AS share_error,
  CASE WHEN l_discount = 0 AND l_linenumber % 2 <> 0 THEN 'gate'
       WHEN l_discount = 0 OR NOT l_quantity / l_discount > 100 THEN 'gate,share' ELSE 'gate,share,mark' END AS ran
FROM lineitem
""")
def condition_errors(spark, sf_dir):
    """A gate keeps half of the zero divisors away (their later steps never run); the others fail their step."""
    res = run_pipeline(line_jobs(spark, sf_dir), COND_ERR_SPEC)
    return res.select("l_orderkey", "l_linenumber", "status", F.col("steps")["share"]["stderr"].alias("share_error"),
                      ran_steps(COND_ERR_SPEC).alias("ran"))


ROUTE_ERR_SPEC = PipelineSpec(
    id="route_errors",
    payload_schema=LINE_SCHEMA,
    sinks=("rest",),
    steps=(
        TransformStep(id="say", expr="job.payload.flag", routing=(
            Route("job.payload.qty / job.payload.disc > 500", ("high",)),
            Route("job.payload.line / job.payload.disc > 20", ("first", "second")),
        )),
    ),
)


@query("route_errors", sql="""
WITH l AS (SELECT l_orderkey, l_linenumber, l_discount <> 0 AND l_quantity / nullif(l_discount, 0) > 500 AS a,
                  l_discount <> 0 AND l_linenumber / nullif(l_discount, 0) > 20 AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, 'high' AS sink_id, 'route' AS scope FROM l WHERE a
UNION ALL SELECT l_orderkey, l_linenumber, unnest(['first', 'second']), 'route' FROM l WHERE b
UNION ALL SELECT l_orderkey, l_linenumber, 'rest', 'pipeline' FROM l WHERE NOT coalesce(a, false) AND NOT coalesce(b, false)
""")
def route_errors(spark, sf_dir):
    """A rule that divides by zero does not match; the step then goes to the pipeline's sink."""
    jobs = line_jobs(spark, sf_dir)
    out = deliveries(run_pipeline(jobs, ROUTE_ERR_SPEC), ROUTE_ERR_SPEC)
    p = F.col("payload")
    return out.select(F.get_json_object(p, "$.order").cast("bigint").alias("l_orderkey"),
                      F.get_json_object(p, "$.line").cast("int").alias("l_linenumber"), "sink_id", "scope")


# ── E1, E4–E7, P7, D-2 ───────────────────────────────────────────────────────

EXPR_SPEC = PipelineSpec(
    id="expressions",
    payload_schema="name string, segment string, balance double, nation int, since string",
    sinks=("rest",),
    steps=(  # no depends_on: each step follows the one declared before it
        MapStep(id="e", set=(
            ("job.payload.cmp", "job.payload.balance >= 0 AND NOT (job.payload.nation IN (1, 2) OR job.payload.nation > 20)"),
            ("job.payload.text", "concat(upper(substring(job.payload.name, 1, 4)), '-', trim(replace(job.payload.name, 'Customer', ' '))"
                                 ", '-', CAST(length(job.payload.segment) AS STRING))"),
            ("job.payload.has", "contains(job.payload.segment, 'IN') OR startswith(job.payload.segment, 'H')"
                                " OR job.payload.segment RLIKE '^A.*E$'"),
            ("job.payload.list", "array_join(transform(filter(sequence(1, 5), x -> x <> job.payload.nation % 5), x -> x * 2), '+')"),
            ("job.payload.many", "size(split(job.payload.segment, 'I')) + CAST(exists(array(1, 2, 3), x -> x = job.payload.nation) AS INT)"),
            ("job.payload.conv", "CAST(CAST(job.payload.balance AS BIGINT) AS STRING)"),
            ("job.payload.day", "date_format(CAST(job.payload.since AS TIMESTAMP) + INTERVAL 36 HOURS, 'yyyy-MM-dd HH')"),
            ("job.payload.segment", "lower(job.payload.segment)"))),
        TransformStep(id="t", expr="concat(pipeline.id, ':', job.source, ':', job.payload.segment, ':', "
                                   "CAST(steps.e.exit_code AS STRING))",
                      routing=(Route("job.payload.segment = 'BUILDING' AND steps.t.exit_code = 0", ("upper",)),)),
    ),
)


def _customer_jobs(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    st = F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"),
                  F.col("c_nationkey").alias("nation"), F.lit("2024-02-28 23:30:00").alias("since"))
    return envelope(c, "customers", F.to_json(st), F.col("c_custkey"), id_field=None, keep=["c_custkey"])


@query("expressions", sql="""
SELECT c_custkey, c_acctbal >= 0 AND NOT (c_nationkey IN (1, 2) OR c_nationkey > 20) AS cmp,
  upper(substr(c_name, 1, 4)) || '-' || trim(replace(c_name, 'Customer', ' ')) || '-' || length(c_mktsegment) AS text,
  contains(c_mktsegment, 'IN') OR starts_with(c_mktsegment, 'H') OR regexp_matches(c_mktsegment, '^A.*E$') AS has,
  array_to_string(list_transform(list_filter([1, 2, 3, 4, 5], lambda x: x <> c_nationkey % 5), lambda x: x * 2), '+') AS list,
  CAST(len(string_split(c_mktsegment, 'I')) + CASE WHEN c_nationkey IN (1, 2, 3) THEN 1 ELSE 0 END AS INTEGER) AS many,
  CAST(CAST(trunc(c_acctbal) AS BIGINT) AS VARCHAR) AS conv, '2024-03-01 11' AS day,
  'expressions:customers:' || lower(c_mktsegment) || ':0' AS said
FROM customer
""")
def expressions(spark, sf_dir):
    """Comparison and logic, strings, collections, conversions and time; the roots job, steps and pipeline."""
    res = run_pipeline(_customer_jobs(spark, sf_dir), EXPR_SPEC)
    get = lambda k: F.get_json_object("work_payload", f"$.{k}")
    return res.select("c_custkey", get("cmp").cast("boolean").alias("cmp"), get("text").alias("text"),
                      get("has").cast("boolean").alias("has"), get("list").alias("list"), get("many").cast("int").alias("many"),
                      get("conv").alias("conv"), get("day").alias("day"), F.col("steps.t.stdout").alias("said"))


@query("route_original", sql="""
SELECT c_name AS name, CASE WHEN c_mktsegment = 'BUILDING' THEN 'upper' ELSE 'rest' END AS sink_id,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 't' ELSE 'e,t' END AS steps
FROM customer
UNION ALL SELECT c_name, 'rest', 'e' FROM customer WHERE c_mktsegment = 'BUILDING'
""")
def route_original(spark, sf_dir):
    """Rules and sinks see the job as it came, though a map step has changed the field the rule reads."""
    d = deliveries(run_pipeline(_customer_jobs(spark, sf_dir), EXPR_SPEC), EXPR_SPEC)
    return d.select(F.get_json_object("payload", "$.name").alias("name"), "sink_id", F.array_join("steps", ",").alias("steps"))


# ── T3 / T4 ──────────────────────────────────────────────────────────────────

OUT_SPEC = PipelineSpec(
    id="outputs_json",
    payload_schema="event_type string, k bigint",
    steps=(
        TransformStep(
            id="emit",
            expr=("named_struct('stdout', CASE job.payload.event_type "
                  "WHEN 'click' THEN concat('{\"a\":{\"b\":', CAST(job.payload.k AS STRING), '},\"s\":\"x\"}') "
                  "WHEN 'view' THEN 'not json' WHEN 'signup' THEN '[1,2]' "
                  "WHEN 'error' THEN concat('{\"a\":', CAST(job.payload.k AS STRING), '}') END)"),
            outputs=Outputs("json", (OutputField("ab", "a.b"), OutputField("whole", ""), OutputField("s", "s"),
                                     OutputField("miss", "zz"))),
        ),
    ),
)


@query("outputs_json", sql="""
WITH e AS (SELECT event_id, event_type, props->>'$.k' AS k FROM events)
SELECT event_id,
  CASE WHEN event_type = 'click' THEN k WHEN event_type IN ('signup', 'error') THEN 'null' END AS ab,
  CASE WHEN event_type = 'click' THEN '{"a":{"b":' || k || '},"s":"x"}'
       WHEN event_type = 'signup' THEN '[1,2]'
       WHEN event_type = 'error' THEN '{"a":' || k || '}' END AS whole,
  CASE WHEN event_type = 'click' THEN '"x"' WHEN event_type IN ('signup', 'error') THEN 'null' END AS s,
  CASE WHEN event_type IN ('click', 'signup', 'error') THEN 'null' END AS miss,
  CASE WHEN event_type IN ('click', 'signup', 'error') THEN 4 ELSE 0 END AS n_outputs
FROM e
""")
def outputs_json(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    payload = F.to_json(F.struct("event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k")))
    jobs = envelope(ev, "events", payload, F.col("event_id"), id_field=None, keep=["event_id"])
    res = run_pipeline(jobs, OUT_SPEC)
    o = F.col("steps")["emit"]["outputs"]
    return res.select("event_id", o["ab"].alias("ab"), o["whole"].alias("whole"), o["s"].alias("s"),
                      o["miss"].alias("miss"), F.size(o).alias("n_outputs"))


TEXT_SPEC = PipelineSpec(
    id="outputs_text",
    payload_schema="text string, role string",
    steps=(
        TransformStep(id="say", expr="CASE WHEN job.payload.role = 'system' THEN NULL ELSE job.payload.text END",
                      outputs=Outputs("text", (OutputField("body"), OutputField("copy")))),
    ),
)


@query("outputs_text", sql="""
SELECT conv_id, turn, CASE WHEN role = 'system' THEN NULL ELSE CAST(to_json(text) AS VARCHAR) END AS body,
       CASE WHEN role = 'system' THEN 0 ELSE 2 END AS n_outputs
FROM conversations
""")
def outputs_text(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    jobs = envelope(c, "conversations", F.to_json(F.struct("text", "role")), F.struct("conv_id", "turn"),
                    id_field=None, keep=["conv_id", "turn"])
    res = run_pipeline(jobs, TEXT_SPEC)
    o = F.col("steps")["say"]["outputs"]
    return res.select("conv_id", "turn", o["body"].alias("body"), F.size(o).alias("n_outputs"))


# ── T5 / T6 / T8 ─────────────────────────────────────────────────────────────

GATE_SPEC = PipelineSpec(
    id="exit_gate",
    payload_schema=LINE_SCHEMA,
    steps=(
        TransformStep(id="strict", depends_on=(), success_exit_codes=(0, 2),
                      expr="named_struct('stdout', 'ran', 'exit_code', job.payload.line - 1)"),
        TransformStep(id="lenient", depends_on=(), success_exit_codes=(),
                      expr="named_struct('stdout', 'ran', 'exit_code', job.payload.line - 1)"),
    ),
)


@query("exit_gate", sql="""
SELECT l_orderkey, l_linenumber,
  CASE WHEN l_linenumber - 1 IN (0, 2) THEN l_linenumber - 1 ELSE -1 END AS strict_exit,
  CASE WHEN l_linenumber - 1 IN (0, 2) THEN NULL
       ELSE 'Task execution error: Exit code ' || CAST(l_linenumber - 1 AS VARCHAR) || ' is not in success_exit_codes [0, 2]'
  END AS strict_stderr,
  l_linenumber - 1 AS lenient_exit,
  CASE WHEN l_linenumber - 1 IN (0, 2) THEN 'success' ELSE 'failure' END AS status
FROM lineitem
""")
def exit_gate(spark, sf_dir):
    res = run_pipeline(line_jobs(spark, sf_dir), GATE_SPEC)
    s = F.col("steps")
    return res.select("l_orderkey", "l_linenumber", s["strict"]["exit_code"].alias("strict_exit"),
                      s["strict"]["stderr"].alias("strict_stderr"), s["lenient"]["exit_code"].alias("lenient_exit"),
                      "status")


CAP_SPEC = PipelineSpec(
    id="byte_cap",
    payload_schema="text string, lang string, source string",
    steps=(
        TransformStep(id="render", stdout_max_bytes=8000, stderr_max_bytes=4,
                      expr="named_struct('stdout', job.payload.text, 'stderr', job.payload.source)"),
        TransformStep(id="nocap", stdout_max_bytes=0, stderr_max_bytes=0,
                      expr="named_struct('stdout', job.payload.text, 'stderr', repeat(job.payload.lang, 5))"),
    ),
)


@query("byte_cap", sql="""
SELECT doc_id,
  CASE WHEN octet_length(encode(text)) > 8000 THEN 'Task execution error: stdout exceeded max_bytes limit of 8000'
       WHEN octet_length(encode(source)) > 4 THEN 'Task execution error: stderr exceeded max_bytes limit of 4'
       ELSE source END AS render_stderr,
  CASE WHEN octet_length(encode(text)) > 8000 OR octet_length(encode(source)) > 4 THEN 'failure' ELSE 'success' END AS status,
  CASE WHEN octet_length(encode(text)) > 8000 OR octet_length(encode(source)) > 4 THEN NULL
       ELSE CAST(octet_length(encode(text)) AS INTEGER) END AS nocap_bytes
FROM documents
""")
def byte_cap(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    jobs = envelope(d, "documents", F.to_json(F.struct("text", "lang", "source")), F.col("doc_id"), id_field=None,
                    keep=["doc_id"])
    res = run_pipeline(jobs, CAP_SPEC)
    s = F.col("steps")
    return res.select("doc_id", s["render"]["stderr"].alias("render_stderr"), "status",
                      F.octet_length(s["nocap"]["stdout"]).alias("nocap_bytes"))


LIMIT_SPEC = PipelineSpec(
    id="time_limit",
    payload_schema=LINE_SCHEMA,
    steps=(
        TransformStep(id="slow", timeout_secs=3,
                      expr="named_struct('stdout', 'done', 'duration_ms', CAST(job.payload.qty * 100 AS BIGINT))"),
    ),
)


@query("time_limit", sql="""
SELECT l_orderkey, l_linenumber,
  CASE WHEN CAST(l_quantity * 100 AS BIGINT) > 3000 THEN 'failure' ELSE 'success' END AS status,
  CASE WHEN CAST(l_quantity * 100 AS BIGINT) > 3000 THEN 'Timeout error: Task timed out after 3s' END AS error,
  CASE WHEN CAST(l_quantity * 100 AS BIGINT) > 3000 THEN 0 ELSE CAST(l_quantity * 100 AS BIGINT) END AS duration_ms
FROM lineitem
""")
def time_limit(spark, sf_dir):
    res = run_pipeline(line_jobs(spark, sf_dir), LIMIT_SPEC)
    s = F.col("steps")["slow"]
    return res.select("l_orderkey", "l_linenumber", "status", s["stderr"].alias("error"),
                      s["duration_ms"].alias("duration_ms"))


# ── T1 (Python transform) / T2 (stdin modes) ─────────────────────────────────

def _measure(stdin):
    """Per-row helper: '<LANG>:<characters of the whole text>', exit 3 for long texts."""
    import pandas as pd

    lang = stdin.str.split("|", n=1).str[0]
    text = stdin.str.split("|", n=1).str[1]
    n = text.str.len()
    return pd.DataFrame({"stdout": lang.str.upper() + ":" + n.astype(str),
                         "exit_code": (n >= 5000).astype(int) * 3})


PY_SPEC = PipelineSpec(
    id="python_transform",
    payload_schema="lang string, text string",
    steps=(
        TransformStep(id="measure", fn=_measure, stdin="template",
                      template="{{ job.payload.lang }}|{{ job.payload.text }}"),
        TransformStep(id="echo", fn=lambda s: s, stdin="payload", depends_on=(), stdout_max_bytes=0),
    ),
)


@query("python_transform", sql="""
SELECT doc_id,
  CASE WHEN length(text) < 5000 THEN upper(lang) || ':' || CAST(length(text) AS VARCHAR) END AS measure_stdout,
  CASE WHEN length(text) < 5000 THEN 0 ELSE -1 END AS measure_exit,
  CASE WHEN length(text) < 5000 THEN 'success' ELSE 'failure' END AS status,
  CAST(octet_length(encode(to_json(struct_pack(lang := lang, text := text)))) AS INTEGER) AS echo_bytes
FROM documents
""")
def python_transform(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    st = F.struct("lang", "text")
    jobs = envelope(d, "documents", F.to_json(st), F.col("doc_id"), id_field=None, keep=["doc_id"])
    res = run_pipeline(jobs, PY_SPEC)
    s = F.col("steps")
    return res.select("doc_id", s["measure"]["stdout"].alias("measure_stdout"),
                      s["measure"]["exit_code"].alias("measure_exit"), "status",
                      F.octet_length(s["echo"]["stdout"]).alias("echo_bytes"))
