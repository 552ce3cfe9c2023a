"""Queries for fan-out, cancellation and merge."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobframe.operators.cancel import cancellations, deleted_file_ids, mark_cancellations, removed_ids
from jobframe.operators.fanout import fan_out, route_table, unrouted
from jobframe.operators.merge import (
    assign_rounds,
    first_complete_groups,
    merge_any,
    merge_for_pipeline,
    merged_jobs,
    rounds_groups,
)
from jobframe.operators.theta import theta_groups
from jobframe.plans.catalog import query, table
from jobframe.spec import MapStep, MergeSpec, PipelineSpec

# ── J1 / P3 ──────────────────────────────────────────────────────────────────

_NOOP = (MapStep(id="noop", set=()),)
FANOUT_PIPELINES = [
    PipelineSpec(id="p_clicks", steps=_NOOP, sources=("click", "view"), labels=(("tier", "gold"),)),
    PipelineSpec(id="p_money", steps=_NOOP, sources=("purchase",), labels=(("env", "pay"),)),
    PipelineSpec(id="p_all", steps=_NOOP, sources=("click", "view", "purchase", "signup")),
]


def event_source_jobs(spark, sf_dir):
    """events as jobs whose source is the event type (source labels env/src)."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        "event_id", "user_id",
        F.concat(F.lit("ev-"), F.col("event_id").cast("string")).alias("id"),
        F.col("event_type").alias("source"),
        F.concat(F.lit('{"user_id":'), F.col("user_id").cast("string"), F.lit(',"event_id":'),
                 F.col("event_id").cast("string"), F.lit(',"value":'), F.col("value").cast("string"),
                 F.lit(',"k":'), F.get_json_object("props", "$.k"), F.lit("}")).alias("payload"),
        F.col("user_id").cast("string").alias("correlation_key"),
        F.create_map(F.lit("env"), F.lit("prod"), F.lit("src"), F.col("event_type")).alias("labels"),
        F.col("ts").alias("arrival_ts"), F.col("event_id").alias("arrival_seq"), "value",
    )


@query("fanout_labels", sql="""
WITH r(source, pipeline_id, tier, env) AS (VALUES
  ('click', 'p_clicks', 'gold', NULL), ('view', 'p_clicks', 'gold', NULL),
  ('purchase', 'p_money', NULL, 'pay'),
  ('click', 'p_all', NULL, NULL), ('view', 'p_all', NULL, NULL), ('purchase', 'p_all', NULL, NULL),
  ('signup', 'p_all', NULL, NULL))
SELECT e.event_id, r.pipeline_id, coalesce(r.env, 'prod') AS label_env, r.tier AS label_tier,
       e.event_type AS label_src
FROM events e JOIN r ON e.event_type = r.source
""")
def fanout_labels(spark, sf_dir):
    jobs = event_source_jobs(spark, sf_dir)
    out = fan_out(jobs, route_table(spark, FANOUT_PIPELINES))
    return out.select("event_id", "pipeline_id", F.col("labels")["env"].alias("label_env"),
                      F.col("labels")["tier"].alias("label_tier"), F.col("labels")["src"].alias("label_src"))


@query("unrouted", sql="""
SELECT event_id, event_type AS source FROM events
WHERE event_type NOT IN ('click', 'view', 'purchase', 'signup')
""")
def unrouted_q(spark, sf_dir):
    jobs = event_source_jobs(spark, sf_dir)
    return unrouted(jobs, route_table(spark, FANOUT_PIPELINES)).select("event_id", "source")


# ── C1 / C2 ──────────────────────────────────────────────────────────────────

def order_snapshot(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderpriority").alias("file"),
                    F.concat(F.lit("o-"), F.col("o_orderkey").cast("string")).alias("id"), "o_orderstatus")


@query("snapshot_removed", sql="""
SELECT o_orderpriority AS file, '__cancel__o-' || CAST(o_orderkey AS VARCHAR) AS cancel_id,
       'o-' || CAST(o_orderkey AS VARCHAR) AS target_job_id
FROM orders WHERE o_orderstatus = 'F'
""")
def snapshot_removed(spark, sf_dir):
    prev = order_snapshot(spark, sf_dir)
    cur = prev.where(F.col("o_orderstatus") != "F")  # the next poll no longer lists finished orders
    return cancellations(removed_ids(prev, cur), id_col="id").select("file", "cancel_id", "target_job_id")


@query("file_deleted", sql="""
SELECT o_orderpriority AS file, 'o-' || CAST(o_orderkey AS VARCHAR) AS target_job_id
FROM orders WHERE o_orderpriority = '5-LOW'
""")
def file_deleted(spark, sf_dir):
    prev = order_snapshot(spark, sf_dir)
    listing = prev.select("file").distinct().where(F.col("file") != "5-LOW")  # one file vanished
    return deleted_file_ids(prev, listing).select("file", F.col("id").alias("target_job_id"))


# ── C4 ───────────────────────────────────────────────────────────────────────

TTL_SECS = 60 * 86400


@query("cancel_ttl", sql=f"""
SELECT o_orderkey, EXISTS (
  SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey
    AND l.l_shipdate <= o.o_orderdate + INTERVAL 90 DAY
    AND l.l_shipdate >= o.o_orderdate + INTERVAL 90 DAY - INTERVAL {TTL_SECS} SECOND) AS cancelled
FROM orders o
""")
def cancel_ttl(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS")).alias("start_ts"))
    sig = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"),
                                                  F.col("l_shipdate").alias("signal_ts"))
    return mark_cancellations(o, sig, TTL_SECS).select(F.col("id").alias("o_orderkey"), "cancelled")


# ── J2 / J4 ──────────────────────────────────────────────────────────────────

@query("merge_any", sql="""
SELECT 'orders' AS source, 'o-' || CAST(o_orderkey AS VARCHAR) AS id, CAST(o_orderkey AS VARCHAR) AS correlation_key
FROM orders
UNION ALL
SELECT 'lines', 'l-' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR),
       CASE WHEN l_returnflag = 'A' THEN CAST(l_orderkey AS VARCHAR)
            WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'true' END
FROM lineitem
""")
def merge_any_q(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        F.lit("orders").alias("source"), F.concat(F.lit("o-"), F.col("o_orderkey").cast("string")).alias("id"),
        F.concat(F.lit('{"order":'), F.col("o_orderkey").cast("string"), F.lit(',"status":"'),
                 F.col("o_orderstatus"), F.lit('"}')).alias("payload"),
        F.lit("hdr").alias("correlation_key"))
    k = F.col("l_orderkey").cast("string")
    li = table(spark, sf_dir, "lineitem").select(
        F.lit("lines").alias("source"),
        F.concat(F.lit("l-"), k, F.lit("-"), F.col("l_linenumber").cast("string")).alias("id"),
        F.when(F.col("l_returnflag") == "R", F.concat(F.lit('{"order":['), k, F.lit("]}")))
        .when(F.col("l_returnflag") == "A", F.concat(F.lit('{"order":"'), k, F.lit('"}')))
        .when(F.col("l_linestatus") == "O", F.lit('{"order":true}'))
        .otherwise(F.lit('{"order":null}')).alias("payload"),
        F.lit("hdr").alias("correlation_key"))
    return merge_any(o.unionByName(li), "order").select("source", "id", "correlation_key")


@query("merge_any_numbers", sql="""
SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS id,
  CASE l_linenumber % 4 WHEN 0 THEN CAST(l_quantity AS VARCHAR) WHEN 1 THEN '1e300'
       WHEN 2 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) ELSE CAST(l_quantity AS VARCHAR) || '0' END AS correlation_key
FROM lineitem
""")
def merge_any_numbers(spark, sf_dir):
    """J4 on numbers: floats keep their fraction and exponent, of a repeated key the last value holds, and a string
    stays as it is."""
    k = F.concat_ws("-", "l_orderkey", "l_linenumber")
    q = F.col("l_quantity").cast("string")
    value = (F.when(F.col("l_linenumber") % 4 == 0, F.concat(q, F.lit("0")))
             .when(F.col("l_linenumber") % 4 == 1, F.lit("1e300"))
             .when(F.col("l_linenumber") % 4 == 2, F.concat(F.lit('"x","q":'), F.col("l_quantity").cast("bigint").cast("string")))
             .otherwise(F.concat(F.lit('"'), q, F.lit('0"'))))
    li = table(spark, sf_dir, "lineitem").select(
        F.lit("lines").alias("source"), k.alias("id"), F.concat(F.lit('{"q":'), value, F.lit("}")).alias("payload"),
        F.lit("hdr").alias("correlation_key"))
    return merge_any(li, "q").select("id", "correlation_key")


@query("merge_passthrough", sql="""
SELECT event_id, event_type AS source, CAST(user_id AS VARCHAR) AS correlation_key FROM events WHERE event_type = 'click'
""")
def merge_passthrough(spark, sf_dir):
    """A pipeline of one source forwards its jobs, whatever its merge section says."""
    spec = PipelineSpec(id="p_one", steps=_NOOP, sources=("click",), merge=MergeSpec("all", correlation_key="k"))
    routed = fan_out(event_source_jobs(spark, sf_dir), route_table(spark, [spec]))
    out, _ = merge_for_pipeline(routed, spec)
    return out.select("event_id", "source", "correlation_key")


# ── J3 / J7 / J8 ─────────────────────────────────────────────────────────────

FIRST_SOURCES = ["click", "purchase", "signup"]


@query("merge_all_first", sql="""
WITH e AS (SELECT user_id, event_type, event_id, ts, value FROM events
           WHERE event_type IN ('click', 'purchase', 'signup')),
f AS (SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM e GROUP BY user_id, event_type),
m AS (SELECT f.user_id, f.event_type, e.event_id, e.ts, e.value FROM f JOIN e USING (user_id, event_type, event_id))
SELECT CAST(user_id AS VARCHAR) AS key,
  'ev-' || CAST(max(CASE WHEN event_type = 'click' THEN event_id END) AS VARCHAR) AS click_id,
  'ev-' || CAST(max(CASE WHEN event_type = 'purchase' THEN event_id END) AS VARCHAR) AS purchase_id,
  'ev-' || CAST(max(CASE WHEN event_type = 'signup' THEN event_id END) AS VARCHAR) AS signup_id,
  sha256(string_agg('ev-' || CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id)) AS merged_id,
  arg_min(value, (ts, event_id)) AS first_value,
  CAST(user_id AS VARCHAR) AS correlation_key,
  'merge:p_first' AS merged_source
FROM m GROUP BY user_id HAVING count(*) = 3
""")
def merge_all_first(spark, sf_dir):
    jobs = event_source_jobs(spark, sf_dir)
    g = first_complete_groups(jobs, FIRST_SOURCES, key="correlation_key")
    m = merged_jobs(g, "p_first", "user_id")
    return _flat_groups(m, FIRST_SOURCES).drop("round")


@query("merged_envelope", sql="""
WITH e AS (SELECT *, '{"user_id":' || user_id || ',"event_id":' || event_id || ',"value":' || CAST(value AS VARCHAR) || ',"k":'
             || (props->>'$.k') || '}' AS payload FROM events WHERE event_type IN ('click', 'purchase', 'signup')),
f AS (SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM e GROUP BY user_id, event_type),
m AS (SELECT e.* FROM f JOIN e USING (user_id, event_type, event_id))
SELECT CAST(user_id AS VARCHAR) AS key,
  '{"event_id":' || arg_min(event_id, (ts, event_id)) || ',"k":' || arg_min(props->>'$.k', (ts, event_id)) || ',"value":'
    || arg_min(CAST(value AS VARCHAR), (ts, event_id)) || ',"user_id":"' || user_id || '","correlation_key":"' || user_id
    || '","sources":{' || string_agg('"' || event_type || '":' || payload, ',' ORDER BY ts, event_id)
    || '},"jobs":[' || string_agg('{"id":"ev-' || event_id || '","source":"' || event_type || '","payload":' || payload || '}',
                                  ',' ORDER BY ts, event_id) || ']}' AS payload,
  'prod,' || arg_min(event_type, (ts, event_id)) AS labels
FROM m GROUP BY user_id HAVING count(*) = 3
""")
def merged_envelope(spark, sf_dir):
    """The whole merged payload (fields of the first job that has them, key, sources, jobs) and labels."""
    g = first_complete_groups(event_source_jobs(spark, sf_dir), FIRST_SOURCES, key="correlation_key")
    m = merged_jobs(g, "p_first", "user_id")
    labels = F.col("merged_labels")
    return m.select("key", F.col("merged_payload").alias("payload"), F.concat_ws(",", labels["env"], labels["src"]).alias("labels"))


def member_of(source):
    return F.element_at(F.filter("members", lambda x: x["source"] == F.lit(source)), 1)


def _flat_groups(m, sources):
    cols = [member_of(s)["id"].alias(f"{s}_id") for s in sources]
    return m.select(
        "key", "round", *cols, "merged_id",
        F.get_json_object("merged_payload", "$.value").cast("double").alias("first_value"),
        F.col("merged_correlation_key").alias("correlation_key"), F.col("merged_source"))


# ── J3 rounds / J6 (no timeout) ──────────────────────────────────────────────

ROUND_SOURCES = ["click", "purchase"]


@query("merge_all_rounds", sql="""
WITH RECURSIVE e AS (
  SELECT user_id, event_type, event_id, ts, value,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
  FROM events WHERE event_type IN ('click', 'purchase')
), w(user_id, rn, round, kept, open_after, count_after) AS (
  SELECT user_id, rn, 0, true, event_type, 0 FROM e WHERE rn = 1
  UNION ALL
  SELECT e.user_id, e.rn, w.count_after,
         w.open_after IS NULL OR w.open_after <> e.event_type,
         CASE WHEN w.open_after IS NULL THEN e.event_type
              WHEN w.open_after = e.event_type THEN w.open_after END,
         w.count_after + CASE WHEN w.open_after IS NOT NULL AND w.open_after <> e.event_type THEN 1 ELSE 0 END
  FROM w JOIN e ON e.user_id = w.user_id AND e.rn = w.rn + 1
), k AS (SELECT e.*, w.round FROM w JOIN e USING (user_id, rn) WHERE w.kept)
SELECT CAST(user_id AS VARCHAR) AS key, CAST(round AS BIGINT) AS round,
  'ev-' || CAST(max(CASE WHEN event_type = 'click' THEN event_id END) AS VARCHAR) AS click_id,
  'ev-' || CAST(max(CASE WHEN event_type = 'purchase' THEN event_id END) AS VARCHAR) AS purchase_id,
  sha256(string_agg('ev-' || CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id)) AS merged_id,
  arg_min(value, (ts, event_id)) AS first_value,
  CAST(user_id AS VARCHAR) AS correlation_key,
  'merge:p_rounds' AS merged_source
FROM k GROUP BY user_id, round HAVING count(*) = 2
""")
def merge_all_rounds(spark, sf_dir):
    jobs = event_source_jobs(spark, sf_dir)
    labelled = assign_rounds(jobs, ROUND_SOURCES, key="correlation_key")
    g = rounds_groups(labelled, ROUND_SOURCES, key="correlation_key")
    return _flat_groups(merged_jobs(g, "p_rounds", "user_id"), ROUND_SOURCES)


# ── J6 (with timeout) ────────────────────────────────────────────────────────

TIMEOUT_SOURCES = ["click", "purchase", "signup"]
TIMEOUT_SECS = 6 * 3600
_L = TIMEOUT_SECS * 1_000_000
_M1 = f"(CASE WHEN w.mask <> 0 AND e.t - w.t0 > {_L} THEN 0 ELSE w.mask END)"


@query("merge_all_rounds_timeout", sql=f"""
WITH RECURSIVE e AS (
  SELECT user_id, event_type, event_id, ts, value, epoch_us(ts) AS t,
         CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE 4 END AS b,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
  FROM events WHERE event_type IN ('click', 'purchase', 'signup')
), w(user_id, rn, round, kept, mask, t0, starts) AS (
  SELECT user_id, rn, 0, true, b, t, 1 FROM e WHERE rn = 1
  UNION ALL
  SELECT e.user_id, e.rn,
    CASE WHEN {_M1} = 0 THEN w.starts + 1 ELSE w.starts END - 1,
    ({_M1} & e.b) = 0,
    CASE WHEN ({_M1} & e.b) <> 0 THEN {_M1} WHEN ({_M1} | e.b) = 7 THEN 0 ELSE ({_M1} | e.b) END,
    CASE WHEN {_M1} = 0 THEN e.t ELSE w.t0 END,
    CASE WHEN {_M1} = 0 THEN w.starts + 1 ELSE w.starts END
  FROM w JOIN e ON e.user_id = w.user_id AND e.rn = w.rn + 1
), k AS (SELECT e.*, w.round FROM w JOIN e USING (user_id, rn) WHERE w.kept)
SELECT CAST(user_id AS VARCHAR) AS key, CAST(round AS BIGINT) AS round,
  'ev-' || CAST(max(CASE WHEN event_type = 'click' THEN event_id END) AS VARCHAR) AS click_id,
  'ev-' || CAST(max(CASE WHEN event_type = 'purchase' THEN event_id END) AS VARCHAR) AS purchase_id,
  'ev-' || CAST(max(CASE WHEN event_type = 'signup' THEN event_id END) AS VARCHAR) AS signup_id,
  sha256(string_agg('ev-' || CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id)) AS merged_id,
  arg_min(value, (ts, event_id)) AS first_value,
  CAST(user_id AS VARCHAR) AS correlation_key,
  'merge:p_timeout' AS merged_source
FROM k GROUP BY user_id, round HAVING count(*) = 3
""")
def merge_all_rounds_timeout(spark, sf_dir):
    from jobframe.operators.merge import assign_rounds_timeout

    jobs = event_source_jobs(spark, sf_dir)
    labelled = assign_rounds_timeout(jobs, TIMEOUT_SOURCES, TIMEOUT_SECS, key="correlation_key")
    g = rounds_groups(labelled, TIMEOUT_SOURCES, key="correlation_key")
    return _flat_groups(merged_jobs(g, "p_timeout", "user_id"), TIMEOUT_SOURCES)


# ── C5 ───────────────────────────────────────────────────────────────────────

@query("cancel_consumed", sql="""
SELECT l_orderkey AS job_id, l_shipdate AS signal_ts
FROM lineitem l
WHERE NOT EXISTS (
  SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey
    AND o.o_orderdate + INTERVAL 120 DAY >= l.l_shipdate)
""")
def cancel_consumed(spark, sf_dir):
    from jobframe.operators.cancel import live_signals

    sig = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"),
                                                  F.col("l_shipdate").alias("signal_ts"))
    done = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"), (F.col("o_orderdate") + F.expr("INTERVAL 120 DAYS")).alias("completed_ts"))
    return live_signals(sig, done)


# ── J5: correlation by expression ──

THETA_SOURCES = ["click", "purchase"]
THETA_TIMEOUT = 6 * 3600
_TL = THETA_TIMEOUT * 1_000_000


_LIVE = f"list_filter(w.groups, lambda g: e.t - g.t0 <= {_TL})"
_IDX = f"list_position(list_transform({_LIVE}, lambda g: g.v >= e.value), true)"


@query("merge_theta", sql=f"""
WITH RECURSIVE e AS (
  SELECT user_id, event_type AS src, 'ev-' || CAST(event_id AS VARCHAR) AS id, value, epoch_us(ts) AS t,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
  FROM events WHERE event_type IN ('click', 'purchase')
), w(user_id, rn, groups, emitted) AS (
  SELECT user_id, rn, [{{'src': src, 'id': id, 'v': value, 't0': t}}], CAST(NULL AS VARCHAR) FROM e WHERE rn = 1
  UNION ALL
  SELECT e.user_id, e.rn,
    CASE WHEN {_IDX} IS NULL THEN {_LIVE} || [{{'src': e.src, 'id': e.id, 'v': e.value, 't0': e.t}}]
         WHEN {_LIVE}[{_IDX}].src = e.src THEN {_LIVE}
         ELSE list_filter({_LIVE}, lambda g, i: i != {_IDX}) END,
    CASE WHEN {_IDX} IS NOT NULL AND {_LIVE}[{_IDX}].src <> e.src
         THEN {_LIVE}[{_IDX}].id || ',' || e.id END
  FROM w JOIN e ON e.user_id = w.user_id AND e.rn = w.rn + 1
)
SELECT CAST(user_id AS VARCHAR) AS key, emitted AS member_ids FROM w WHERE emitted IS NOT NULL
""")
def merge_theta(spark, sf_dir):
    jobs = event_source_jobs(spark, sf_dir)
    groups, _ = theta_groups(jobs, THETA_SOURCES, "a.payload.value >= b.payload.value", THETA_TIMEOUT,
                             block="correlation_key", payload_schema="value double")
    return groups.select("key", F.array_join(F.transform("members", lambda m: m["id"]), ",").alias("member_ids"))


REJECTS_TIMEOUT = 1800
_RLIVE = _LIVE.replace(str(_TL), str(REJECTS_TIMEOUT * 1_000_000))
_RIDX = _IDX.replace(str(_TL), str(REJECTS_TIMEOUT * 1_000_000))


@query("merge_theta_rejects", sql=f"""
WITH RECURSIVE e AS (
  SELECT user_id, event_type AS src, 'ev-' || CAST(event_id AS VARCHAR) AS id, value, epoch_us(ts) AS t,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
  FROM events WHERE event_type IN ('click', 'purchase')
), w(user_id, rn, groups, opened, emitted) AS (
  SELECT user_id, rn, [{{'src': src, 'id': id, 'v': value, 't0': t}}], id, CAST(NULL AS VARCHAR) FROM e WHERE rn = 1
  UNION ALL
  SELECT e.user_id, e.rn,
    CASE WHEN {_RIDX} IS NULL THEN {_RLIVE} || [{{'src': e.src, 'id': e.id, 'v': e.value, 't0': e.t}}]
         WHEN {_RLIVE}[{_RIDX}].src = e.src THEN {_RLIVE}
         ELSE list_filter({_RLIVE}, lambda g, i: i != {_RIDX}) END,
    CASE WHEN {_RIDX} IS NULL THEN e.id END,
    CASE WHEN {_RIDX} IS NOT NULL AND {_RLIVE}[{_RIDX}].src <> e.src THEN {_RLIVE}[{_RIDX}].id || ',' || e.id END
  FROM w JOIN e ON e.user_id = w.user_id AND e.rn = w.rn + 1
), done AS (SELECT string_split(emitted, ',') AS ids FROM w WHERE emitted IS NOT NULL)
SELECT id, src AS source, 'merge group never got all sources' AS reason
FROM e WHERE id IN (SELECT opened FROM w WHERE opened IS NOT NULL) AND id NOT IN (SELECT unnest(ids) FROM done)
UNION ALL
SELECT sha256(array_to_string(ids, ',')), 'merge:p_theta', 'merged' FROM done
""")
def merge_theta_rejects(spark, sf_dir):
    """A spec's expression over all sources: jobs whose group got no second source in time come back as rejects, the
    others as merged jobs; the equality in the expression is a join key."""
    jobs = event_source_jobs(spark, sf_dir).where(F.col("source").isin(*THETA_SOURCES))
    spec = PipelineSpec(
        id="p_theta", steps=_NOOP, sources=tuple(THETA_SOURCES), payload_schema="user_id bigint, value double",
        merge=MergeSpec("all", correlation_expr="a.payload.user_id = b.payload.user_id AND a.payload.value >= b.payload.value",
                        timeout_secs=REJECTS_TIMEOUT))
    merged, rejects = merge_for_pipeline(jobs, spec)
    return rejects.unionByName(merged.select("id", "source", F.lit("merged").alias("reason")))
