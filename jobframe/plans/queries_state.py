"""Queries for state and recovery, table claim, calendar ticks and file sources
(ST1–ST4, S1–S4, S6, S7, S10)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from jobframe.operators.cancel import cancellations, removed_ids
from jobframe.operators.state import latest_state, recover_incomplete, route_recovered
from jobframe.plans.catalog import query, table
from jobframe.session import checkpoint_dir
from jobframe.sources.files import read_csv, read_directory, read_json_array, read_jsonl, snapshot
from jobframe.sources.tables import claim_pending
from jobframe.sources.ticks import ticks

# ── ST1–ST4 ──────────────────────────────────────────────────────────────────


def state_events(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    oid = F.concat(F.lit("o-"), F.col("o_orderkey").cast("string"))
    pipe = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "fast").otherwise("slow")
    queued = o.select(oid.alias("job_id"), pipe.alias("pipeline_id"), F.lit("queued").alias("state"),
                      F.col("o_orderdate").alias("updated_at"), F.lit(0).cast("bigint").alias("seq"),
                      F.lit("orders").alias("source"),
                      F.concat(F.lit('{"total":'), F.col("o_totalprice").cast("string"), F.lit("}")).alias("payload"))
    requeued = o.where(F.col("o_orderstatus") == "P").select(
        oid.alias("job_id"), pipe.alias("pipeline_id"), F.lit("queued").alias("state"),
        (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("updated_at"), F.lit(0).cast("bigint").alias("seq"),
        F.lit("orders").alias("source"), F.lit('{"total":0}').alias("payload"))
    li = table(spark, sf_dir, "lineitem")
    st = (F.when(F.col("l_linestatus") == "O", "running").when(F.col("l_returnflag") == "R", "failure")
          .when(F.col("l_returnflag") == "A", "cancelled").otherwise("success"))
    upd = li.select(F.concat(F.lit("o-"), F.col("l_orderkey").cast("string")).alias("job_id"),
                    F.lit("fast").alias("pipeline_id"), st.alias("state"), F.col("l_shipdate").alias("updated_at"),
                    F.col("l_linenumber").cast("bigint").alias("seq"), F.lit(None).cast("string").alias("source"),
                    F.lit(None).cast("string").alias("payload"))
    return queued.unionByName(requeued).unionByName(upd)


STATE_EVENTS_SQL = """
WITH ev AS (
  SELECT 'o-' || CAST(o_orderkey AS VARCHAR) AS job_id,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'fast' ELSE 'slow' END AS pipeline_id,
         'queued' AS state, o_orderdate AS updated_at, 0 AS seq, '{"total":' || CAST(o_totalprice AS VARCHAR) || '}' AS payload
  FROM orders
  UNION ALL
  SELECT 'o-' || CAST(o_orderkey AS VARCHAR),
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'fast' ELSE 'slow' END,
         'queued', o_orderdate + INTERVAL 30 DAY, 0, '{"total":0}'
  FROM orders WHERE o_orderstatus = 'P'
  UNION ALL
  SELECT 'o-' || CAST(l_orderkey AS VARCHAR), 'fast',
         CASE WHEN l_linestatus = 'O' THEN 'running' WHEN l_returnflag = 'R' THEN 'failure'
              WHEN l_returnflag = 'A' THEN 'cancelled' ELSE 'success' END,
         l_shipdate, l_linenumber, NULL
  FROM lineitem
), latest AS (
  SELECT job_id, pipeline_id, arg_max(state, (updated_at, seq, state)) AS state,
         arg_max(updated_at, (updated_at, seq, state)) AS updated_at,
         arg_max(payload, (updated_at, seq, state)) FILTER (WHERE state = 'queued') AS payload
  FROM ev GROUP BY job_id, pipeline_id
  HAVING count(*) FILTER (WHERE state = 'queued') > 0
)
"""


@query("state_latest", sql=STATE_EVENTS_SQL + "SELECT job_id, pipeline_id, state, updated_at, payload FROM latest")
def state_latest(spark, sf_dir):
    return latest_state(state_events(spark, sf_dir)).select("job_id", "pipeline_id", "state", "updated_at", "payload")


@query("state_recover", sql=STATE_EVENTS_SQL + """
SELECT job_id, pipeline_id, state FROM latest WHERE state IN ('queued', 'running')
""")
def state_recover(spark, sf_dir):
    return recover_incomplete(latest_state(state_events(spark, sf_dir))).select("job_id", "pipeline_id", "state")


@query("state_unknown_pipeline", sql=STATE_EVENTS_SQL + """
SELECT job_id, pipeline_id, CASE WHEN pipeline_id = 'fast' THEN 'replay' ELSE 'discarded' END AS routed
FROM latest WHERE state IN ('queued', 'running')
""")
def state_unknown_pipeline(spark, sf_dir):
    rec = recover_incomplete(latest_state(state_events(spark, sf_dir)))
    known = spark.createDataFrame([("fast",)], "pipeline_id string")
    return route_recovered(rec, known).select("job_id", "pipeline_id", F.when(F.col("known"), "replay").otherwise(
        "discarded").alias("routed"))


# ── S7 ───────────────────────────────────────────────────────────────────────

@query("claim_pending", sql="""
SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderdate AS created_at, 'processing' AS status,
       o_totalprice AS total
FROM orders WHERE o_orderstatus <> 'F'
ORDER BY o_orderdate, CAST(o_orderkey AS VARCHAR) LIMIT 100
""")
def claim_pending_q(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderdate").alias("created_at"),
                    F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "waiting")
                    .alias("status"), F.col("o_totalprice").alias("total"))
    claimed, _ = claim_pending(rows, 100)
    return claimed.select("id", "created_at", "status", "total")


@query("claim_pending_values", sql="""
SELECT CAST(o_orderkey AS VARCHAR) AS id,
       CASE WHEN id_rank <= 100 THEN 'working' WHEN o_orderstatus = 'F' THEN 'finished' WHEN o_orderstatus = 'O' THEN 'working' END AS status
FROM (SELECT *, CASE WHEN o_orderstatus = 'P' THEN row_number() OVER (PARTITION BY o_orderstatus
             ORDER BY o_orderdate, CAST(o_orderkey AS VARCHAR)) END AS id_rank FROM orders)
""")
def claim_pending_values(spark, sf_dir):
    """A source with its own status values: rows being worked on or finished are not claimed again."""
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderdate").alias("created_at"),
                    F.when(F.col("o_orderstatus") == "F", "finished").when(F.col("o_orderstatus") == "O", "working")
                    .alias("status"))
    _, after = claim_pending(rows, 100, processing="working", done="finished", failed="broken")
    return after.select("id", "status")


# ── S10 ──────────────────────────────────────────────────────────────────────

SCHED = "0 0 9-17 ? * Mon-Fri"


@query("tick_spine", sql="""
WITH b AS (SELECT epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi FROM events),
t AS (
  SELECT make_timestamp(m * 60000000) AS t
  FROM b, range(CAST(ceil(ceil(lo / 1000000.0) / 60.0) AS BIGINT), CAST(floor(floor(hi / 1000000.0) / 60.0) AS BIGINT) + 1) r(m)
), l AS (SELECT t, timezone('America/New_York', t AT TIME ZONE 'UTC') AS lt FROM t),
k AS (SELECT * FROM l WHERE minute(lt) = 0 AND hour(lt) BETWEEN 9 AND 17 AND isodow(lt) BETWEEN 1 AND 5),
h AS (SELECT date_trunc('hour', ts) AS t, count(*) AS n FROM events GROUP BY 1)
SELECT strftime(k.t, '%Y-%m-%d %H:%M:%S') AS tick, CAST(hour(k.lt) AS INTEGER) AS local_hour,
       sha256(concat_ws('|', 'cron', strftime(k.t, '%Y-%m-%d %H:%M:%S'))) AS job_id, coalesce(h.n, 0) AS n_events
FROM k LEFT JOIN h ON h.t = k.t
""")
def tick_spine(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    b = ev.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("lo"),
               F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("hi")).first()
    start_s = -(-b["lo"] // 1_000_000)
    end_s = b["hi"] // 1_000_000
    t = ticks(spark, start_s, end_s, SCHED, tz="America/New_York")
    per_hour = ev.groupBy(F.date_trunc("hour", F.col("ts")).alias("h")).agg(F.count("*").alias("n"))
    j = t.join(per_hour, t.tick_ts.cast("timestamp_ntz") == per_hour.h, "left")
    return j.select(F.date_format("tick_ts", "yyyy-MM-dd HH:mm:ss").alias("tick"),
                    F.hour("local_ts").alias("local_hour"), F.col("id").alias("job_id"),
                    F.coalesce(F.col("n"), F.lit(0)).alias("n_events"))


# ── S1–S4 ────────────────────────────────────────────────────────────────────

def _scratch(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/roundtrip/{name}-{uuid.uuid4().hex}"


def _event_lines():
    k = F.get_json_object("props", "$.k")
    return (F.when(F.col("event_type") == "click", F.col("props"))
            .when(F.col("event_type") == "view", F.lit("   "))
            .when(F.col("event_type") == "error", F.concat(F.lit("not json "), F.col("event_id").cast("string")))
            .when(F.col("event_type") == "signup", F.concat(F.lit("["), k, F.lit(","), F.col("event_id").cast("string"), F.lit("]")))
            .otherwise(F.concat(F.lit('  {"id":"ev-'), F.col("event_id").cast("string"), F.lit('","k":'), k, F.lit("}  "))))


EVENT_LINES_SQL = """
SELECT event_id, CASE
  WHEN event_type = 'click' THEN props
  WHEN event_type = 'signup' THEN '[' || (props->>'$.k') || ',' || CAST(event_id AS VARCHAR) || ']'
  WHEN event_type = 'purchase' THEN '{"id":"ev-' || CAST(event_id AS VARCHAR) || '","k":' || (props->>'$.k') || '}'
  END AS payload
FROM events WHERE event_type IN ('click', 'signup', 'purchase')
"""


@query("file_roundtrip_jsonl", sql="""
SELECT payload, CASE WHEN starts_with(payload, '{"id":') THEN payload->>'$.id' END AS named_id,
       'jsonl' AS source FROM (""" + EVENT_LINES_SQL + """) x
""")
def file_roundtrip_jsonl(spark, sf_dir):
    path = _scratch(spark, "jsonl")
    ev = table(spark, sf_dir, "events")
    ev.select(_event_lines().alias("value")).write.text(path)
    jobs, _ = read_jsonl(spark, path, "jsonl", glob="part-*")
    return jobs.select("payload", F.when(F.col("payload").startswith('{"id":'), F.col("id")).alias("named_id"),
                       "source")


@query("file_roundtrip_json_array", sql="""
SELECT c_mktsegment AS segment, CAST(c_custkey AS VARCHAR) AS id,
       '{"id":"' || CAST(c_custkey AS VARCHAR) || '","bal":' || CAST(c_acctbal AS VARCHAR) || ',"one":1.0,"big":1e300}' AS payload
FROM customer
""")
def file_roundtrip_json_array(spark, sf_dir):
    """A file for each market segment, read in one scan; repeated keys (the last holds for the id) and floats."""
    path = _scratch(spark, "json")
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey").cast("string")
    item = F.concat(F.lit('{"id": "old", "id": "'), key, F.lit('", "bal" : '), F.col("c_acctbal").cast("string"),
                    F.lit(', "one": 1.0, "big":1e300}'))
    order = ["c_mktsegment", "_o", "c_custkey"]
    ends = c.select("c_mktsegment").distinct().withColumn("c_custkey", F.lit(None).cast("bigint"))
    rows = c.select("c_mktsegment", F.lit(1).alias("_o"), "c_custkey", F.concat(item, F.lit(",")).alias("value"))
    frame = ends.withColumn("_o", F.lit(0)).withColumn("value", F.lit("[")).unionByName(
        ends.withColumn("_o", F.lit(2)).withColumn("value", F.lit('"end"]')))
    junk = spark.createDataFrame([("object", 1, 0, '{"not": "an array"}')], "c_mktsegment string, _o int, c_custkey bigint, value string")
    (rows.unionByName(frame).unionByName(junk).repartition("c_mktsegment").sortWithinPartitions(*order)
     .select("c_mktsegment", "value").write.partitionBy("c_mktsegment").text(path))
    jobs, _ = read_json_array(spark, path, "json_array", glob="part-*", recursive=True)
    return jobs.where("payload <> '\"end\"'").select(
        F.regexp_extract(F.url_decode("file"), "c_mktsegment=([^/]*)", 1).alias("segment"), "id",
        F.replace("payload", F.lit('"id":"old",'), F.lit("")).alias("payload"))


@query("file_roundtrip_csv", sql="""
SELECT CASE WHEN c_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END AS kind, CAST(c_custkey AS VARCHAR) AS custkey,
       CASE WHEN c_nationkey % 2 = 0
            THEN '{"custkey":"' || CAST(c_custkey AS VARCHAR) || '","name":"' || c_name || '","note":""}'
            ELSE '{"custkey":"' || CAST(c_custkey AS VARCHAR) || '","segment":"' || c_mktsegment || ', \\"x\\"\\nend"}' END AS payload
FROM customer WHERE c_acctbal >= 0
""")
def file_roundtrip_csv(spark, sf_dir):
    """Two kinds of files in one folder tree, read in one scan: empty fields, a header with a repeated name (the last
    holds), quotes, commas and line ends in fields; rows with a negative balance have a field too many."""
    path = _scratch(spark, "csv")
    c = table(spark, sf_dir, "customer")
    even = F.col("c_nationkey") % 2 == 0
    key = F.col("c_custkey").cast("string")
    line = F.when(even, F.concat_ws(",", key, "c_name", F.lit(""))).otherwise(
        F.concat(F.lit("no,"), key, F.lit(',"'), "c_mktsegment", F.lit(', ""x""\nend"')))
    line = F.when(F.col("c_acctbal") < 0, F.concat(line, F.lit(",extra"))).otherwise(line)
    kind = F.when(even, "even").otherwise("odd")
    # a folder for each nation, the header line first
    data = c.select(kind.alias("kind"), "c_nationkey", F.lit(1).alias("_o"), line.alias("value"))
    heads = c.select(kind.alias("kind"), "c_nationkey").distinct().select(
        "kind", "c_nationkey", F.lit(0).alias("_o"),
        F.when(F.col("kind") == "even", "custkey,name,note").otherwise("custkey,custkey,segment").alias("value"))
    (data.unionByName(heads).repartition("kind", "c_nationkey").sortWithinPartitions("kind", "c_nationkey", "_o")
     .select("kind", "c_nationkey", "value").write.partitionBy("kind", "c_nationkey").text(path))
    jobs, _ = read_csv(spark, path, "csv", glob="part-*", recursive=True)
    return jobs.select(F.regexp_extract("file", "kind=([a-z]*)", 1).alias("kind"),
                       F.get_json_object("payload", "$.custkey").alias("custkey"), "payload")


@query("file_roundtrip_dir", sql="""
SELECT payload, 'dir' AS source FROM (""" + EVENT_LINES_SQL + """) x
UNION ALL
SELECT '{"n_nationkey":' || CAST(n_nationkey AS VARCHAR) || ',"n_name":"' || n_name || '"}', 'dir' FROM nation
""")
def file_roundtrip_dir(spark, sf_dir):
    path = _scratch(spark, "dir")
    ev = table(spark, sf_dir, "events")
    ev.select(_event_lines().alias("value")).write.text(path + "/tmp_jsonl")
    n = table(spark, sf_dir, "nation")
    n.select(F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json(F.struct("n_nationkey", "n_name"))), ","),
                      F.lit("]")).alias("value")).write.text(path + "/tmp_json")
    n.select(F.col("n_name").alias("value")).write.text(path + "/tmp_txt")
    _collect_into(spark, path, {"tmp_jsonl": "jsonl", "tmp_json": "json", "tmp_txt": "txt"})
    jobs, _ = read_directory(spark, path, "dir")
    return jobs.select(F.regexp_replace("payload", r"^\s+|\s+$", "").alias("payload"), "source")


@query("snapshot_diff", sql="""
SELECT 'o-' || CAST(o_orderkey AS VARCHAR) AS id, '__cancel__o-' || CAST(o_orderkey AS VARCHAR) AS cancel_id
FROM orders WHERE o_orderstatus = 'F'
""")
def snapshot_diff(spark, sf_dir):
    """Two full reads of a folder, before and after its finished orders were taken out."""
    o = table(spark, sf_dir, "orders")
    line = F.concat(F.lit('{"id":"o-'), F.col("o_orderkey").cast("string"), F.lit('"}'))
    before, after = _scratch(spark, "before"), _scratch(spark, "after")
    for path, rows in ((before, o), (after, o.where("o_orderstatus <> 'F'"))):
        rows.select(line.alias("value")).write.text(path + "/tmp")
        _collect_into(spark, path, {"tmp": "jsonl"})
    gone = removed_ids(snapshot(spark, before, "orders"), snapshot(spark, after, "orders"), keys=("id",))
    return cancellations(gone).select(F.col("target_job_id").alias("id"), "cancel_id")


def _collect_into(spark, path, subdirs: dict[str, str]) -> None:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    Path = jvm.org.apache.hadoop.fs.Path
    fs = Path(path).getFileSystem(conf)
    for sub, ext in subdirs.items():
        for st in fs.listStatus(Path(path + "/" + sub)):
            name = st.getPath().getName()
            if name.startswith("part-"):
                fs.rename(st.getPath(), Path(f"{path}/{sub}-{name.split('.')[0]}.{ext}"))
