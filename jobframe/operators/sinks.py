"""Sinks (K9–K13): result lines, step rows, signed and keyed outboxes.

Every sink is a projection of the delivery rows produced by
``jobframe.operators.dispatch.deliveries``; writing is a single
``partitionBy(sink_id)`` pass (batch) or the same inside ``foreachBatch``
(streaming). Ids are derived from (job, pipeline, sink, step), so a re-run after
an executor loss rewrites the same rows instead of adding new ones.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobframe.functions.hmac import hmac_sha256_hex
from jobframe.functions.json import compact_json

IDENT = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")

# Fixed column roles of the result table (K10), in their natural order.
RESULT_COLUMNS = ("result_id", "job_id", "pipeline_id", "step_id", "occurred_at", "exit_code", "stdout",
                  "stderr", "duration_ms", "attempt", "status")


def check_identifier(kind: str, name: str) -> str:
    """Table / column names must be plain identifiers."""
    if not IDENT.match(name or ""):
        raise ValueError(f"invalid {kind} identifier {name!r}: must match {IDENT.pattern}")
    return name


def step_rows(deliveries: DataFrame, occurred_at: Column | str, columns: Mapping[str, str] | None = None,
              sink: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """One row per step of each message, 11 columns; NULL stdout/stderr → ''."""
    cols = {c: c for c in RESULT_COLUMNS}
    cols.update(columns or {})
    for role, name in cols.items():
        check_identifier("column", name)
    d = deliveries if sink is None else deliveries.where(F.col("sink_id") == sink)
    step_names = [f.name for f in d.schema["step_results"].dataType.fields]
    # the message's step list is exploded and the step struct looked up by name
    lookup = None
    for s in step_names:
        lookup = (F.when(F.col("_step") == s, F.col("step_results")[s]) if lookup is None
                  else lookup.when(F.col("_step") == s, F.col("step_results")[s]))
    e = d.select("*", F.explode("steps").alias("_step")).withColumn("_r", lookup)
    ts = F.lit(occurred_at) if isinstance(occurred_at, str) else occurred_at
    return e.select(
        F.sha2(F.concat_ws("|", "job_id", "pipeline_id", "sink_id", "scope", "_step"), 256).alias(cols["result_id"]),
        F.col("job_id").alias(cols["job_id"]),
        F.col("pipeline_id").alias(cols["pipeline_id"]),
        F.col("_step").alias(cols["step_id"]),
        ts.alias(cols["occurred_at"]),
        F.col("_r.exit_code").alias(cols["exit_code"]),
        F.coalesce(F.col("_r.stdout"), F.lit("")).alias(cols["stdout"]),
        F.coalesce(F.col("_r.stderr"), F.lit("")).alias(cols["stderr"]),
        F.col("_r.duration_ms").alias(cols["duration_ms"]),
        F.col("_r.attempt").alias(cols["attempt"]),
        F.col("status").alias(cols["status"]),
        F.col("sink_id"),
        *(keep or []),
    )


def result_json(deliveries: DataFrame, occurred_at: Column | str) -> Column:
    """K6, K9: the result message as compact JSON (absent options omitted), with the message's duration and time. The
    job's payload is put in as written, so its numbers keep their form; text that is no JSON becomes a string."""
    step_names = [f.name for f in deliveries.schema["step_results"].dataType.fields]
    each = [F.when(F.array_contains("steps", name), F.concat(
        F.lit(json.dumps(name, ensure_ascii=False) + ":"), F.to_json(F.col("step_results")[name]))) for name in step_names]
    steps = F.concat(F.lit("{"), F.concat_ws(",", *each), F.lit("}"))  # in the order of the pipeline
    p = F.col("payload")
    payload = F.when(F.try_parse_json(p).isNotNull(), compact_json(p)).otherwise(F.coalesce(_text(p), F.lit("null")))
    labels = F.when(F.size("labels") > 0, F.concat(F.lit(',"labels":'), F.to_json("labels"))).otherwise("")
    corr = F.coalesce(F.concat(F.lit(',"correlation_key":'), _text(F.col("correlation_key"))), F.lit(""))
    ts = F.lit(occurred_at) if isinstance(occurred_at, str) else occurred_at
    return F.concat(
        F.lit('{"pipeline_id":'), _text(F.col("pipeline_id")), F.lit(',"job":{"id":'), _text(F.col("job_id")),
        F.lit(',"source":'), _text(F.col("source")), F.lit(',"payload":'), payload, corr, labels,
        F.lit('},"status":'), _text(F.col("status")), F.lit(',"duration_ms":'), F.col("duration_ms").cast("string"),
        F.lit(',"steps":'), steps, F.lit(',"occurred_at":'), _text(ts), F.lit("}"))


def _text(c: Column) -> Column:
    """A string as JSON; NULL stays NULL."""
    j = F.to_json(F.array(c))
    return F.when(c.isNotNull(), F.substr(j, F.lit(2), F.length(j) - 2))


def write_lines(deliveries: DataFrame, path: str, line: Column, path_key: Column | None = None,
                mode: str = "append") -> None:
    """K9 writer: one text line per delivery, partitioned by sink (and a rendered
    path key when the sink path is a template)."""
    out = deliveries.select("sink_id", *( [path_key.alias("path_key")] if path_key is not None else []),
                            line.alias("value"))
    parts = ["sink_id"] + (["path_key"] if path_key is not None else [])
    out.write.mode(mode).partitionBy(*parts).text(path)


def write_step_rows(rows: DataFrame, path: str, mode: str = "append") -> None:
    """K10 writer: the rows of ``step_rows`` as a Parquet table, one partition for each sink; with mode "overwrite" of
    an epoch's own folder a replayed batch replaces its rows."""
    rows.write.mode(mode).partitionBy("sink_id").parquet(path)


def webhook_outbox(deliveries: DataFrame, url: Column, body: Column, secret: str = "",
                   headers: Mapping[str, Column] | None = None, max_retries: int = 3,
                   retry_base_ms: int = 250) -> DataFrame:
    """What a webhook sink would send – url, headers, body, hex HMAC of the body
    (when a secret is set) and the retry delay schedule ``base·2^n`` for n = 0..max."""
    hdr = F.create_map(*[x for k, v in (headers or {}).items() for x in (F.lit(k), v)]) if headers else \
        F.create_map().cast("map<string,string>")
    sig = hmac_sha256_hex(body, secret) if secret else F.lit(None).cast("string")
    delays = F.transform(F.sequence(F.lit(0), F.lit(max_retries)),
                         lambda n: (F.lit(retry_base_ms) * F.pow(F.lit(2), n)).cast("bigint"))
    return deliveries.select("*", url.alias("url"), hdr.alias("headers"), body.alias("body"),
                             sig.alias("signature"), delays.alias("retry_delays_ms"))


def queue_outbox(deliveries: DataFrame, body: Column, success_key: Column, failure_key: Column) -> DataFrame:
    """Routing key chosen by the message status, body = result JSON."""
    key = F.when(F.col("status") == "success", success_key).otherwise(failure_key)
    return deliveries.select("*", key.alias("routing_key"), body.alias("body"))
