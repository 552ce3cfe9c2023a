"""Dispatch of pipeline results to sinks (K1–K8).

All deliveries of a result are built in one projection as an
``array<struct<sink_id, scope, step_id, status, steps>>`` and exploded, so
fan-out to k sinks is a single pass with no shuffle. Writing per sink is then a
``partitionBy(sink_id)`` (see ``jobframe.operators.sinks``). The projection is
generated as SQL text and handed to the JVM once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobframe.operators.steps import ident, lit
from jobframe.session import lenient
from jobframe.spec import PipelineSpec

DELIVERY_SCOPES = ("route", "step", "pipeline", "dead_letter", "step_dead_letter")
ELEM_TYPE = "struct<sink_id:string,scope:string,step_id:string,status:string,steps:array<string>,duration_ms:bigint>"


def _elem(sink: str, scope: str, step_id: str | None, status: str, steps: str) -> str:
    """A message; its duration is that of its step (K6), or of the whole run."""
    sid = lit(step_id) if step_id is not None else "CAST(NULL AS STRING)"
    duration = f"_steps_raw.{ident(step_id)}.duration_ms" if step_id is not None else "_duration_ms"
    return (f"named_struct('sink_id', {lit(sink)}, 'scope', {lit(scope)}, 'step_id', {sid}, "
            f"'status', {status}, 'steps', {steps}, 'duration_ms', {duration})")


def _view(spec: PipelineSpec) -> str:
    parts = []
    for s in spec.steps:
        c = f"_steps_raw.{ident(s.id)}"
        parts.append(f"{lit(s.id)}, CASE WHEN {c} IS NULL THEN NULL ELSE named_struct("
                     f"'stdout', coalesce({c}.stdout, ''), 'stderr', coalesce({c}.stderr, ''), "
                     f"'exit_code', {c}.exit_code, 'duration_ms', {c}.duration_ms, 'attempt', {c}.attempt, "
                     f"'outputs', {c}.outputs) END")
    return f"named_struct({', '.join(parts)})"


def run_duration(spec: PipelineSpec, steps: str) -> str:
    """A run's duration: the sum of its steps' durations (SQL text)."""
    return "(" + " + ".join([f"coalesce({steps}.{ident(s.id)}.duration_ms, 0L)" for s in spec.steps] or ["0L"]) + ")"


def sink_context(results: DataFrame, spec: PipelineSpec) -> DataFrame:
    """Routing sees the original job (P7) and the final steps (E1 view)."""
    payload = (f"from_json(payload, {lit(spec.payload_schema)})" if spec.payload_schema
               else "try_parse_json(payload)")
    cols = [ident(c) for c in results.columns if c != "steps"]
    return results.selectExpr(
        *cols, "steps AS _steps_raw",
        f"named_struct('id', id, 'source', source, 'payload', {payload}, 'labels', labels, "
        f"'correlation_key', correlation_key) AS job",
        "named_struct('id', pipeline_id) AS pipeline",
    ).selectExpr("*", f"{_view(spec)} AS steps", f"{run_duration(spec, '_steps_raw')} AS _duration_ms")


def delivery_array(spec: PipelineSpec, enabled_sinks: set[str] | None = None) -> str:
    """SQL text of the delivery array over a sink-context row; messages to sinks that are not enabled are not built (K7)."""
    elems: list[str] = []

    def message(sink: str, fire: str, *parts) -> None:
        if enabled_sinks is None or sink in enabled_sinks:
            elems.append(f"CASE WHEN {fire} THEN {_elem(sink, *parts)} END")

    present = {s.id: f"(_steps_raw.{ident(s.id)} IS NOT NULL)" for s in spec.steps}
    handled: dict[str, str] = {s.id: "false" for s in spec.steps}

    def step_status(sid: str) -> str:
        return f"CASE WHEN _steps_raw.{ident(sid)}.exit_code = 0 THEN 'success' ELSE 'failure' END"

    # K1: every matching rule fires; NULL / error counts as no match
    for s in spec.steps:
        if not s.routing:
            continue
        hits = []
        for rule in s.routing:
            hit = f"coalesce(CASE WHEN {present[s.id]} THEN ({rule.condition}) END, false)"
            hits.append(hit)
            for sink in rule.sinks:
                message(sink, hit, "route", s.id, step_status(s.id), f"array({lit(s.id)})")
        handled[s.id] = "(" + " OR ".join(hits) + ")"
    # K2: step sinks for steps not handled by routing
    for s in spec.steps:
        if not s.sinks:
            continue
        fire = f"({present[s.id]} AND NOT {handled[s.id]})"
        for sink in s.sinks:
            message(sink, fire, "step", s.id, step_status(s.id), f"array({lit(s.id)})")
        handled[s.id] = f"({handled[s.id]} OR {present[s.id]})"
    # K3: one pipeline message with the remaining steps, only if some remain
    remaining = ("filter(array(" + ", ".join(
        f"CASE WHEN {present[s.id]} AND NOT {handled[s.id]} THEN {lit(s.id)} END" for s in spec.steps)
        + "), x -> x IS NOT NULL)")
    for sink in spec.sinks:
        message(sink, f"size({remaining}) > 0", "pipeline", None, "status", remaining)
    # K4: pipeline dead letter carries the full result, in addition to K1–K3
    all_steps = ("filter(array(" + ", ".join(f"CASE WHEN {present[s.id]} THEN {lit(s.id)} END" for s in spec.steps)
                 + "), x -> x IS NOT NULL)")
    if spec.failure.action == "dead_letter" and spec.failure.sink:
        message(spec.failure.sink, "status = 'failure'", "dead_letter", None, "status", all_steps)
    # K5: step dead letters for failed steps with that action
    for s in spec.steps:
        if s.failure.action == "dead_letter" and s.failure.sink:
            fire = f"(status = 'failure' AND {present[s.id]} AND _steps_raw.{ident(s.id)}.exit_code <> 0)"
            message(s.failure.sink, fire, "step_dead_letter", s.id, step_status(s.id), f"array({lit(s.id)})")
    if not elems:
        return f"CAST(array() AS ARRAY<{ELEM_TYPE}>)"
    return f"filter(array({', '.join(elems)}), e -> e IS NOT NULL)"


def deliveries(results: DataFrame, spec: PipelineSpec, enabled_sinks: set[str] | None = None) -> DataFrame:
    """K8: one row per (result, sink message)."""
    ctx = sink_context(results, spec)
    with lenient(results.sparkSession):  # K1: a rule that fails on a record does not match
        out = ctx.selectExpr("*", f"explode({delivery_array(spec, enabled_sinks)}) AS d")
    return out.select(
        "pipeline_id",
        F.col("id").alias("job_id"),
        F.col("d.sink_id").alias("sink_id"),
        F.col("d.scope").alias("scope"),
        F.col("d.step_id").alias("step_id"),
        F.col("d.status").alias("status"),
        F.col("d.steps").alias("steps"),
        F.col("d.duration_ms").alias("duration_ms"),
        F.col("_steps_raw").alias("step_results"),
        "payload", "source", "labels", "correlation_key",
        F.col("status").alias("pipeline_status"),
    )
