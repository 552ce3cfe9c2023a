"""Run pipelines on streams.

The batch operators are pure DataFrame → DataFrame functions, so a stream reuses
them inside ``foreachBatch``. Each micro-batch writes its deliveries, state events
and rejects into an ``epoch=<id>`` folder with overwrite: a micro-batch replayed
after a failure rewrites the same folder, so output is exactly-once per epoch even
though delivery to external systems stays at-least-once (ST5).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobframe.operators.cancel import mark_cancellations
from jobframe.operators.dispatch import deliveries, run_duration
from jobframe.operators.state import run_events
from jobframe.plans.pipeline import run_pipeline
from jobframe.spec import DEFAULT_CANCEL_TTL_SECS, PipelineSpec


def pipeline_batch(jobs: DataFrame, spec: PipelineSpec, out: str, epoch_id: int,
                   enabled_sinks: set[str] | None = None, signals: DataFrame | None = None,
                   ttl_secs: int = DEFAULT_CANCEL_TTL_SECS, start_col: str = "arrival_ts") -> None:
    """One micro-batch: cancel (W4, stream-static range join), run, dispatch, and
    write per sink and epoch. Frames written more than once are persisted for the
    duration of the micro-batch so each is computed once."""
    held = []
    cancelled = None
    every = jobs
    if signals is not None:
        marked = mark_cancellations(jobs.withColumn("start_ts", F.col(start_col)), signals, ttl_secs).persist()
        held.append(marked)
        jobs = marked.where(~F.col("cancelled")).drop("cancelled", "start_ts")
        cancelled = marked.where(F.col("cancelled"))
        every = marked
    try:
        res = run_pipeline(jobs, spec).persist()
        held.append(res)
        d = deliveries(res, spec, enabled_sinks)
        d.select("sink_id", "pipeline_id", "job_id", "scope", "step_id", "status",
                 F.array_join("steps", ",").alias("steps")).write.mode("overwrite").partitionBy("sink_id").parquet(
            f"{out}/deliveries/epoch={epoch_id}")
        if cancelled is not None:
            cancelled.select("id").write.mode("overwrite").parquet(f"{out}/cancelled/epoch={epoch_id}")
        # state log (ST1, ST2, W7): the same events as a batch writes
        at = start_col if start_col in every.columns else "_now"
        now = F.current_timestamp()
        stamp = (lambda df: df) if at == start_col else (lambda df: df.withColumn("_now", now))
        events = run_events(stamp(every), spec.id, at, None if cancelled is None else stamp(cancelled), stamp(res),
                            run_duration(spec, "steps"))
        events.write.mode("overwrite").parquet(f"{out}/state/epoch={epoch_id}")
    finally:
        for h in held:
            h.unpersist()


def start_pipeline_stream(jobs: DataFrame, spec: PipelineSpec, out: str, checkpoint: str,
                          enabled_sinks: set[str] | None = None, signals: DataFrame | None = None,
                          trigger: dict | None = None):
    """Continuous intake (``trigger(processingTime=...)``) or catch-up (``availableNow``).
    Back-pressure (W2) comes from the source's ``maxFilesPerTrigger`` / ``maxBytesPerTrigger``."""
    w = jobs.writeStream.foreachBatch(
        lambda df, epoch: pipeline_batch(df, spec, out, epoch, enabled_sinks, signals)
    ).option("checkpointLocation", checkpoint)
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()
