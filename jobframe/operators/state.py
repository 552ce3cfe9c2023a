"""Job-state table (ST1–ST5) as an append-only event log plus a latest-wins view.

Writes are appends of ``(job_id, pipeline_id, state, updated_at, seq, …)``
events (idempotent per event id), never in-place updates, so a lost executor
only re-appends the same events. The view is one grouped aggregate:

* a ``queued`` event is an upsert (all fields replaced);
* ``running`` / completed events update only an existing row, i.e. they count
  only after the key's first ``queued`` event. Since the key's overall latest
  event is after its first queued event whenever one exists, the current state
  is simply the latest event of keys that have at least one ``queued`` event.

Maxima of structs are partially aggregated map-side, so a hot key does not
gather its events in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACTIVE_STATES = ("queued", "running")
KEY = ["job_id", "pipeline_id"]


def latest_state(events: DataFrame, order: tuple[str, ...] = ("updated_at", "seq")) -> DataFrame:
    """Per (job, pipeline): the fields of the last ``queued`` event and the last event's state and time.

    Two maxima of one struct each (order first, then the fields): structs are compared field by field, so labels, a
    map and not comparable, go along as sorted entries."""
    queued = F.col("state") == "queued"
    fields = [c for c in ("source", "payload", "correlation_key", "labels") if c in events.columns]
    value = {c: F.array_sort(F.map_entries(c)) if c == "labels" else F.col(c) for c in fields}
    every = F.struct(*[F.col(c) for c in order], "state")
    row = F.struct(*[F.col(c) for c in order], *[value[c].alias(c) for c in fields])
    g = events.groupBy(*KEY).agg(F.max(every).alias("_last"), F.max(F.when(queued, row)).alias("_row"))
    back = {c: F.map_from_entries(F.col(f"_row.{c}")) if c == "labels" else F.col(f"_row.{c}") for c in fields}
    return g.where(F.col("_row").isNotNull()).select(
        *KEY, *[back[c].alias(c) for c in fields], F.col("_last.state").alias("state"),
        F.col(f"_last.{order[0]}").alias("updated_at"))


def recover_incomplete(latest: DataFrame) -> DataFrame:
    """ST3: jobs whose latest state is queued or running."""
    return latest.where(F.col("state").isin(*ACTIVE_STATES))


def route_recovered(recovered: DataFrame, known_pipelines: DataFrame) -> DataFrame:
    """ST4 in one pass: ``recovered`` plus ``known``, whether the job's recorded pipeline still exists."""
    kp = F.broadcast(known_pipelines.select("pipeline_id", F.lit(True).alias("known")).distinct())  # configuration-sized
    return recovered.join(kp, "pipeline_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def replay_routing(recovered: DataFrame, known_pipelines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ST4: recovered jobs go straight to their recorded pipeline (no merge, no
    labels, no size gate); an unknown pipeline sends the job to the rejects."""
    routed = route_recovered(recovered, known_pipelines)
    return routed.where("known").drop("known"), routed.where("NOT known").drop("known")


STATE_COLUMNS = ("job_id", "pipeline_id", "state", "updated_at", "seq", "source", "payload", "correlation_key", "labels")


def run_events(queued: DataFrame, pipeline_id: str, start_col: str, cancelled: DataFrame | None = None,
               results: DataFrame | None = None, duration: str = "0L") -> DataFrame:
    """ST1, ST2, W7: one log of a run, the same from a batch and from a stream: ``queued`` with all that a replay
    needs, then ``running`` and the outcome of the results (``duration`` milliseconds later), or ``cancelled``."""
    fields = {"source": "string", "payload": "string", "correlation_key": "string", "labels": "map<string,string>"}

    def event(df, state, seq, at, full=False):
        return df.select(F.col("id").alias("job_id"), F.lit(pipeline_id).alias("pipeline_id"), state.alias("state"),
                         at.alias("updated_at"), F.lit(seq).cast("bigint").alias("seq"),
                         *[(F.col(c) if full else F.lit(None)).cast(t).alias(c) for c, t in fields.items()])

    start = F.col(start_col)
    out = event(queued, F.lit("queued"), 0, start, True)
    if cancelled is not None:
        out = out.unionByName(event(cancelled, F.lit("cancelled"), 2, start))
    if results is not None:
        # millisecond arithmetic that keeps the kind of timestamp (with or without a zone)
        end = F.expr(f"`{start_col}` + make_dt_interval(0, 0, 0, ({duration}) / 1000.0BD)")
        out = out.unionByName(event(results, F.lit("running"), 1, start)).unionByName(
            event(results, F.col("status"), 2, end))
    return out


def state_event(jobs: DataFrame, state: str, ts_col: str, seq_col: str | None = None) -> DataFrame:
    """ST1/ST2 event rows for jobs (``id``, ``pipeline_id`` …) at ``ts_col``."""
    cols = [F.col("id").alias("job_id"), F.col("pipeline_id"), F.lit(state).alias("state"),
            F.col(ts_col).alias("updated_at"),
            (F.col(seq_col) if seq_col else F.lit(0)).cast("bigint").alias("seq")]
    extra = [c for c in ("source", "payload", "correlation_key", "labels") if c in jobs.columns]
    return jobs.select(*cols, *extra)
