"""Removal detection and cancellation.

All of these are joins: anti joins between snapshots, and an existence join of
jobs against time-stamped signals. Keys are job ids, so no key is hot on the job
side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobframe.spec import DEFAULT_CANCEL_TTL_SECS

from jobframe.messages import CANCEL_PREFIX  # noqa: E402  (fixed id prefix of a cancellation record)


def removed_ids(prev: DataFrame, cur: DataFrame, keys=("file", "id")) -> DataFrame:
    """Ids present in the previous snapshot of a file but not in the current one.

    An empty current snapshot cancels everything (divergence D5: the
    orchestrator ignored zero-byte snapshots)."""
    keys = list(keys)
    return prev.select(*keys).distinct().join(cur.select(*keys), keys, "left_anti")


def deleted_file_ids(prev: DataFrame, current_files: DataFrame, file_col: str = "file") -> DataFrame:
    """All ids of files that vanished from the listing."""
    return prev.join(current_files.select(file_col).distinct(), file_col, "left_anti")


def cancellations(removed: DataFrame, source: str | None = None, id_col: str = "id") -> DataFrame:
    """Cancellation records for removed ids (a separate DataFrame, not in-band marker jobs)."""
    out = removed.select(
        F.concat(F.lit(CANCEL_PREFIX), F.col(id_col)).alias("cancel_id"),
        F.col(id_col).alias("target_job_id"),
        *[c for c in removed.columns if c != id_col],
    )
    if source is not None:
        out = out.withColumn("source", F.lit(source))
    return out


def apply_cancellations(jobs: DataFrame, signals: DataFrame, ttl_secs: int = DEFAULT_CANCEL_TTL_SECS,
                        job_id: str = "id", start_col: str = "start_ts", sig_id: str = "job_id",
                        sig_ts: str = "signal_ts") -> tuple[DataFrame, DataFrame]:
    """C4: split ``jobs`` into (runnable, cancelled).

    A job is cancelled when a signal for its id exists with
    ``signal_ts <= start_ts`` and ``start_ts - signal_ts <= ttl`` (TTL at least 1 s).
    Signals are keyed by job id only, so they hit every pipeline the job fans
    out to (divergence D4).
    """
    marked = mark_cancellations(jobs, signals, ttl_secs, job_id, start_col, sig_id, sig_ts)
    return (marked.where(~F.col("cancelled")).drop("cancelled"),
            marked.where(F.col("cancelled")).drop("cancelled"))


def mark_cancellations(jobs: DataFrame, signals: DataFrame, ttl_secs: int = DEFAULT_CANCEL_TTL_SECS,
                       job_id: str = "id", start_col: str = "start_ts", sig_id: str = "job_id",
                       sig_ts: str = "signal_ts") -> DataFrame:
    """C4 in one pass: ``jobs`` plus a boolean ``cancelled`` column.

    One existence join on the job id with the time range as its condition: each side is shuffled once, a job with
    many signals keeps one row, and a NULL id or time is never cancelled."""
    ttl = max(int(ttl_secs), 1)
    sent = signals.select(F.col(sig_id).alias("_sid"), F.col(sig_ts).alias("_sts"))
    start = F.col(start_col).outer()
    hit = sent.where((F.col("_sid") == F.col(job_id).outer()) & (F.col("_sts") <= start)
                     & (F.col("_sts") >= start - F.expr(f"INTERVAL {ttl} SECONDS"))).exists()
    return jobs.select("*", hit.alias("cancelled"))


def live_signals(signals: DataFrame, completions: DataFrame, sig_id: str = "job_id", sig_ts: str = "signal_ts",
                 done_id: str = "job_id", done_ts: str = "completed_ts") -> DataFrame:
    """A signal is consumed once a job with that id completes at or after it.

    "Some completion is at or after the signal" is "the latest completion is", so
    completions reduce to one row per job id with a partial aggregate before the
    single join (a job id with very many completions costs one row per map task)."""
    latest = completions.groupBy(F.col(done_id).alias("_jid")).agg(F.max(done_ts).alias("_last"))
    j = signals.join(latest, signals[sig_id] == latest["_jid"], "left")
    return j.where(F.col("_last").isNull() | (F.col("_last") < F.col(sig_ts))).drop("_jid", "_last")
