"""Stop selection and hold/resume.

Per pipeline, a resume releases one waiting held job; a resume while nothing
waits is remembered once (a boolean flag, several early resumes collapse). With
d = +1 for a hold and −1 for a resume, y = waiting − flag + 1 follows the Lindley
recursion y_n = max(y_{n−1} + d_n, 0), y_0 = 1, whose closed form is
y_n = S_n − min(−1, min_{k≤n} S_k) with S the running sum of d. Releases so far
are holds − waiting, and the i-th hold (arrival order) is released by the event
that raises the release count to i. Waiters are released in arrival order (the
orchestrator leaves the order to the async runtime).

The running sum and running minimum are prefix scans. They are computed without
gathering a pipeline in one task: events are range-partitioned by (pipeline,
time), each partition computes local running values per pipeline segment, a
small table of per-segment totals (at most one row per partition a pipeline
spans) gives each segment its offsets, and the offsets are joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobframe.session import checkpoint_dir

ORDER = ("_ts", "_kind", "_id")


def held(results: DataFrame) -> DataFrame:
    """failed results whose pipeline or failed step asked to stop."""
    return results.where((F.col("status") == "failure") & F.col("held"))


def release_holds(holds: DataFrame, resumes: DataFrame, pipeline: str = "pipeline_id",
                  hold_ts: str = "hold_ts", hold_id: str = "job_id", resume_ts: str = "resume_ts",
                  num_partitions: int | None = None) -> DataFrame:
    """``holds`` gets ``released_ts`` (NULL while still held) and ``released_by``."""
    spark = holds.sparkSession
    parts = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the hold rows travel with their events, so the result needs no join back
    h = holds.select(F.col(pipeline).alias("_p"), F.col(hold_ts).alias("_ts"), F.lit(0).alias("_kind"),
                     F.col(hold_id).cast("string").alias("_id"), F.lit(1).alias("_d"),
                     F.struct(*[F.col(c) for c in holds.columns]).alias("_row"))
    r = resumes.select(F.col(pipeline).alias("_p"), F.col(resume_ts).alias("_ts"), F.lit(1).alias("_kind"),
                       F.lit(None).cast("string").alias("_id"), F.lit(-1).alias("_d"),
                       F.lit(None).cast(h.schema["_row"].dataType).alias("_row"))
    ev = (h.unionByName(r).repartitionByRange(parts, "_p", *ORDER)
          .withColumn("_pid", F.spark_partition_id()))
    # the segment offsets and the local running values must see the same partition
    # ids: materialise once (range bounds come from sampling, and AQE may coalesce)
    checkpoint_dir(spark)
    ev = ev.checkpoint(eager=True)

    # local running values inside each (pipeline, partition) segment: bounded by the partition
    w = Window.partitionBy("_p", "_pid").orderBy(*ORDER)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    is_hold = F.when(F.col("_kind") == 0, 1).otherwise(0)
    ev = (ev.withColumn("_ls", F.sum("_d").over(run))
          .withColumn("_lh", F.sum(is_hold).over(run)))
    ev = (ev.withColumn("_lm", F.min("_ls").over(run))
          .withColumn("_ps", F.lag("_ls").over(w))
          .withColumn("_pm", F.lag("_lm").over(w))
          .withColumn("_ph", F.lag("_lh").over(w)))

    # per-segment totals → offsets from the earlier segments of the same pipeline
    seg = ev.groupBy("_p", "_pid").agg(F.sum("_d").alias("_ss"), F.min("_ls").alias("_sm"),
                                       F.sum(is_hold).alias("_sh"))
    ws = Window.partitionBy("_p").orderBy("_pid")
    before = ws.rowsBetween(Window.unboundedPreceding, -1)
    seg = (seg.withColumn("_S0", F.coalesce(F.sum("_ss").over(before), F.lit(0)))
           .withColumn("_H0", F.coalesce(F.sum("_sh").over(before), F.lit(0))))
    seg = seg.withColumn("_M0", F.min(F.col("_S0") + F.col("_sm")).over(before))  # NULL for the first
    # at most one row per (pipeline, partition): bounded by the partition count
    ev = ev.join(F.broadcast(seg.select("_p", "_pid", "_S0", "_H0", "_M0")), ["_p", "_pid"])

    def waiting(s, m):
        y = s - F.least(F.lit(-1), m)
        return F.greatest(y - 1, F.lit(0))

    s_now = F.col("_S0") + F.col("_ls")
    m_now = F.least(F.coalesce(F.col("_M0"), s_now), F.col("_S0") + F.col("_lm"))
    holds_now = F.col("_H0") + F.col("_lh")
    s_prev = F.col("_S0") + F.coalesce(F.col("_ps"), F.lit(0))
    m_prev = F.when(F.col("_pm").isNull(), F.col("_M0")).otherwise(
        F.least(F.coalesce(F.col("_M0"), F.col("_S0") + F.col("_pm")), F.col("_S0") + F.col("_pm")))
    holds_prev = F.col("_H0") + F.coalesce(F.col("_ph"), F.lit(0))
    released_now = holds_now - waiting(s_now, m_now)
    released_prev = F.when(m_prev.isNull(), F.lit(0)).otherwise(holds_prev - waiting(s_prev, m_prev))
    ev = ev.select("*", released_now.alias("_rel"), released_prev.alias("_relp"), holds_now.alias("_n"))

    fire = ev.where(F.col("_rel") > F.col("_relp")).select(
        "_p", F.col("_rel").alias("_n"), F.col("_ts").alias("released_ts"),
        F.when(F.col("_kind") == 0, F.lit("flag")).otherwise(F.lit("resume")).alias("released_by"))
    numbered = ev.where(F.col("_kind") == 0).select("_p", "_n", "_row")
    return numbered.join(fire, ["_p", "_n"], "left").select("_row.*", "released_ts", "released_by")
