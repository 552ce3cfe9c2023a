"""Policy precedence, retries and back-off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed defaults of the orchestrator being re-expressed.
TASK_DEFAULT_TIMEOUT_SECS = 300
TASK_DEFAULT_BASE_DELAY_MS = 1000
TASK_DEFAULT_MAX_DELAY_MS = 30000
STEP_DEFAULT_JITTER = 0.2


def step_task_global(step: Column, task: Column, global_value) -> Column:
    """Step value, else the task value when it is set (non-zero), else global."""
    g = global_value if isinstance(global_value, Column) else F.lit(global_value)
    return F.coalesce(step, F.when(task != 0, task), g)


def effective_jitter(step: Column, task: Column, global_value: float) -> Column:
    """The first jitter in [0, 1] among step, task, global."""
    def ok(c):
        return c.isNotNull() & (c >= 0) & (c <= 1)
    return F.when(ok(step), step).when(ok(task), task).otherwise(F.lit(global_value))


def max_attempts(step: Column, task: Column, global_value: int) -> Column:
    """Attempts 1..max; 0 becomes 1."""
    return F.greatest(step_task_global(step, task, global_value), F.lit(1))


def resolve_attempts(attempts: DataFrame, keys: list[str], max_attempts_col: Column | int,
                     attempt: str = "attempt", success: str = "success", error: str = "error") -> DataFrame:
    """R1 over an attempts table: first success within the limit wins and records
    its attempt number; otherwise the last error within the limit.

    A plain grouped aggregate (partial aggregation map-side), so a key with very
    many attempts is reduced before the shuffle.
    """
    lim = max_attempts_col if isinstance(max_attempts_col, Column) else F.lit(max_attempts_col)
    a = attempts.withColumn("_lim", F.greatest(lim, F.lit(1)))
    within = F.col(attempt) <= F.col("_lim")
    g = a.groupBy(*keys).agg(
        F.min(F.when(within & F.col(success), F.col(attempt))).alias("_ok_attempt"),
        F.max_by(F.when(within & ~F.col(success), F.col(error)),
                 F.when(within & ~F.col(success), F.col(attempt))).alias("_last_error"),
        F.max(F.when(within & ~F.col(success), F.col(attempt))).alias("_last_attempt"),
    )
    return g.select(
        *keys,
        F.when(F.col("_ok_attempt").isNotNull(), F.lit("success")).otherwise(F.lit("failure")).alias("status"),
        F.coalesce(F.col("_ok_attempt"), F.col("_last_attempt")).alias("attempt"),
        F.when(F.col("_ok_attempt").isNull(), F.col("_last_error")).alias("error"),
    )


def unit_interval(*parts: Column) -> Column:
    """Deterministic U(0,1) from a hash of the parts (a retried task reproduces it)."""
    h = F.sha2(F.concat_ws("#", *[p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(float(16 ** 13))


def backoff_ms(attempt: Column, base_ms: Column | int, max_ms: Column | int, jitter: Column | float,
               u: Column) -> Column:
    """R2: min(base·2^(attempt-1), max) · (1 − clamp(jitter,0,1)·u), truncated."""
    base = base_ms if isinstance(base_ms, Column) else F.lit(base_ms)
    mx = max_ms if isinstance(max_ms, Column) else F.lit(max_ms)
    j = jitter if isinstance(jitter, Column) else F.lit(jitter)
    delay = F.least(base.cast("double") * F.pow(F.lit(2.0), (attempt - 1).cast("double")), mx.cast("double"))
    jc = F.least(F.greatest(j, F.lit(0.0)), F.lit(1.0))
    return F.when(j <= 0, delay.cast("bigint")).otherwise(F.floor(delay * (1 - jc * u)).cast("bigint"))
