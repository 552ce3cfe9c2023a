"""Query catalogue: every registered query reads the driver tables and runs a
jobframe operator over the whole table. Each has (when SQL can express it) an
equivalent DuckDB SQL oracle with the same column names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from jobframe.session import ensure_runtime

            ensure_runtime(spark)
            return fn(spark, sf_dir)

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one driver table.

    A scan that yields fewer splits than the cluster has cores (one small file,
    one row group) is spread round-robin so row-local pipeline work uses every
    core. Large inputs already split into many scan partitions and are left
    alone: no extra shuffle at scale. Projections and filters are pushed below
    the repartition by Catalyst, so only the needed columns move.
    """
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df)


def spread(df: DataFrame) -> DataFrame:
    """Hash-partition by a row ordinal (stable for a re-run task over the same
    split) instead of round-robin, which sorts every partition first."""
    from pyspark.sql import functions as F

    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return (df.withColumn("_spread", F.monotonically_increasing_id())
                .repartition(cores, "_spread").drop("_spread"))
    return df


def load_all() -> None:
    """Import the modules that register queries."""
    from jobframe.plans import (  # noqa: F401
        queries_admit,
        queries_core,
        queries_flow,
        queries_policy,
        queries_sinks,
        queries_state,
        queries_steps,
    )
