"""Fan-out of jobs to the pipelines that consume their source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobframe.operators.envelope import overlay_labels
from jobframe.spec import PipelineSpec

ROUTE_SCHEMA = T.StructType([
    T.StructField("source", T.StringType(), False),
    T.StructField("pipeline_id", T.StringType(), False),
    T.StructField("pipeline_labels", T.MapType(T.StringType(), T.StringType()), False),
])


def route_table(spark: SparkSession, pipelines: list[PipelineSpec]) -> DataFrame:
    """(source, pipeline) pairs from the pipeline specs.

    Its size is the number of configured (source, pipeline) pairs – a property of
    the configuration, not of the data – which is what makes broadcasting it safe.
    """
    rows = [(src, p.id, dict(p.labels)) for p in pipelines for src in p.sources]
    return spark.createDataFrame(rows, ROUTE_SCHEMA)


def fan_out(jobs: DataFrame, routes: DataFrame) -> DataFrame:
    """J1 + P3: one row per (job, consuming pipeline), labels overlaid per pair
    (divergence D2: no leak between pipelines)."""
    j = jobs.join(F.broadcast(routes), "source", "inner")
    return j.withColumn("labels", overlay_labels(F.col("labels"), F.col("pipeline_labels"))).drop("pipeline_labels")


def unrouted(jobs: DataFrame, routes: DataFrame) -> DataFrame:
    """Jobs whose source no pipeline consumes (dropped with a warning upstream)."""
    return jobs.join(F.broadcast(routes.select("source").distinct()), "source", "left_anti")


__all__ = ["route_table", "fan_out", "unrouted"]
