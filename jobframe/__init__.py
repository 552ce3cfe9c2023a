"""jobframe: record pipelines on Spark DataFrames.

Every operator is a function from DataFrame to DataFrame built from Spark SQL
expressions, so the same pipeline runs in batch and inside Structured Streaming
``foreachBatch`` / stateful operators.
"""

from jobframe.session import checkpoint_dir, get_spark  # noqa: F401
from jobframe.spec import (  # noqa: F401
    ConditionStep,
    FailurePolicy,
    MapStep,
    MergeSpec,
    OutputField,
    Outputs,
    PipelineSpec,
    Route,
    TransformStep,
)



def run_pipeline(jobs, spec):
    """Run job rows through a pipeline spec (see ``jobframe.plans.pipeline``)."""
    from jobframe.plans.pipeline import run_pipeline as _run

    return _run(jobs, spec)


def deliveries(results, spec, enabled_sinks=None):
    """Delivery rows of pipeline results (see ``jobframe.operators.dispatch``)."""
    from jobframe.operators.dispatch import deliveries as _d

    return _d(results, spec, enabled_sinks)


__all__ = [
    "run_pipeline",
    "deliveries",
    "get_spark",
    "checkpoint_dir",
    "ConditionStep",
    "FailurePolicy",
    "MapStep",
    "MergeSpec",
    "OutputField",
    "Outputs",
    "PipelineSpec",
    "Route",
    "TransformStep",
]
