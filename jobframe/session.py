"""Session helpers.

On a cluster the session is created by the platform; ``get_spark`` only fills in
what is missing so tests and the bench run with the same settings.
"""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Spark broadcasts what its statistics show to be smaller than this; operators broadcast only what a parameter bounds.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    # A compiled pipeline level is one wide projection. Generated methods above the
    # JVM's 8000-bytecode JIT limit would run interpreted; at this limit Spark splits
    # such stages into per-expression code instead (measured ~2x faster on deep DAGs).
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.variant.allowDuplicateKeys": "true",
}


# SQL settings the operators rely on; they are runtime settings, so they are also
# applied to a session created elsewhere (e.g. by a platform) before a query runs.
RUNTIME = {
    # driver tables store naive timestamps meant as UTC
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # of a repeated JSON key the last value holds, as in the reference's parser
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def ensure_runtime(spark: SparkSession) -> None:
    for k, v in RUNTIME.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    ship_package(spark)


@contextmanager
def lenient(spark: SparkSession):
    """Resolve user expressions so that a failing operation on a record is NULL instead of ending the job.

    Spark fixes at resolution whether an operation throws (division by zero, a bad cast, an index out of range), so
    the setting is only changed while the projection is built and is put back at once."""
    key = "spark.sql.ansi.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``jobframe`` importable by the Python workers of a local session.

    The pandas-based operators (merge scan, stateful streams, Python transforms)
    run functions of this package inside Python workers. On a cluster the
    deployment ships the package (``--py-files`` or an installed wheel); a local
    session started from any working directory gets a zip via ``addPyFile``.
    """
    sc = spark.sparkContext
    if id(sc) in _SHIPPED or not sc.master.startswith("local"):
        return
    import zipfile

    import jobframe

    pkg = os.path.dirname(os.path.abspath(jobframe.__file__))
    dest = os.path.join(tempfile.mkdtemp(prefix="jobframe-pyfiles-"), "jobframe.zip")
    with zipfile.ZipFile(dest, "w") as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(dest)
    _SHIPPED.add(id(sc))


def get_spark(master: str | None = None, partitions: int | None = None, app: str = "jobframe") -> SparkSession:
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    master = master or os.environ.get("JOBFRAME_MASTER") or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    b = SparkSession.builder.master(master).appName(app)
    for k, v in _DEFAULTS.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", str(partitions or 8))
    b = b.config("spark.driver.memory", os.environ.get("JOBFRAME_DRIVER_MEMORY", "16g"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster sets it to a shared file system. Only when it is unset (tests, a
    laptop) do we create a private scratch folder and register it.
    """
    sc = spark.sparkContext
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(conf)
        return conf
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    d = tempfile.mkdtemp(prefix="jobframe-ckpt-")
    sc.setCheckpointDir(d)
    try:
        spark.conf.set("spark.checkpoint.dir", d)
    except Exception:  # static conf on some deployments; the context setting is what counts
        pass
    return d
