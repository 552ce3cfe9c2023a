"""Table sources: pending-row claim.

The source table is read with ``spark.read`` (Parquet here; JDBC where a
database exists). A poll claims at most ``batch`` pending rows ordered by
``(created_at, id)``; Catalyst plans ``orderBy + limit`` as a
TakeOrderedAndProject, i.e. a per-partition top-k followed by a merge of k rows
per partition – the table is never sorted or gathered whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the table source contract.
STATUS_PROCESSING = "processing"
STATUS_DONE = "done"
STATUS_FAILED = "failed"
POLL_BATCH = 100


def pending(rows: DataFrame, status: str = "status", processing: str = STATUS_PROCESSING,
            done: str = STATUS_DONE, failed: str = STATUS_FAILED) -> DataFrame:
    s = F.col(status)
    return rows.where(s.isNull() | ~s.isin(processing, done, failed))


def claim_pending(rows: DataFrame, batch: int = POLL_BATCH, id_col: str = "id", created: str = "created_at",
                  status: str = "status", processing: str = STATUS_PROCESSING, done: str = STATUS_DONE,
                  failed: str = STATUS_FAILED) -> tuple[DataFrame, DataFrame]:
    """One poll: (claimed rows with status = processing, the table after the claim).

    The claim is written as a new version of the table (a left join of the
    claimed ids + ``when``), not an in-place update; the payload is parsed by the
    caller (a bad payload goes to rejects instead of stopping the source)."""
    claimed = (pending(rows, status, processing, done, failed).orderBy(F.col(created), F.col(id_col)).limit(batch)
               .withColumn(status, F.lit(processing)))
    ids = claimed.select(F.col(id_col).alias("_cid"))
    after = (rows.join(ids, rows[id_col] == ids["_cid"], "left")
             .withColumn(status, F.when(F.col("_cid").isNotNull(), F.lit(processing)).otherwise(F.col(status)))
             .drop("_cid"))
    return claimed, after
