"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobframe.session import checkpoint_dir, ship_package

#: Largest number of rows that a table may have to be broadcast; beyond it the callers shuffle.
BROADCAST_ROWS = 200_000


#: Rows of an Arrow batch: a worker holds one batch of whole texts at a time.
BATCH_ROWS = 500


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder in ``spark.checkpoint.dir``; survives lost executors."""
    checkpoint_dir(df.sparkSession)
    ship_package(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``."""
    import uuid

    return os.path.join(checkpoint_dir(spark).rstrip("/"), f"{name}-{uuid.uuid4().hex}")


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether a (checkpointed) table has at most ``limit`` rows; reads no more than it must."""
    return df.limit(limit + 1).count() <= limit


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a checkpointed table of checked size; a larger one is joined by a shuffle."""
    return F.broadcast(df) if small(df, limit) else df


def free_name(columns, name: str) -> str:
    """``name``, or a longer one that is not among ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def give_back() -> None:
    """Hand freed memory back to the system at a task's end: Python workers stay, and what one stage needed at its
    peak would otherwise stay with them."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):  # glibc
        libc.malloc_trim(0)


#: Byte tables for ``bytes.translate``: A-Z lower-cased, bytes outside words turned into blanks.
#: Letters, digits and every byte of a multi-byte character belong to words.
_ALNUM = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def alnum_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text with A-Z lower-cased; none for null."""
    return text.translate(_ALNUM).split() if text else []


def blank_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a UTF-8 text with A-Z lower-cased; none for null."""
    return text.lower().split() if text else []


def binary_column(batch, name: str) -> list:
    """A string column of an Arrow batch as a list of UTF-8 bytes."""
    import pyarrow as pa

    col = batch.column(name)
    return col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()
