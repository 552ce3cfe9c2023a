"""Bounded labelled samples and small models that the classifiers share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled documents that a classifier is fit on at most.
SAMPLE_ROWS = 20_000


def held_out(doc_id):
    """Column: whether crc32 of the id's text leaves no rest by 5; such rows' labels are never learnt."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, limit: int = SAMPLE_ROWS) -> DataFrame:
    """(text, label): at most ``limit`` labelled documents that are not held out, in an order of hashes, one for each
    distinct text; an id with several labels counts as 1 if any is. Null ids, labels and texts take no part.

    The ids are few (``limit``) and are broadcast, so no text is shuffled but those of the sample."""
    ids = (labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & ~held_out(F.col("doc_id")))
           .groupBy("doc_id").agg(F.max(column).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    return (found.where("text is not null").groupBy(F.xxhash64("text").alias("h"))
            .agg(F.first("text").alias("text"), F.max("label").cast("int").alias("label")).select("text", "label"))


def fit_logistic(x, y, ridge: float = 1.0, rounds: int = 30):
    """Ridge logistic regression by Newton's method; returns weights with the constant last."""
    import numpy as np

    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    if not len(y):
        return w
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + keep * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(keep)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
