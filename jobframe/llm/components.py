"""Connected components by alternating large-star and small-star rounds.

Every round is two equi joins with pre-aggregated minima, so a node with very many links is spread by AQE's skew
join, and each round is cut through the shared checkpoint folder. No links reach the driver; it sees one row with
a count and a checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobframe.llm.common import cut


def _large_star(e: DataFrame) -> DataFrame:
    n = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    m = n.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return n.where("b > a").join(m, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(e: DataFrame) -> DataFrame:
    m = e.groupBy("a").agg(F.min("b").alias("m"))
    j = e.join(m, "a")
    up = j.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return up.unionByName(m.select("a", F.col("m").alias("b"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """``links``: (a, b) of one orderable type. Returns (node, component): each node that has a link to another
    node, and the smallest node it reaches. Nodes without links, and self-links, give no row; null ends no link."""
    e = cut(links.where("a <> b")
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = now
        e = cut(_small_star(_large_star(e)))
