"""Merge by expression in batch.

An arriving job joins the first open group, in creation order, that holds a member ``a`` with ``expr(a, b)``; else
it opens a group. A group lives one timeout from its first job and is emitted once every source is in it.

The predicate is a SQL expression over ``a`` and ``b`` and is evaluated by Spark: a job can only join members that
arrived at most one timeout before it, so pairs are found by a range join over time buckets of that width (a block
is spread over its buckets), and only pairs that match, or fail to evaluate, are kept. A gap longer than the
timeout ends every open group of a block, so blocks are cut there and their pieces are folded in parallel, over
narrow rows (order number, time, source, matching numbers). Jobs are numbered and cut in range partitions, and a fold
holds open groups only; one piece is one task. Results depend on arrival order only.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobframe.operators.merge import sort_members
from jobframe.operators.steps import lit
from jobframe.session import checkpoint_dir, lenient

FOLDED = "key string, n long, grp long, complete boolean"


def _fold(n_sources: int, limit: int):
    """Rows sorted by (key, piece, n) -> the group of each kept job and whether it was completed. Pieces follow each
    other in one pass; only open groups are held: one is given out when it is complete or its time is over."""

    def run(batches):
        import pandas as pd

        piece, live, owner, made, out = None, {}, {}, 0, []  # live: open groups in creation order

        def close(grp, complete):
            for n in live.pop(grp)["members"]:
                del owner[n]
                out.append((piece[0], n, piece[1] * (1 << 32) + grp, complete))

        for rows in batches:
            for key, part, n, t, source, hits in zip(*(rows[c].tolist() for c in ("key", "piece", "n", "t", "bit", "hits"))):
                if piece != (key, part):
                    for grp in list(live):
                        close(grp, False)
                    piece, made = (key, part), 0
                while live and not t - live[first := next(iter(live))]["t0"] <= limit:
                    close(first, False)
                found = {h["n"]: h["ok"] for h in hits} if hits is not None else {}
                target = min((owner[m] for m in found if m in owner), default=None)
                if target is None:
                    target, made = made, made + 1
                    live[target] = {"t0": t, "members": [], "sources": set()}
                # members are asked in order of arrival: one that fails to evaluate drops the job
                elif found[next(m for m in live[target]["members"] if m in found)] is None:
                    continue
                group = live[target]
                if source in group["sources"]:
                    continue
                group["members"].append(n)
                group["sources"].add(source)
                owner[n] = target
                if len(group["sources"]) == n_sources:
                    close(target, True)
            if out:
                yield pd.DataFrame(out, columns=["key", "n", "grp", "complete"])
                out.clear()
        for grp in list(live):
            close(grp, False)
        if out:
            yield pd.DataFrame(out, columns=["key", "n", "grp", "complete"])

    return run


def _numbered(base: DataFrame, limit: int, order: tuple[str, ...], parts: int) -> tuple[DataFrame, DataFrame]:
    """(``base`` with _n, narrow rows with _piece): _n rises with arrival within a _key, and a _piece ends where no job
    arrives for longer than ``limit``.

    Rows lie in range partitions by key and arrival, so no task holds a whole key. Cuts are counted within a partition;
    one summary row for each partition and key gives the cuts before it."""
    checkpoint_dir(base.sparkSession)
    rows = (base.repartitionByRange(parts, "_key", *order, "id").sortWithinPartitions("_key", *order, "id")
            .withColumns({"_n": F.monotonically_increasing_id(), "_pid": F.spark_partition_id()})
            .checkpoint(eager=True))
    here, before = Window.partitionBy("_pid", "_key").orderBy("_n"), Window.partitionBy("_key").orderBy("_pid")
    late = lambda gap: F.coalesce((gap > limit).cast("bigint"), F.lit(0).cast("bigint"))
    own = (rows.select("_pid", "_key", "_n", "_t", "_bit").withColumn("_cut", late(F.col("_t") - F.lag("_t").over(here)))
           .withColumn("_own", F.sum("_cut").over(here)))
    ends = (own.groupBy("_pid", "_key").agg(F.min("_t").alias("_first"), F.max("_t").alias("_last"), F.sum("_cut").alias("_cuts"))
            .withColumn("_step", late(F.col("_first") - F.lag("_last").over(before)) + F.lag("_cuts", 1, 0).over(before))
            .select("_pid", "_key", F.sum("_step").over(before).alias("_base")))
    narrow = own.join(ends, ["_pid", "_key"]).select("_key", (F.col("_own") + F.col("_base")).alias("_piece"), "_n", "_t", "_bit")
    return rows.drop("_pid"), narrow


#: Expressions that two sides of an equality may be made of to become join keys: plain values of one job.
_PLAIN = ("UnresolvedAttribute", "UnresolvedExtractValue", "Cast", "Literal", "Add", "Subtract", "Multiply")


def equal_sides(spark, expr: str) -> list[tuple[str, str]]:
    """(side of ``a``, side of ``b``) as SQL texts of the equalities that ``expr`` is a conjunction of, by Spark's parser."""
    found: list[tuple[str, str]] = []

    def roots(node) -> set:
        kind = node.getClass().getSimpleName()
        if kind not in _PLAIN:
            return {None}
        if kind == "UnresolvedAttribute":
            return {node.nameParts().head()}
        children = node.children()
        return set().union(*(roots(children.apply(i)) for i in range(children.size())))

    def walk(node) -> None:
        kind = node.getClass().getSimpleName()
        if kind == "And":
            walk(node.left())
            walk(node.right())
        elif kind == "EqualTo":
            sides = {frozenset(roots(x)): x.sql() for x in (node.left(), node.right())}
            if set(sides) == {frozenset("a"), frozenset("b")}:
                found.append((sides[frozenset("a")], sides[frozenset("b")]))

    walk(spark._jsparkSession.sessionState().sqlParser().parseExpression(expr))
    return found


def _near(left: DataFrame, right: DataFrame, expr: str) -> DataFrame:
    """Pairs of a bucket that ``expr`` may be true or NULL for.

    Equalities of the expression are join keys. It is NULL, not false, only where they hold or one of their sides is
    NULL, so rows with such a side are paired with the whole bucket, and all others by their keys alone."""
    right = right.withColumnsRenamed({"_key": "_rkey", "_bucket": "_rbucket"})
    same = (F.col("_key") == F.col("_rkey")) & (F.col("_bucket") == F.col("_rbucket"))
    spark = left.sparkSession
    with lenient(spark):
        sides = equal_sides(spark, expr)
        keyed_left = left.selectExpr("*", *[f"{x} AS _l{i}" for i, (x, _) in enumerate(sides)])
        keyed_right = right.selectExpr("*", *[f"{x} AS _r{i}" for i, (_, x) in enumerate(sides)])
    plain = lambda df, c: isinstance(df.schema[c].dataType, T.AtomicType | T.NumericType) and not isinstance(
        df.schema[c].dataType, T.VariantType | T.NullType)
    keys = [i for i in range(len(sides)) if plain(keyed_left, f"_l{i}") and plain(keyed_right, f"_r{i}")]
    if not keys:
        return left.join(right, same).drop("_rkey", "_rbucket")
    lacks = lambda p: reduce(or_, [F.col(f"{p}{i}").isNull() for i in keys])
    equal = reduce(and_, [F.expr(f"_l{i} = _r{i}") for i in keys])
    parts = [keyed_left.join(keyed_right, same & equal), keyed_left.where(lacks("_l")).join(keyed_right, same),
             keyed_left.where(~lacks("_l")).join(keyed_right.where(lacks("_r")), same)]
    return reduce(DataFrame.unionByName, parts).select(*left.columns, "_bn", "_bt", "b")


def theta_groups(jobs: DataFrame, sources: list[str], expr: str, timeout_secs: int, block: str | None = None,
                 payload_schema: str | None = None,
                 order: tuple[str, ...] = ("arrival_ts", "arrival_seq")) -> tuple[DataFrame, DataFrame]:
    """(groups, rest): complete groups (key, round, members by arrival), and the kept jobs of groups that never
    became complete (id, source), with those whose block key is NULL.

    ``expr`` sees ``a`` (a member) and ``b`` (the arriving job) with id, source, payload (parsed with
    ``payload_schema`` if given, else VARIANT), labels and correlation_key. ``block`` names a column whose equality is
    part of the expression; without it all jobs form one block, whose pairs are still found bucket by bucket, and within
    a bucket by the equalities that the expression is a conjunction of."""
    limit = max(int(timeout_secs), 1) * 1_000_000
    key = F.col(block).cast("string") if block else F.lit("")
    base = jobs.where(F.col("source").isin(sources)).withColumn("_key", key)
    bit = F.array_position(F.array(*map(F.lit, sources)), F.col("source"))
    at = F.unix_micros(F.col(order[0]).cast("timestamp"))
    seq, narrow = _numbered(base.where("_key IS NOT NULL").withColumn("_t", at).withColumn("_bit", bit), limit, order,
                            int(jobs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parsed = f"from_json(payload, {lit(payload_schema)})" if payload_schema else "try_parse_json(payload)"
    job = f"named_struct('id', id, 'source', source, 'payload', {parsed}, 'labels', labels, 'correlation_key', correlation_key)"
    bucket = F.floor(F.col("_t") / limit)
    left = seq.select("_key", F.explode(F.array(bucket, bucket + 1)).alias("_bucket"), F.col("_n").alias("_an"),
                      F.col("_t").alias("_at"), F.expr(job).alias("a"))
    right = seq.select("_key", bucket.alias("_bucket"), F.col("_n").alias("_bn"), F.col("_t").alias("_bt"),
                       F.expr(job).alias("b"))
    near = _near(left, right, expr).where(
        (F.col("_an") < F.col("_bn")) & (F.col("_bt") - F.col("_at") <= limit))
    with lenient(jobs.sparkSession):  # an expression that fails on a pair is NULL
        pairs = near.selectExpr("_key", "_bn", "_an", f"CAST(({expr}) AS BOOLEAN) AS ok").where("ok IS NULL OR ok")
    hits = pairs.groupBy("_key", F.col("_bn").alias("_n")).agg(
        F.collect_list(F.struct(F.col("_an").alias("n"), "ok")).alias("hits"))
    narrow = (narrow.join(hits, ["_key", "_n"], "left")
              .select(F.col("_key").alias("key"), F.col("_piece").alias("piece"), F.col("_n").alias("n"),
                      F.col("_t").alias("t"), F.col("_bit").alias("bit"), "hits"))
    folded = (narrow.repartition("key", "piece").sortWithinPartitions("key", "piece", "n")
              .mapInPandas(_fold(len(sources), limit), FOLDED))
    kept = seq.join(folded.withColumnsRenamed({"key": "_key", "n": "_n"}), ["_key", "_n"])
    member = F.struct(*[F.col(c) for c in order], "source", "id", "payload", "labels")
    groups = (kept.where("complete").groupBy(F.col("_key").alias("key"), F.col("grp").alias("round"))
              .agg(sort_members(F.collect_list(member), order).alias("members")))
    rest = kept.where("NOT complete").select("id", "source").unionByName(
        base.where("_key IS NULL").select("id", "source"))
    return groups, rest
