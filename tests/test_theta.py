"""Merge by expression against a plain fold."""

import datetime as dt
import json
import random

import pytest

from jobframe.operators.merge import merge_for_pipeline
from jobframe.operators.theta import _fold, _numbered, equal_sides, theta_groups
from jobframe.spec import MapStep, MergeSpec, PipelineSpec

SCHEMA = ("id string, source string, payload string, correlation_key string, labels map<string,string>, "
          "arrival_ts timestamp, arrival_seq long")


def plain(rows, sources, match, limit):
    out, rest, state = [], [], {}
    for id_, source, payload, key, _, ts, seq in sorted(rows, key=lambda r: (r[5], r[6], r[0])):
        if source not in sources:
            continue
        if key is None:
            rest.append(id_)
            continue
        groups = state.setdefault(key, [])
        for g in [g for g in groups if (ts - g["t0"]).total_seconds() > limit]:
            groups.remove(g)
            rest += g["ids"]
        target = None
        for g in groups:
            got = [r for r in (match(m, json.loads(payload)) for m in g["bodies"]) if r is None or r]
            if got:
                target = g if got[0] else "error"
                break
        if target == "error":
            continue
        if target is None:
            target = {"t0": ts, "ids": [], "bodies": [], "sources": set()}
            groups.append(target)
        if source in target["sources"]:
            continue
        target["ids"].append(id_)
        target["bodies"].append(json.loads(payload))
        target["sources"].add(source)
        if target["sources"] == set(sources):
            out.append((key, ",".join(target["ids"])))
            groups.remove(target)
    return sorted(out), sorted(rest + [i for gs in state.values() for g in gs for i in g["ids"]])


def rows(seed, n=300, keys=3, step=40):
    r, t, out = random.Random(seed), dt.datetime(2024, 1, 1), []
    for i in range(n):
        t += dt.timedelta(seconds=r.choice([0, 1, 5, step, 3 * step]))
        v = r.choice([1, 2, 3, None])
        out.append((f"j{i}", r.choice(["a", "b", "c"]), json.dumps({"v": v} if v else {}),
                    r.choice([*map(str, range(keys)), None]), {}, t, i))
    return out


def match(a, b):
    return None if "v" not in a or "v" not in b else a["v"] <= b["v"]


@pytest.mark.parametrize("seed, keys", [(1, 3), (2, 1), (3, 20)])
def test_matches_the_plain_fold_in_any_input_order(spark, seed, keys):
    data = rows(seed, keys=keys)
    want = plain(data, ["a", "b"], match, 60)
    random.Random(seed).shuffle(data)
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    groups, rest = theta_groups(df, ["a", "b"], "a.payload.v <= b.payload.v", 60, "correlation_key", "v int")
    got = sorted((g["key"], ",".join(m["id"] for m in g["members"])) for g in groups.collect())
    assert (got, sorted(r["id"] for r in rest.collect())) == want and want[0]


def test_pipeline_without_a_block_key(spark):
    data = [(*r[:3], "x", *r[4:]) for r in rows(7, n=120)]
    spec = PipelineSpec(id="p", steps=(MapStep(id="m", set=()),), sources=("a", "b"), payload_schema="v int",
                        merge=MergeSpec("all", correlation_expr="a.payload.v <= b.payload.v", timeout_secs=60))
    merged, rejects = merge_for_pipeline(spark.createDataFrame(data, SCHEMA).where("source <> 'c'"), spec)
    want, rest = plain([r for r in data if r[1] != "c"], ["a", "b"], match, 60)
    assert merged.count() == len(want) and sorted(r["id"] for r in rejects.collect()) == rest
    assert {r["reason"] for r in rejects.collect()} == {"merge group never got all sources"}


def test_nothing(spark):
    groups, rest = theta_groups(spark.createDataFrame([], SCHEMA), ["a", "b"], "true", 60)
    assert groups.count() == rest.count() == 0


def test_one_block_is_numbered_and_cut_in_many_tasks(spark):
    from pyspark.sql import functions as F

    data = rows(4, n=800, keys=1)
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    base = df.withColumns({"_key": F.lit(""), "_bit": F.lit(1), "_t": F.unix_micros("arrival_ts")})
    seq, narrow = _numbered(base, 60_000_000, ("arrival_ts", "arrival_seq"), 8)
    sizes = [r["n"] for r in seq.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 4 and max(sizes) < 300
    assert [r["id"] for r in seq.orderBy("_n").collect()] == [r[0] for r in data]
    piece, want = 0, []
    for k, r in enumerate(data):
        piece += k > 0 and (r[5] - data[k - 1][5]).total_seconds() > 60
        want.append(piece)
    assert [r["_piece"] for r in narrow.orderBy("_n").collect()] == want and piece > 20


def test_fold_gives_groups_out_as_they_end():
    import pandas as pd

    def batches(read):
        for k in range(100):  # no gap of the time limit: one piece; odd jobs match the one before
            read.append(k)
            yield pd.DataFrame([("", 0, n, n, n % 2, [{"n": n - 1, "ok": True}] if n % 4 == 1 else None)
                                for n in range(10 * k, 10 * k + 10)], columns=["key", "piece", "n", "t", "bit", "hits"])

    read, got = [], []
    for page in _fold(2, 20)(batches(read)):
        got += page.itertuples(index=False)
        assert len(got) >= 10 * len(read) - 30  # only open groups are held back
    assert sorted(r.n for r in got) == list(range(1000))
    assert all(r.complete == (r.n % 4 < 2) for r in got)


def test_equalities_of_an_expression(spark):
    assert equal_sides(spark, "a.payload.x = b.payload.y AND (a.payload.z > 1 AND b.id = a.correlation_key)") == [
        ("a.payload.x", "b.payload.y"), ("a.correlation_key", "b.id")]
    for other in ("a.id = a.source", "a.id = 'x'", "a.id = b.id OR a.source = b.source", "a.id <=> b.id", "a.id = rand()",
                  "NOT (a.id = b.id)", "a.id = concat(a.id, b.id)"):
        assert equal_sides(spark, other) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_equalities_with_nulls_are_join_keys(spark, seed):
    """Sides that are NULL still meet the whole bucket: a pair that fails to evaluate drops the job."""
    data = rows(seed, n=160)
    df = spark.createDataFrame(data, SCHEMA)

    def match(m, b):
        same = None if m.get("v") is None or b.get("v") is None else m["v"] == b["v"]
        return False if same is False else same

    groups, rest = theta_groups(df, ["a", "b"], "a.payload.v = b.payload.v AND a.id <> b.id", 60, payload_schema="v int")
    plan = groups._jdf.queryExecution().optimizedPlan().toString()
    assert "_l0" in plan
    got = sorted(",".join(m["id"] for m in r["members"]) for r in groups.collect())
    want, left = plain([(*r[:3], "one", *r[4:]) for r in data], ["a", "b"], match, 60)
    assert got == sorted(ids for _, ids in want) and sorted(r["id"] for r in rest.collect()) == left
