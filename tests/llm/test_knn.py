import random

import numpy as np
from pyspark.sql import functions as F

from jobframe.llm import knn

SCHEMA = "vec_id bigint, embedding array<float>, label int, v bigint, cell bigint, score bigint"


def brute(rows, k, divisor):
    ok = []
    for i, e, *_ in rows:
        if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e):
            v = [int(np.floor(64 * float(np.float32(x)))) for x in e]
            if all(abs(x) < 2**31 for x in v):
                ok.append((i, v))
    out, seen = [], set()
    for i, q in ok:
        if i % divisor or (i, tuple(q)) in seen:
            continue
        seen.add((i, tuple(q)))
        s = sorted((-sum(a * b for a, b in zip(q, x)), j) for j, x in ok if j != i)[:k]
        out += [(i, n + 1, j, -score) for n, (score, j) in enumerate(s)]
    return sorted(out)


def run(spark, rows, k=5, divisor=4, **how):
    df = spark.createDataFrame(rows, SCHEMA)
    got = knn.top_k(df, F.col("vec_id") % divisor == 0, k=k, **how).collect()
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got)


def clustered(n, d, seed, spread):
    r = np.random.RandomState(seed)
    centre = r.randn(6, d)
    v = centre[r.randint(0, 6, n)] + spread * r.randn(n, d)
    return [[float(np.float32(x)) for x in row / np.linalg.norm(row)] for row in v]


def test_matches_brute_force_on_clusters_ties_and_copies(spark):
    vs = clustered(300, 8, 1, 0.1) + clustered(100, 8, 2, 2.0)
    rows = [(i, v, 0, 0, 0, 0) for i, v in enumerate(vs)]
    rows += [(400 + i, vs[0], 0, 0, 0, 0) for i in range(150)]  # one very common vector
    for how in ({}, {"sample_rows": 20, "query_rows": 7, "data_rows": 30}):
        assert run(spark, rows, **how) == brute(rows, 5, 4)


def test_odd_rows_take_no_part(spark):
    r = random.Random(3)
    rows = [(i, [r.uniform(-2, 2) for _ in range(4)], 1, 1, 1, 1) for i in range(30)]
    rows += [(None, [1.0] * 4, 0, 0, 0, 0), (40, None, 0, 0, 0, 0), (44, [1.0, None, 0.0, 0.0], 0, 0, 0, 0),
             (48, [float("nan")] * 4, 0, 0, 0, 0), (52, [float("inf"), 0.0, 0.0, 0.0], 0, 0, 0, 0), (56, [], 0, 0, 0, 0),
             (60, [1.0, -3.0], 0, 0, 0, 0), (64, [0.0] * 4, 0, 0, 0, 0), (68, [3e30] * 4, 0, 0, 0, 0),
             (-8, [0.5] * 4, 0, 0, 0, 0), (8, rows[8][1], 1, 1, 1, 1)]
    assert run(spark, rows) == brute(rows, 5, 4)


def test_few_rows_no_queries_and_empty_table(spark):
    rows = [(4, [1.0, 2.0], 0, 0, 0, 0), (5, [1.0, 0.0], 0, 0, 0, 0), (6, [1.0, 0.0], 0, 0, 0, 0)]
    assert run(spark, rows) == brute(rows, 5, 4) and len(run(spark, rows)) == 2
    assert run(spark, rows[:1]) == [] and run(spark, rows[1:]) == [] and run(spark, []) == []


def test_large_components_are_exact(spark):
    r = random.Random(8)
    rows = [(i, [float(np.float32(r.uniform(-3e7, 3e7))) for _ in range(3)], 0, 0, 0, 0) for i in range(40)]
    assert run(spark, rows) == brute(rows, 5, 4)


def test_bounds_prune_far_cells():
    centre = np.array([[100.0, 0.0], [0.0, 100.0]])
    need, floor = knn.bounds({0: [0.0] * 3, 1: [0.0] * 3}, {0: (1.0, 101.0)}, centre, 2)
    assert need[0][1] > 50 and need[0][0] < 1.0 and floor[0] > 0


def test_repeats_of_a_query_id_hide_no_neighbours(spark):
    r = np.random.RandomState(5)
    near = [[float(np.float32(x)) for x in (3 + 0.001 * r.randn(), 0.001 * r.randn())] for _ in range(4)]
    far = [[float(np.float32(x)) for x in (0.02 * r.rand(), 3 + 0.02 * r.rand())] for _ in range(40)]
    rows = [(4, [3.0, 0.0], 0, 0, 0, 0)] * 30  # one query row, at a pivot
    rows += [(4, [3.0, 0.1 * i], 0, 0, 0, 0) for i in range(1, 4)]  # other rows of its id
    rows += [(101 + 4 * i, v, 0, 0, 0, 0) for i, v in enumerate(near)]
    rows += [(202 + 4 * i, v, 0, 0, 0, 0) for i, v in enumerate(far)]
    for how in ({}, {"sample_rows": 60, "query_rows": 3, "data_rows": 10}):
        assert run(spark, rows, **how) == brute(rows, 5, 4)


def test_bounds_count_each_id_once_over_all_cells():
    centre = np.array([[100.0, 0.0], [0.0, 100.0]])
    cells, ids = {0: [0.0, 0.0, 1.0], 1: [0.0, 1.0, 2.0]}, {0: [4, 5, 6], 1: [4, 7, 8]}
    need, _ = knn.bounds(cells, {0: (0.0, 100.0)}, centre, 3, ids)
    assert need[0][1] <= 0  # ids 4, 5, 6 and 7: the fourth bound is one of cell 1


def test_own_rows_take_no_place_in_a_task():
    import pyarrow as pa

    v = np.array([2], dtype="<i8").tobytes()
    ask = pa.table({"query_id": [4], "query_hash": [0], "query_v": [v]})
    rows = pa.table({"vec_id": [4] * 30 + [5, 6], "v": [v] * 32})
    assert knn.solve(5)(ask, rows)["vec_id"].to_pylist() == [5, 6]


def test_huge_components_take_part(spark):
    r = random.Random(9)
    vs = [[float(np.float32(r.choice([-1, 1]) * 10 ** r.uniform(0, top))) for _ in range(3)]
          for top in [3] * 30 + [8] * 30 + [13] * 30]
    rows = [(i, v, 0, 0, 0, 0) for i, v in enumerate(vs)]
    q, want = [[int(np.floor(64 * x)) for x in v] for v in vs], []
    for i in range(0, len(q), 4):
        s = sorted((-sum(a * b for a, b in zip(q[i], x)), j) for j, x in enumerate(q) if j != i)
        want += [(i, n + 1, j, -v) for n, (v, j) in enumerate([(v, j) for v, j in s if abs(v) < 2**63][:5])]
    assert max(abs(x) for v in q for x in v) > 2**40
    for how in ({}, {"query_rows": 5, "data_rows": 20}):
        assert run(spark, rows, **how) == sorted(want)
