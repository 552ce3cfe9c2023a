import math
from fractions import Fraction

import numpy as np
import pytest

from jobframe.llm import whitening
from jobframe.llm.queries import op12_whitening

SF = "/root/testdata/sf0.001"


def table(spark, rows, extra=""):
    names = extra.split()
    schema = "vec_id bigint, embedding array<double>" + "".join(f", {n} bigint" for n in names)
    return spark.createDataFrame([r + (7,) * len(names) for r in rows], schema)


def brute(rows, k=8):
    """Exact count, sums and deviations, and the covariance's eigenpairs by a plain solver."""
    kept = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in kept]
    n, dims = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(dims)]
    dev = [sum((n * r[j] - sums[j]) ** 2 for j in range(dims)) for r in x]
    c = np.array([[float(Fraction(n * r[j] - sums[j], n)) for j in range(dims)] for r in x])
    values, vectors = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(values)[::-1][:k]
    return [i for i, _ in kept], n, dev, c, values[order], vectors[:, order], values.sum()


def check(got, rows):
    ids, n, dev, c, values, vectors, trace = brute(rows)
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], []).append(r)
    assert sorted(map(str, (r["vec_id"] for r in got))) == sorted(map(str, ids))
    for i, d in zip(ids, dev):
        assert any(r["deviation"] == d and r["n"] == n for r in by[i])
    assert np.allclose([r["explained"] for r in got], values / trace, rtol=1e-9)
    assert all(r["identity_error"] < 1e-9 for r in got)
    want = c @ vectors / np.sqrt(values)
    if len(set(ids)) == len(ids):
        have = np.array([by[i][0]["whitened"] for i in ids])
        sign = np.sign((have * want).sum(0))
        assert np.abs(have * sign - want).max() < 1e-7


def test_rank_one_against_a_plain_solver():
    rng = np.random.default_rng(2)
    for k in (1, 2, 6, 17):
        for _ in range(40):
            d = np.sort(rng.integers(0, 4, size=(5, k)) * rng.choice([1.0, 1e-9, 1e6]), axis=1).astype(float)
            p = np.stack([np.linalg.qr(rng.normal(size=(k, k)))[0] for _ in range(5)])
            v = rng.normal(size=(5, k)) * (rng.random((5, k)) < 0.7)
            rho = rng.choice([0.0, 0.5, 3.0], size=5)
            dn, pn = whitening.rank_one(d, p, v, rho)
            for g in range(5):
                want = p[g].T @ np.diag(d[g]) @ p[g] + rho[g] * np.outer(v[g], v[g])
                scale = max(np.abs(want).max(), 1e-300)
                assert np.abs(pn[g].T @ np.diag(dn[g]) @ pn[g] - want).max() <= 1e-12 * scale
                assert np.abs(pn[g] @ pn[g].T - np.eye(k)).max() < 1e-12 and (np.diff(dn[g]) >= 0).all()


def test_spectra_combine_to_the_scatter_of_all_rows():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 9)) * np.arange(1, 10) + 1e5
    x[50:120] = x[3]
    x[:, 4] = 7.0
    for streams in (1, 3, 7):
        s = whitening.Spectra(streams, 9)
        s.take(x)
        s = s.one()
        c = x - x.mean(0)
        assert s.n[0] == 400 and np.allclose(s.mean[0], x.mean(0), rtol=1e-12)
        assert np.abs(s.p[0].T @ np.diag(s.d[0]) @ s.p[0] - c.T @ c).max() < 1e-10 * np.abs(c.T @ c).max()


def test_whitening_against_brute_force_over_partitions(spark):
    rng = np.random.default_rng(6)
    mix = rng.normal(size=(12, 12))
    rows = [(i, [float(c) for c in rng.normal(size=12) @ mix]) for i in range(600)]
    rows += [(600 + i, rows[5][1]) for i in range(300)]  # a third of all rows are copies
    bad = [(2000, None), (2001, []), (2002, [None] * 12), (2003, [float("nan")] * 12), (2004, [math.inf] + [0.0] * 11),
           (None, rows[9][1]), (2005, [1.0] * 5)]
    df = table(spark, rows + bad, extra="id v n part deviation whitened x").repartition(40)
    fold = whitening.FAN
    try:
        whitening.FAN = 3  # several levels of the tree
        got = whitening.whiten(df).collect()
    finally:
        whitening.FAN = fold
    check(got, rows + [(None, rows[9][1])])


def test_query_on_the_given_table(spark):
    emb = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    rows = [(r["vec_id"], None if r["embedding"] is None else list(r["embedding"])) for r in emb]
    got = op12_whitening(spark, SF)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    by = {}
    for r in got.collect():
        by.setdefault((r["vec_id"], r["n"], r["deviation"], r["identity_error"]), {})[r["component"]] = r

    class Row(dict):
        pass

    folded = [Row(vec_id=v, n=n, deviation=d, identity_error=e, whitened=[c[j]["whitened"] for j in range(1, 9)],
                  explained=[c[j]["explained"] for j in range(1, 9)]) for (v, n, d, e), c in by.items()]
    check(folded, rows)


def test_odd_tables(spark):
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [(1, None), (2, [])])).count() == 0
    one = whitening.whiten(table(spark, [(1, [0.5, 0.25, 1.0])])).first()  # no variance at all
    assert one["deviation"] == 0 and one["whitened"] == [None] * 3 and one["explained"] == [None] * 3
    assert one["identity_error"] is None
    rows = whitening.whiten(table(spark, [(i, [float(i), 2.0, -float(i)]) for i in range(4)])).collect()  # rank one
    for r in rows:
        assert r["whitened"][1:] == [None, None] and r["explained"][0] == pytest.approx(1) and r["identity_error"] < 1e-12
    huge = table(spark, [(1, [1e300, 0.0]), (2, [1.0, 2.0]), (3, [3.0, 5.0])])  # x leaves 62 bits: takes no part
    assert {r["vec_id"] for r in whitening.whiten(huge).collect()} == {2, 3}
    far = whitening.whiten(table(spark, [(1, [1e12, 0.0]), (2, [-1e12, 2.0])])).collect()  # deviation leaves 64 bits
    assert [r["deviation"] for r in far] == [None, None] and abs(far[0]["whitened"][0]) == pytest.approx(1)


def test_order_of_equal_vectors(spark):
    rows = [(i, [1.0, 2.0]) for i in range(5)]
    got = whitening.whiten(table(spark, rows)).collect()
    assert len(got) == 5 and all(r["deviation"] == 0 and r["whitened"] == [None, None] for r in got)
