"""Embedding whitening by incremental eigendecomposition.

Each task keeps spectra (count, mean, eigenvalues and eigenvectors of the centred scatter) and takes in a vector by a
centred rank-one update: the new eigenvalues are the roots of a secular equation, after deflation of directions that
the update does not touch and of equal eigenvalues. Spectra are combined by rank-one updates too, one for each
eigenpair of the other and one for the difference of the means, in a tree of groups. A Rayleigh-Ritz step over all rows,
centred on the exact mean, refines the basis to double precision. Sums are exact integers throughout.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobframe.llm.common import cut, give_back

#: Spectra that a task updates side by side at most, and the vectors that make one worth while.
SIDE_BY_SIDE, ROWS_EACH = 16, 128
#: Per-task results that one task combines.
FAN = 16
EPS = 2.0 ** -52


def _equal_rotated(d, z, p, active, tol) -> None:
    """Rotate pairs of (nearly) equal eigenvalues so that one of the two directions leaves the update."""
    import numpy as np

    every = np.arange(len(d))
    last = np.full(len(d), -1)
    for k in range(d.shape[1]):
        near = active[:, k] & (last >= 0) & (d[:, k] - d[every, last] <= tol)
        g = np.flatnonzero(near)
        if len(g):
            j = last[g]
            r = np.hypot(z[g, j], z[g, k])
            c, s = z[g, k] / r, z[g, j] / r
            dj, dk = d[g, j], d[g, k]
            d[g, j], d[g, k] = dj * c * c + dk * s * s, dj * s * s + dk * c * c
            pj, pk = p[g, j], p[g, k]
            p[g, j], p[g, k] = c[:, None] * pj - s[:, None] * pk, s[:, None] * pj + c[:, None] * pk
            z[g, j], z[g, k] = 0.0, r
            active[g, j] = False
        last = np.where(active[:, k], k, last)


def _roots(base, z2, gap, lower):
    """Offsets of the roots of 1 + sum(z2 / (d - x)) from their origins, one a row.

    ``base`` holds the poles less the root's origin, which is its left pole; a root in the right half of its interval
    is moved to its right pole (returned as a flag). Rational interpolation with the two nearest poles, kept inside a
    bracket that shrinks by the sign of the function."""
    import numpy as np

    rows = np.arange(len(base))
    right = 1 + (z2 / (base - gap[:, None] / 2)).sum(1) < 0
    base = base - np.where(right, gap, 0.0)[:, None]
    lo, hi = np.where(right, -gap / 2, 0.0), np.where(right, 0.0, gap / 2)
    x = np.where(right, lo, hi)
    left_pole = np.where(right, -gap, 0.0)
    right_pole = left_pole + gap
    todo, b, z, w = rows, base, z2, lower
    for _ in range(60):
        at = x[todo]
        delta = b - at[:, None]
        t = z / delta
        total = t.sum(1)
        f = 1 + total
        noise = 16 * EPS * (1 + total - 2 * np.einsum("ij,ij->i", t, w))  # of a sum of so large terms
        t /= delta
        both = t.sum(1)
        below = np.einsum("ij,ij->i", t, w)
        above = both - below
        neg = f < 0
        lo[todo] = np.where(neg, at, lo[todo])
        hi[todo] = np.where(neg, hi[todo], at)
        d1, d2 = left_pole[todo] - at, right_pole[todo] - at
        a, bb, c = (d1 + d2) * f - d1 * d2 * both, d1 * d2 * f, f - d1 * below - d2 * above
        root = np.sqrt(np.maximum(a * a - 4 * bb * c, 0.0))
        with np.errstate(divide="ignore", invalid="ignore"):
            new = at + np.where(a <= 0, (a - root) / (2 * c), 2 * bb / (a + root))
        bad = ~((new > lo[todo]) & (new < hi[todo]))
        new = np.where(bad, (lo[todo] + hi[todo]) / 2, new)
        done = np.abs(f) <= noise
        x[todo] = np.where(done, at, new)
        more = ~done & (np.abs(new - at) > 4 * EPS * np.abs(new))
        if not more.any():
            break
        if more.sum() < 0.8 * len(todo):
            todo = todo[more]
            b, z, w = base[todo], z2[todo], lower[todo]
    return x, right, base


def rank_one(d, p, v, rho):
    """Eigenvalues (ascending) and eigenvectors (rows) of ``p' diag(d) p + rho v v'``, for a batch of them.

    ``d`` (batch, k) ascending, ``p`` (batch, k, k) with orthonormal rows, ``v`` (batch, k), ``rho`` (batch) >= 0."""
    import numpy as np

    d, k = d.copy(), d.shape[1]
    z = np.matmul(p, v[:, :, None])[:, :, 0] * np.sqrt(rho)[:, None]
    size = (z * z).sum(1)
    tol = 8 * EPS * np.maximum(np.abs(d).max(1), size)
    active = np.abs(z) * np.sqrt(size)[:, None] > tol[:, None]
    z[~active] = 0.0
    if k > 1 and (np.diff(d, axis=1) <= 2 * tol[:, None]).any():
        p = p.copy()
        _equal_rotated(d, z, p, active, 2 * tol)
    whole = active.all()
    if not whole:  # directions that take part first, each kind in ascending order
        order = np.argsort(np.where(active, d, np.inf), axis=1, kind="stable")
        d, z, active = (np.take_along_axis(x, order, 1) for x in (d, z, active))
        p = np.take_along_axis(p, order[:, :, None], 1)
    m = active.sum(1)
    if not m.any():
        return d, p
    size = (z * z).sum(1)
    kept = d
    if not whole:  # stand-ins for the other poles, above all roots and without weight
        top = np.take_along_axis(d, np.maximum(m - 1, 0)[:, None], 1)
        step = np.where(size > 0, size, 1.0)[:, None]
        d = np.where(active, d, top + step * (1 + np.arange(k) - m[:, None]))
    ends = np.concatenate([d[:, 1:], d[:, -1:] + size[:, None]], axis=1)
    g, i = np.nonzero(active)
    gap = np.maximum(ends[g, i] - d[g, i], EPS * np.maximum(np.abs(ends[g, i]), 1e-290))
    tri = np.tri(k)
    off, right, base = _roots(d[g] - d[g, i][:, None], (z * z)[g], gap, tri[i])
    delta = base - off[:, None]  # poles less roots, a row for each root
    values = np.where(right, ends[g, i], d[g, i]) + off
    if whole:
        delta = delta.reshape(-1, k, k)
        part = d[:, None, :] - d[:, :, None]
        np.einsum("gii->gi", part)[:] = 1.0
        ratio = delta / part
    else:
        full = np.ones((len(d), k, k))
        full[g, i] = delta
        delta = full
        part = d[:, None, :] - d[:, :, None]
        np.einsum("gii->gi", part)[:] = 1.0
        ratio = np.where(active[:, :, None] & active[:, None, :], delta / part, 1.0)
    weight = np.sqrt(np.abs(ratio.prod(axis=1))) * np.sign(z)  # the update that has exactly these roots
    vec = weight[:, None, :] / delta
    if not whole:
        vec[~active] = np.eye(k)[np.nonzero(~active)[1]]
    vec /= np.sqrt((vec * vec).sum(2))[:, :, None]
    p = np.matmul(vec, p)
    if whole:
        return values.reshape(-1, k), p
    out = kept.copy()
    out[g, i] = values
    order = np.argsort(out, axis=1, kind="stable")
    return np.take_along_axis(out, order, 1), np.take_along_axis(p, order[:, :, None], 1)


class Spectra:
    """Counts, means and spectra of the centred scatter of several streams of vectors, updated side by side."""

    def __init__(self, streams: int, k: int):
        import numpy as np

        self.n = np.zeros(streams)
        self.mean, self.d = np.zeros((streams, k)), np.zeros((streams, k))
        self.p = np.broadcast_to(np.eye(k), (streams, k, k)).copy()

    def take(self, rows) -> None:
        """Row i of each block of as many rows as there are streams goes to stream i."""
        streams = len(self.n)
        for at in range(0, len(rows), streams):
            block = rows[at:at + streams]
            s = slice(0, len(block))
            delta, n = block - self.mean[s], self.n[s]
            self.d[s], self.p[s] = rank_one(self.d[s], self.p[s], delta, n / (n + 1))
            self.mean[s] += delta / (n + 1)[:, None]
            self.n[s] += 1

    def absorb(self, other: Spectra) -> None:
        """Add the vectors of ``other``, stream by stream, from its spectra alone."""
        import numpy as np

        for j in range(self.d.shape[1]):
            rho = np.maximum(other.d[:, j], 0.0)
            if rho.any():
                self.d, self.p = rank_one(self.d, self.p, other.p[:, j], rho)
        n = self.n + other.n
        share = other.n / np.maximum(n, 1)
        delta = other.mean - self.mean
        self.d, self.p = rank_one(self.d, self.p, delta, self.n * share)
        self.mean += delta * share[:, None]
        self.n = n

    def part(self, s: slice) -> Spectra:
        out = Spectra.__new__(Spectra)
        out.n, out.mean, out.d, out.p = (x[s].copy() for x in (self.n, self.mean, self.d, self.p))
        return out

    def one(self) -> Spectra:
        """All streams combined into one."""
        out = self
        while len(out.n) > 1:
            half = len(out.n) // 2
            rest = out.part(slice(2 * half, None))
            both = out.part(slice(0, half))
            both.absorb(out.part(slice(half, 2 * half)))
            if len(rest.n):
                first = both.part(slice(0, 1))
                first.absorb(rest)
                for x in ("n", "mean", "d", "p"):
                    getattr(both, x)[0] = getattr(first, x)[0]
            out = both
        return out


@dataclass(frozen=True)
class Fit:
    """Exact count and sums, and the leading eigenpairs of the covariance (components as rows, falling eigenvalues)."""

    n: int
    sums: tuple[int, ...]
    components: object
    values: object
    trace: float


def _rows(batch, dims: int, scale: float, shift: int):
    """(row numbers, x as a matrix of int64) of the rows of a batch that take part."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    col = batch.column("v")
    at = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(col), dims), False).to_numpy(zero_copy_only=False))
    if not len(at):
        return at, np.empty((0, dims), dtype=np.int64)
    flat = pc.list_flatten(col.take(pa.array(at))).cast(pa.float64())
    c = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dims)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(scale * c) + shift
        ok = (np.abs(x) < 2.0 ** 62).all(axis=1)
    # the shift is added as an integer: a sum of doubles would round
    return at[ok], np.floor(scale * c[ok]).astype(np.int64) + shift


def _source(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))


def dimensions(df: DataFrame, vector_col: str = "embedding") -> int:
    """Length of most vectors (of equally many the smaller); 0 if there is none. Vectors of other lengths take no part."""
    found = (df.where(F.size(vector_col) > 0).groupBy(F.size(vector_col).alias("k")).count()
             .orderBy(F.desc("count"), "k").first())
    return found["k"] if found else 0


def _exact(x) -> list[int]:
    """Exact column sums of int64 numbers."""
    return [int(h) * (1 << 32) + int(lo) for h, lo in zip((x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0), strict=True)]


_SPECTRUM = "part int, n bigint, sums array<decimal(38,0)>, mean array<double>, d array<double>, p array<double>"


def _fold(df: DataFrame, combine, schema: str) -> dict | None:
    """One row of many, combined ``FAN`` at a time by the tasks of a tree; the driver gets the last."""
    df = cut(df)
    n = df.agg(F.max("part")).first()[0]
    while n is not None and n > 0:
        df = cut(df.withColumn("part", (F.col("part") / FAN).cast("int")).groupBy("part").applyInArrow(combine, schema))
        n //= FAN
    row = df.first()
    return row.asDict() if row else None


def _spectra(df: DataFrame, dims: int, scale: float, shift: int) -> dict | None:
    """Count, exact sums and combined spectrum of all rows that take part."""
    import pyarrow as pa

    kinds = [("part", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0))),
             *((c, pa.list_(pa.float64())) for c in ("mean", "d", "p"))]

    def row(part, n, sums, s: Spectra):
        from decimal import Decimal

        cells = [part, n, [Decimal(x) for x in sums], s.mean[0].tolist(), s.d[0].tolist(), s.p[0].ravel().tolist()]
        return pa.RecordBatch.from_arrays([pa.array([c], t) for c, (_, t) in zip(cells, kinds, strict=True)],
                                          [c for c, _ in kinds])

    def update(batches):
        import numpy as np
        from pyspark import TaskContext

        held, count, n, sums, s = [], 0, 0, [0] * dims, None
        side = max(1, min(SIDE_BY_SIDE, (1 << 18) // (dims * dims)))

        def flush():
            nonlocal s, held, count
            x = np.concatenate(held)
            if s is None:
                s = Spectra(max(1, min(side, len(x) // ROWS_EACH)), dims)
            s.take(x.astype(np.float64))
            held, count = [], 0

        for b in batches:
            _, x = _rows(b, dims, scale, shift)
            if len(x):
                n += len(x)
                sums = [a + c for a, c in zip(sums, _exact(x), strict=True)]
                held.append(x)
                count += len(x)
                if count >= side * ROWS_EACH:
                    flush()
        if held:
            flush()
        if n:
            yield row(TaskContext.get().partitionId(), n, sums, s.one())
        give_back()

    def combine(table):
        import numpy as np

        total, n, sums = None, 0, [0] * dims
        rows = sorted(table.to_pylist(), key=lambda r: r["n"], reverse=True)
        for r in rows:
            s = Spectra(1, dims)
            s.n[0] = r["n"]
            s.mean[0], s.d[0], s.p[0] = r["mean"], r["d"], np.reshape(r["p"], (dims, dims))
            n, sums = n + r["n"], [a + int(c) for a, c in zip(sums, r["sums"], strict=True)]
            if total is None:
                total = s
            else:
                total.absorb(s)
        return pa.Table.from_batches([row(rows[0]["part"], n, sums, total)])

    return _fold(df.mapInArrow(update, _SPECTRUM), combine, _SPECTRUM)


def _centred(x, n: int, sums):
    """Rows less the exact mean, in doubles."""
    import numpy as np

    whole = [s // n for s in sums]
    rest = np.array([(s - n * w) / n for s, w in zip(sums, whole, strict=True)])
    return (x - np.array(whole, dtype=np.int64)).astype(np.float64) - rest


def _gram(df: DataFrame, dims: int, scale: float, shift: int, n: int, sums, basis) -> object:
    """Sum over all rows of ``y y'`` and of ``y``, y being the centred row in the coordinates of ``basis`` (columns)."""
    import numpy as np
    import pyarrow as pa

    schema = "part int, s array<double>, m array<double>"
    sent = df.sparkSession.sparkContext.broadcast((n, tuple(sums), basis))

    def row(part, s, m):
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([s.ravel().tolist()], pa.list_(pa.float64())),
                                           pa.array([m.tolist()], pa.list_(pa.float64()))], ["part", "s", "m"])

    def add(batches):
        from pyspark import TaskContext

        n, sums, basis = sent.value
        total, mean = np.zeros((basis.shape[1],) * 2), np.zeros(basis.shape[1])
        any_row = False
        for b in batches:
            _, x = _rows(b, dims, scale, shift)
            if len(x):
                y = _centred(x, n, sums) @ basis
                total += y.T @ y
                mean += y.sum(0)
                any_row = True
        if any_row:
            yield row(TaskContext.get().partitionId(), total, mean)

    def combine(table):
        s, m = (np.array(table.column(c).to_pylist()).sum(0) for c in ("s", "m"))
        return pa.Table.from_batches([row(table.column("part")[0].as_py(), s, m)])

    got = _fold(df.mapInArrow(add, schema), combine, schema)
    k = basis.shape[1]
    return np.reshape(got["s"], (k, k)), np.array(got["m"])


def fit(df: DataFrame, k: int = 8, scale: float = 1024.0, shift: int = 100_000, vector_col: str = "embedding",
        dims: int | None = None) -> Fit | None:
    """The leading ``k`` eigenpairs of the covariance (divisor n) of ``x = floor(scale * c) + shift`` over all vectors
    that take part; None if none does. The driver sees one spectrum; tasks pass on one each."""
    import numpy as np

    dims = dims or dimensions(df, vector_col)
    if not dims:
        return None
    src = df.select(F.col(vector_col).alias("v"))
    got = _spectra(src, dims, scale, shift)
    if got is None:
        return None
    n, sums = got["n"], tuple(int(s) for s in got["sums"])
    basis = np.linalg.qr(np.reshape(got["p"], (dims, dims)).T)[0]
    h, _ = _gram(src, dims, scale, shift, n, sums, basis)
    values, turn = np.linalg.eigh((h + h.T) / 2)
    order = np.argsort(values)[::-1][:k]
    return Fit(n, sums, (basis @ turn[:, order]).T, np.maximum(values[order], 0.0) / n, float(np.trace(h)) / n)


def whiten(df: DataFrame, k: int = 8, scale: float = 1024.0, shift: int = 100_000, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """One row for each vector that takes part: ``id_col``, n, deviation (the exact sum over dimensions of
    (n*x - S)^2; null where it leaves 64 bits), whitened (up to ``k`` numbers, by falling eigenvalue), explained (each
    component's share of the trace) and identity_error (measured over all rows: the largest entry of the whitened
    vectors' covariance less the identity).

    Vectors that are null, empty, hold a null or non-finite entry, have another length than most, or whose x leaves 62
    bits take no part. A component without variance (fewer vectors than components, equal vectors, a constant
    dimension) has whitened null and an explained share of 0, and counts for no identity error; without any variance
    explained and identity_error are null. Repeated rows and ids count each time, null ids stay null, extra columns
    are ignored and an empty table gives no rows."""
    import numpy as np

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n bigint, deviation bigint, whitened array<double>, explained array<double>, identity_error double"
    dims = dimensions(df, vector_col)
    model = fit(df, k, scale, shift, vector_col, dims) if dims else None
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    some = model.values > model.trace * dims * 4 * EPS
    scaled = np.where(some, 1 / np.sqrt(np.where(some, model.values, 1.0)), 0.0)[:, None] * model.components
    src = _source(df, id_col, vector_col)
    error = None
    if some.any():
        s, m = _gram(src, dims, scale, shift, model.n, model.sums, scaled[some].T)
        cov = s / model.n - np.outer(m, m) / model.n ** 2
        error = float(np.abs(cov - np.eye(len(cov))).max())
    explained = [float(e) if ok else 0.0 for e, ok in zip(model.values / (model.trace or 1.0), some, strict=True)]
    explained = explained if model.trace > 0 else [None] * len(some)
    sent = df.sparkSession.sparkContext.broadcast((model.n, model.sums, scaled.T, some))

    def run(batches):
        import pyarrow as pa

        n, sums, basis, some = sent.value
        for b in batches:
            at, x = _rows(b, dims, scale, shift)
            if not len(x):
                continue
            y = _centred(x, n, sums) @ basis
            flat = pa.array(y.ravel(), mask=np.broadcast_to(~some, y.shape).ravel())
            ends = pa.array(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32))
            rows = len(x)
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(pa.array(at)), pa.array(np.full(rows, n)), pa.array(_deviation(x, n, sums), pa.int64()),
                 pa.ListArray.from_arrays(ends, flat), pa.array([explained] * rows, pa.list_(pa.float64())),
                 pa.array([error] * rows, pa.float64())],
                [id_col, "n", "deviation", "whitened", "explained", "identity_error"])

    return src.mapInArrow(run, schema)


def _deviation(x, n: int, sums) -> list:
    """Exact sums of (n*x - S)^2 by row; None beyond 64 bits."""
    import numpy as np

    most = max(abs(int(x.min())), abs(int(x.max())))
    reach = n * most + max(map(abs, sums))
    far = max(abs(n * int(v) - s) for m in (x.min(0), x.max(0)) for v, s in zip(m, sums, strict=True))
    if reach < 1 << 63 and far * far * x.shape[1] < 1 << 63:
        off = n * x - np.array(sums, dtype=np.int64)
        return (off * off).sum(1).tolist()
    out = [sum((n * v - s) ** 2 for v, s in zip(r, sums, strict=True)) for r in x.tolist()]
    return [v if v < 1 << 63 else None for v in out]
