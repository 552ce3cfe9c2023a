"""Exact top-k inner products by a Voronoi kNN join.

Rows are grouped by their nearest pivot. Small summaries of the groups (largest norm and radius, the smallest pivot
distances) bound what any query of a group can score against any row of another: a row is sent to a query group only
if its bound reaches the score that the summaries already guarantee for the k-th place. Each query group is solved
locally against the rows it got, in tasks of bounded size, and the tasks' top k are merged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobframe.llm.common import cut

#: Components are 64-bit integers.
LIMIT = 2**63


def quantize(values, scale: float):
    """floor(scale * x) of a vector as int64; None if it is null or has null or non-finite components or leaves int64."""
    import numpy as np

    if values is None or any(x is None for x in values):
        return None
    v = np.floor(scale * np.array(values, dtype=np.float64))
    return v.astype(np.int64) if (v >= -LIMIT).all() and (v < LIMIT).all() else None


def vectors(table: DataFrame, scale: float = 64.0) -> DataFrame:
    """(vec_id, v): rows that take part, v as little-endian 64-bit integers. Rows with a null id, or a vector that is
    null or holds null or non-finite components, or ones that leave 64 bits after scaling, take no part."""
    src = table.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").where("vec_id is not null")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            vs = [quantize(x, scale) for x in b.column("embedding").to_pylist()]
            keep = pa.array([v is not None for v in vs], pa.bool_())
            out = pa.array([None if v is None else v.astype("<i8").tobytes() for v in vs], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), out], ["vec_id", "v"]).filter(keep)

    return src.mapInArrow(run, "vec_id bigint, v binary")


def matrix(raw, width: int | None = None):
    """Vectors as rows of a float64 matrix (exact for components below 2**53), shorter ones padded with zeros."""
    import numpy as np

    width = max([1, *(len(r) // 8 for r in raw)]) if width is None else width
    out = np.zeros((len(raw), width))
    for k, r in enumerate(raw):
        out[k, :len(r) // 8] = np.frombuffer(r, dtype="<i8")
    return out


def integers(raw, width: int, kind):
    """Vectors as rows of a matrix of int64 or (``object``) Python integers, shorter ones padded with zeros."""
    import numpy as np

    out = np.zeros((len(raw), width), dtype=kind)
    for k, r in enumerate(raw):
        out[k, :len(r) // 8] = np.frombuffer(r, dtype="<i8").tolist()
    return out


def pick_pivots(sample, n: int, rounds: int = 6):
    """At most ``n`` centres of a bounded sample by Lloyd's rounds from evenly spread distinct rows."""
    import numpy as np

    rows = np.unique(sample, axis=0)
    centres = rows[np.linspace(0, len(rows) - 1, min(n, len(rows))).astype(int)]
    for _ in range(rounds):
        near = nearest(rows, centres)[0]
        centres = np.stack([rows[near == c].mean(axis=0) if (near == c).any() else centres[c]
                            for c in range(len(centres))])
    return centres


def nearest(rows, centres):
    import numpy as np

    d2 = (rows**2).sum(1)[:, None] - 2 * rows @ centres.T + (centres**2).sum(1)[None]
    cell = d2.argmin(axis=1)
    return cell, np.sqrt(((rows - centres[cell]) ** 2).sum(axis=1))


def assign(vecs: DataFrame, pivots, is_query) -> DataFrame:
    """Adds cell, dist (to its pivot), norm and is_query."""
    held = vecs.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        p = held.value
        for b in batches:
            if not b.num_rows:
                continue
            raw = b.column("v").to_pylist()
            m = matrix(raw, max([p.shape[1], *(len(r) // 8 for r in raw)]))
            wide = np.pad(p, ((0, 0), (0, m.shape[1] - p.shape[1])))
            cell, dist = nearest(m, wide)
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), b.column("v"), pa.array(cell.astype(np.int64)), pa.array(dist),
                 pa.array(np.sqrt((m**2).sum(axis=1)))], ["vec_id", "v", "cell", "dist", "norm"])

    out = vecs.mapInArrow(run, "vec_id bigint, v binary, cell bigint, dist double, norm double")
    return out.withColumn("is_query", is_query)


def bounds(cells, groups, pivots, k: int, ids=None):
    """What each query group needs of each data cell: a row x of cell j goes to group g if dist(x) >= need[g, j] and
    norm(x) >= floor[g]. ``cells``: cell -> the smallest distances of k + 1 ids; ``groups``: cell -> (largest distance,
    largest norm) of its queries; ``ids``: cell -> the vec_ids of these distances (without it, all differ).

    For q = pivot g + s and x = pivot j + r: q.x <= pg.pj + |s| |pj| + |q| |r| and q.x >= pg.pj - |s| |pj| - |q| |r|.
    The lower bounds of the nearest rows of all cells, of k + 1 ids (one may be the query's, none of whose rows is a
    candidate), hold the k-th score."""
    import numpy as np

    inner = pivots @ pivots.T
    norm = np.sqrt((pivots**2).sum(axis=1))
    cell = np.array([j for j, ds in cells.items() for _ in ds], dtype=np.int64)
    dist = np.array([d for ds in cells.values() for d in ds])
    own = np.arange(len(cell)) if ids is None else np.array([i for j in cells for i in ids[j]], dtype=np.int64)
    need, floor = {}, {}
    for g, (radius, top) in groups.items():
        lows = inner[g, cell] - radius * norm[cell] - top * dist
        reach = np.abs(inner[g, cell]) + radius * norm[cell] + top * dist
        lows[reach >= 2**62] = -np.inf  # such a score may leave 64 bits, and then it holds no place
        order = np.argsort(-lows, kind="stable")
        best = np.sort(np.unique(own[order], return_index=True)[1])  # the place of each id's largest bound
        least = lows[order[best[k]]] if len(best) > k else -np.inf
        least -= 1e-6 * (1 + abs(least)) + 1e-12 * reach[reach < 2**62].max(initial=0)  # rounding
        high = {j: inner[g, j] + radius * norm[j] for j in cells}
        if top == 0:
            need[g], floor[g] = dict.fromkeys(cells, -np.inf), -np.inf
        else:
            need[g] = {j: (least - h - 1e-9 * abs(h)) / top for j, h in high.items()}
            floor[g] = least / top
    return need, floor


def merge_cells(asked, pivots, query_rows: int):
    """Query cells -> groups of neighbouring cells with about ``query_rows`` queries each. A row that several cells of
    a group need is sent to the group once."""
    import numpy as np

    left, out, n_groups = dict(asked), {}, 0
    while left:
        first = max(left, key=lambda c: (left[c], -c))
        near = sorted(left, key=lambda c: (float(np.square(pivots[c] - pivots[first]).sum()), c))
        n = 0
        for c in near:
            if n and n + left[c] > query_rows:
                break
            n += left.pop(c)
            out[c] = n_groups
        n_groups += 1
    return out


#: Queries scored at a time inside a task.
SCORED = 256


def solve(k: int):
    """The k best rows of one task for each of its queries."""

    def run(queries, rows):
        import numpy as np
        import pyarrow as pa

        out = {"query_id": [], "query_hash": [], "vec_id": [], "score": []}
        if queries.num_rows and rows.num_rows:
            order = np.argsort(rows["vec_id"].to_numpy(), kind="stable")
            ids = rows["vec_id"].to_numpy()[order]
            raw_q, raw_x = queries["query_v"].to_pylist(), rows["v"].to_pylist()
            width = max(len(r) // 8 for r in (*raw_q, *raw_x))
            q, x = matrix(raw_q, width), matrix(raw_x, width)[order]
            own = queries["query_id"].to_numpy()
            top = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(width, 1)
            if top >= 2**53:
                kind = np.int64 if top < 2**62 else object
                q, x = integers(raw_q, width, kind), integers(raw_x, width, kind)[order]
            least = np.iinfo(np.int64).min
            hashes = queries["query_hash"].to_numpy()
            for i in range(len(own)):
                if i % SCORED == 0:
                    s = q[i:i + SCORED] @ x.T
                    if s.dtype == object:  # scores that leave 64 bits are dropped
                        s = np.where((s > least) & (s < 2**63), s, least)
                    s = s.astype(np.int64)
                row = s[i % SCORED]
                row[np.searchsorted(ids, own[i], "left"):np.searchsorted(ids, own[i], "right")] = least
                at = np.flatnonzero(row >= np.partition(row, -k)[-k]) if len(row) > k else np.arange(len(row))
                at = at[row[at] > least]  # first: -least is least again
                at = at[np.argsort(-row[at], kind="stable")][:k]
                out["query_id"] += [own[i]] * len(at)
                out["query_hash"] += [hashes[i]] * len(at)
                out["vec_id"] += ids[at].tolist()
                out["score"] += row[at].tolist()
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    return run


def top_k(table: DataFrame, is_query, k: int = 20, scale: float = 64.0, sample_rows: int = 4096,
          query_rows: int = 4096, data_rows: int = 8192) -> DataFrame:
    """For each row for which ``is_query`` (a column of vec_id) holds: query_id, rank (1 to k), vec_id, score of the
    k rows with the largest integer inner products of floor(scale * x), ties to the smaller vec_id; fewer if there
    are fewer. A query's own vec_id is no candidate of it.

    Rows that take no part: see :func:`vectors`. Scores that leave 64 bits are dropped. Vectors of unequal lengths are compared as if padded with zeros. A
    repeated query row counts once, a repeated candidate row each time. ``sample_rows`` bounds the sample that
    pivots are fit on; the result does not depend on it. A task holds at most about ``query_rows`` queries and
    ``data_rows`` rows, however large a group is."""
    spark = table.sparkSession
    vecs = cut(vectors(table, scale))
    sample = [r["v"] for r in vecs.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("v").collect()]
    empty = "query_id bigint, rank int, vec_id bigint, score bigint"
    if not sample:
        return spark.createDataFrame([], empty)
    n = vecs.count()
    pivots = pick_pivots(matrix(sample), max(8, min(1024, int(n**0.5 / 2))))
    data = cut(assign(vecs, pivots, is_query))

    # the k + 1 ids nearest to each pivot: Spark keeps so many in each task before it shuffles
    by_dist = Window.partitionBy("cell").orderBy("dist", "vec_id")
    near = (data.groupBy("cell", "vec_id").agg(F.min("dist").alias("dist"))
            .withColumn("place", F.row_number().over(by_dist)).where(F.col("place") <= k + 1))
    cells, ids, sizes, far = {}, {}, {}, {}
    for r in near.select("cell", "vec_id", "dist").collect():  # k + 1 rows for each pivot
        cells.setdefault(r["cell"], []).append(r["dist"])
        ids.setdefault(r["cell"], []).append(r["vec_id"])
    for r in data.groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("d"), F.max("norm").alias("m")).collect():
        sizes[r["cell"]], far[r["cell"]] = r["n"], (r["d"], r["m"])
    groups, asked = {}, {}
    once = data.where("is_query").select("cell", "vec_id", F.xxhash64("v").alias("query_hash"), "dist", "norm")
    for r in (once.dropDuplicates(["cell", "vec_id", "query_hash"]).groupBy("cell")
              .agg(F.max("dist").alias("d"), F.max("norm").alias("m"), F.count("*").alias("n")).collect()):
        groups[r["cell"]], asked[r["cell"]] = (r["d"], r["m"]), r["n"]
    if not groups:
        return spark.createDataFrame([], empty)
    wide = max(len(r) // 8 for r in sample)
    need, floor = bounds(cells, groups, pivots[:, :wide], k, ids)

    # what each group of query cells needs of each data cell, and its numbers of query blocks and data parts
    member = merge_cells(asked, pivots, query_rows)
    plan, shape = [], []
    for g in sorted(set(member.values())):
        of = [c for c in member if member[c] == g]
        least = min(floor[c] for c in of)
        some = {j: min(need[c][j] for c in of) for j in cells}
        some = {j: d for j, d in some.items() if far[j][0] >= d and far[j][1] >= least}
        blocks = -(-sum(asked[c] for c in of) // query_rows)
        parts = max(1, -(-sum(sizes[j] for j in some) // data_rows))
        plan += [(g, int(j), float(d), float(least), blocks, parts) for j, d in some.items()]
        shape += [(g, int(c), blocks, parts) for c in of]
    # at most a row for each pair of pivots (1024 x 1024), whatever the data
    pairs = spark.createDataFrame(plan, "grp bigint, cell bigint, need double, floor double, blocks bigint, parts bigint")
    shapes = spark.createDataFrame(shape, "grp bigint, cell bigint, blocks bigint, parts bigint")
    steps = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(c) - 1))
    # copies of a row are dealt out too; the checkpoint's partitions, and so the numbers, stay as they are
    sent = (data.withColumn("nth", F.monotonically_increasing_id())
            .join(F.broadcast(pairs), "cell").where("dist >= need and norm >= floor")
            .select("grp", "blocks", F.pmod(F.xxhash64("nth"), "parts").alias("part"), "vec_id", "v")
            .withColumn("block", steps("blocks")).drop("blocks"))
    ask = (data.where("is_query").withColumn("query_hash", F.xxhash64("v")).dropDuplicates(["vec_id", "query_hash"])
           .join(F.broadcast(shapes), "cell")
           .select("grp", "parts", F.pmod(F.xxhash64("vec_id", "v"), "blocks").alias("block"),
                   F.col("vec_id").alias("query_id"), "query_hash", F.col("v").alias("query_v"))
           .withColumn("part", steps("parts")).drop("parts"))
    key = ["grp", "part", "block"]
    found = ask.groupBy(*key).cogroup(sent.groupBy(*key)).applyInArrow(
        solve(k), "query_id bigint, query_hash bigint, vec_id bigint, score bigint")
    place = Window.partitionBy("query_id", "query_hash").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
