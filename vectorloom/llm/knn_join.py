"""Exact top-k search for all vectors: the Voronoi kNN join.

Every vector belongs to the cell of its nearest pivot. The cells' summaries
(how many, how far out, the nearest k distances to the pivot) bound how far
the k-th neighbour of a cell's queries can be. A vector is sent only to those groups
of query cells that it could serve within that bound; each group is solved on its own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, mix64, written

K, MOST_PIVOTS, GROUP_QUERIES, GROUP_DATA = 10, 512, 8192, 65_536
_SLACK = 1e-6


def _near_pivot(pivots: np.ndarray):
    own = (pivots * pivots).sum(axis=1)

    def run(batches):
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float64).reshape(batch.num_rows, -1)
            cells, far = [], []
            for a in range(0, len(x), 4096):
                part = x[a : a + 4096]
                c = (own - 2 * part @ pivots.T).argmin(axis=1)
                cells.append(c)
                far.append(np.sqrt(((part - pivots[c]) ** 2).sum(axis=1)))
            empty = [np.zeros(0)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(cells or empty).astype(np.int32)), pa.array(np.concatenate(far or empty))], ["id", "x", "cell", "far"])

    return run


def _packed(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.array(v, np.float64).tobytes() for v in batch.column(1).to_pylist()], pa.binary())], ["id", "x"])


def bounds(pivots: np.ndarray, counts: np.ndarray, radius: np.ndarray, nearest: list[np.ndarray], k: int) -> np.ndarray:
    """How far from the pivot of each cell a vector may lie and still be a neighbour of
    a query of that cell. `nearest` has each cell's k + 1 least distances, as a query is its own nearest neighbour."""
    apart = np.sqrt(np.maximum(((pivots[:, None] - pivots[None]) ** 2).sum(axis=2), 0)) if len(pivots) <= 64 else _apart(pivots)
    far = np.empty(len(pivots))
    all_near, of = np.concatenate(nearest), np.repeat(np.arange(len(nearest)), [len(n) for n in nearest])
    for i in range(len(pivots)):
        reach = apart[i, of] + all_near
        theta = np.partition(reach, k)[k] + radius[i] if len(reach) > k else math.inf
        far[i] = radius[i] + theta + _SLACK
    return far


def _apart(p: np.ndarray) -> np.ndarray:
    own = (p * p).sum(axis=1)
    # the rounding of this form only loosens a bound if it is taken off
    return np.sqrt(np.maximum(own[:, None] + own[None] - 2 * p @ p.T, 0)) * (1 - 1e-9)


def solve(qid: np.ndarray, q: np.ndarray, did: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, neighbour, distance) of the k nearest of d for each q, itself
    excluded; ties by id. Distances are those of the coordinates' differences."""
    outs = []
    own, big = (d * d).sum(axis=1), max(float(np.abs(d).max(initial=0)), float(np.abs(q).max(initial=0)))
    # products in single precision while they fit, with room for their rounding; what is within it is worked out again exactly
    kind, rounding = (np.float32, 1e-6) if big < 1e15 else (np.float64, 1e-15)
    narrow, slack = d.astype(kind), rounding * 4 * (1 + q.shape[1] * big * big)
    for a in range(0, len(q), 128):
        part, ids = q[a : a + 128], qid[a : a + 128]
        again = part.astype(kind)
        # what each query's k-th distance is at most, by the first data seen
        worst, rows, cols = np.full((len(part), 1), math.inf), [], []
        for b in range(0, len(d), 4096):
            s = own[b : b + 4096] - 2 * (again @ narrow[b : b + 4096].T)
            s[ids[:, None] == did[None, b : b + 4096]] = math.inf
            if s.shape[1] > k:
                worst = np.minimum(worst, np.partition(s, k - 1, axis=1)[:, k - 1 : k] + slack) if b < 8192 else worst
            i, j = np.nonzero((s <= worst + slack) & (s < math.inf))
            rows.append(i)
            cols.append(j + b)
        i, j = np.concatenate([np.zeros(0, int), *rows]), np.concatenate([np.zeros(0, int), *cols])
        far = np.sqrt(((part[i] - d[j]) ** 2).sum(axis=1))
        order = np.lexsort((did[j], far, i))
        i, j, far = i[order], j[order], far[order]
        first = np.searchsorted(i, i, "left")
        keep = np.arange(len(i)) - first < k
        outs.append((ids[i[keep]], did[j[keep]], far[keep]))
    return tuple(np.concatenate(x) for x in zip(*outs)) if outs else (qid[:0], did[:0], np.zeros(0))


def knn_join(vectors: DataFrame, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int | None = None, group_queries: int = GROUP_QUERIES, group_data: int = GROUP_DATA) -> DataFrame:
    """(vec_id, neighbor_id, rank, distance): the k nearest other vectors of
    every vector by Euclidean distance, exactly; ties by id.

    Rows with a null id, a null vector or a null, infinite or missing component
    (a length other than the first vector's by id) take no part. Of rows that share an id one counts,
    the one with the least vector. A table of n <= k vectors gives each n - 1 neighbours, an
    empty table no rows. Other columns are ignored.

    Queries go in groups of about `group_queries`, the data sent to a group in
    parts of about `group_data`; results of the parts are merged.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    v = v.where("id is not null and v is not null and size(v) > 0 and not exists(v, e -> e is null or isnan(e) or abs(e) = double('inf'))")
    v = v.groupBy("id").agg(F.min("v").alias("v"))
    head = v.orderBy("id").select(F.size("v").alias("n")).first()
    out = "vec_id long, neighbor_id long, rank int, distance double"
    if head is None:
        return spark.createDataFrame([], out)
    x = written(v.where(F.size("v") == head["n"]).mapInArrow(_packed, "id long, x binary"), "vectors")
    n = x.count()
    m = pivots or max(1, min(MOST_PIVOTS, math.isqrt(n)))
    chosen = np.stack([np.frombuffer(r["x"], np.float64) for r in x.orderBy(F.xxhash64("id"), "id").limit(m).collect()])
    cells = cut(x.mapInArrow(_near_pivot(chosen), "id long, x binary, cell int, far double"))
    w = Window.partitionBy("cell").orderBy("far", "id")
    near = cells.select("cell", "far", F.row_number().over(w).alias("r")).where(F.col("r") <= k + 1).select("cell", "far").collect()
    sums = {r["cell"]: r for r in cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("u")).collect()}
    m = len(chosen)
    counts = np.array([sums[c]["n"] if c in sums else 0 for c in range(m)])
    radius = np.array([sums[c]["u"] if c in sums else 0.0 for c in range(m)])
    nearest = [np.zeros(0)] * m
    for c in sums:
        nearest[c] = np.array(sorted(r["far"] for r in near if r["cell"] == c))
    within = bounds(chosen, counts, radius, nearest, k)
    # groups of neighbouring cells; a cell above the size of a group has several
    groups, filled = [], 0
    left = set(c for c in range(m) if counts[c])
    at = int(counts.argmax())
    splits: dict[int, tuple[int, int]] = {}
    while left:
        at = at if at in left else min(left, key=lambda c: (float(((chosen[c] - chosen[at]) ** 2).sum()), c))
        left.discard(at)
        parts = -(-int(counts[at]) // group_queries)
        if parts > 1:
            splits[at] = (len(groups), parts)
            groups += [[at]] * parts
            filled = group_queries
        else:
            if not groups or filled + counts[at] > group_queries:
                groups.append([])
                filled = 0
            groups[-1].append(at)
            filled += int(counts[at])
            splits[at] = (len(groups) - 1, 1)
    own = (chosen * chosen).sum(axis=1)

    def needed(column) -> np.ndarray:
        """Which groups each vector could serve: those with a cell within whose bound it lies, by its own distance to that cell's pivot."""
        x = np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)
        size = (x * x).sum(axis=1)[:, None]
        # rounding only loosens the bound
        d = np.sqrt(np.maximum(own + size - 2 * x @ chosen.T - 1e-9 * (own + size), 0)) - within
        return np.stack([d[:, g].min(axis=1) <= 0 for g in groups], axis=1)

    first, parts = (np.array([splits.get(c, (0, 1))[s] for c in range(m)]) for s in (0, 1))

    def send(batches):
        for batch in batches:
            ids, cell = (batch.column(c).to_numpy() for c in ("id", "cell"))
            h = mix64(ids.astype(np.uint64)).astype(np.int64) & 0x7FFFFFFF
            i, g = np.nonzero(needed(batch.column("x")))
            goes = pa.array(np.concatenate([first[cell] + h % parts[cell], g]).astype(np.int32))
            rows = np.concatenate([np.arange(len(ids)), i])
            query = np.arange(len(rows)) < len(ids)
            part = np.where(query, -1, h[rows] >> 8)
            for a in range(0, len(rows), 20_000):
                s = slice(a, a + 20_000)
                yield pa.RecordBatch.from_arrays([goes[s], pa.array(part[s].astype(np.int32)), batch.column("id").take(pa.array(rows[s])), batch.column("x").take(pa.array(rows[s]))], ["g", "part", "id", "x"])

    sizes = {}

    def tally(batches):
        total = np.zeros(len(groups), np.int64)
        for batch in batches:
            total += needed(batch.column(0)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(groups), dtype=np.int32)), pa.array(total)], ["g", "n"])

    for r in cells.select("x").mapInArrow(tally, "g int, n long").groupBy("g").agg(F.sum("n").alias("n")).collect():
        sizes[r["g"]] = max(1, -(-r["n"] // group_data))
    many = np.array([sizes.get(g, 1) for g in range(len(groups))], np.int32)
    sent = cells.mapInArrow(send, "g int, part int, id long, x binary")
    tasks = spark.createDataFrame([(g, int(p)) for g in range(len(groups)) for p in range(many[g])], "g int, p int")
    per = spark.createDataFrame([(g, int(c)) for g, c in enumerate(many)], "g int, many int")
    queries = sent.where("part < 0").select("g", "id", "x").join(F.broadcast(tasks), "g")
    data = sent.where("part >= 0").join(F.broadcast(per), "g").withColumn("p", F.col("part") % F.col("many"))
    # fresh names: both sides come from one table
    queries, data = (t.select(*[F.col(c).alias(c) for c in ("g", "p", "id", "x")]) for t in (queries, data))

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        def side(t):
            return t.column("id").to_numpy(), np.frombuffer(b"".join(t.column("x").to_pylist()), np.float64).reshape(t.num_rows, -1)

        if not left.num_rows or not right.num_rows:
            a, b, far = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        else:
            a, b, far = solve(*side(left), *side(right), k)
        return pa.table({"vec_id": pa.array(a), "neighbor_id": pa.array(b), "distance": pa.array(far)})

    found = queries.groupBy("g", "p").cogroup(data.groupBy("g", "p")).applyInArrow(join, "vec_id long, neighbor_id long, distance double")
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy("distance", "neighbor_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("vec_id", "neighbor_id", "rank", "distance")
