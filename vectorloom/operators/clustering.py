"""K-means, average-linkage clustering, and linear alignment of two spaces."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rng import u01
from ..functions.vector import doubles, lists_of, matrix_of
from ..sources.shared import written

#: Similarities that average linkage looks at together on the driver.
_TILE = 8 << 20


def kmeans(vectors: DataFrame, k: int, iterations: int = 20, id_col: str = "word_id", vec: str = "vec", seed: int | None = 1) -> DataFrame:
    """(id_col, cluster) after at most `iterations` rounds of squared distance;
    ties go to the lower cluster, an empty cluster keeps its centre.

    The first centres are k rows, chosen by the seed (None: the least ids). It ends when no row
    changes its cluster; before the first round all count as in cluster 0. Tasks send
    one sum a cluster, so a round shuffles k rows a task; the k centres are what is broadcast."""
    x = written(vectors.where(F.col(vec).isNotNull()).select(id_col, doubles(vec).alias("x")), "points")
    kind = x.schema[id_col].dataType.simpleString()
    order = [id_col] if seed is None else [u01(seed, F.col(id_col)), F.col(id_col)]
    first = x.orderBy(*order).limit(k).toArrow()
    if not first.num_rows:
        return x.select(id_col, F.lit(0).alias("cluster"))
    centres = matrix_of(first.column("x"))
    before = np.zeros_like(centres)
    before[1:] = np.inf  # everything in cluster 0

    def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        if not np.isfinite(c).all():
            return np.zeros(len(x), np.int64)
        return np.stack([((x - m) ** 2).sum(axis=1) for m in c], axis=1).argmin(axis=1) if len(c) <= 64 else ((c * c).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)

    for _ in range(iterations):
        now, last = centres, before

        def sums(batches, now=now, last=last):
            n, total, moved = np.zeros(len(now)), np.zeros_like(now), 0
            for batch in batches:
                p = matrix_of(batch.column(0))
                if len(p):
                    at = nearest(p, now)
                    moved += int((at != nearest(p, last)).sum())
                    n += np.bincount(at, minlength=len(now))
                    np.add.at(total, at, p)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(now)), pa.int32()), pa.array(n), lists_of(total), pa.array([moved] + [0] * (len(now) - 1), pa.int64())], ["c", "n", "total", "moved"])

        parts = x.select("x").mapInArrow(sums, "c int, n double, total array<double>, moved long").toArrow()
        if not sum(parts.column("moved").to_pylist()):
            break
        c, n, total = parts.column("c").to_numpy(), parts.column("n").to_numpy(), matrix_of(parts.column("total"))
        size, mass = np.bincount(c, n, len(centres)), np.zeros_like(centres)
        np.add.at(mass, c, total)
        before = centres
        centres = np.where(size[:, None] > 0, mass / np.maximum(size, 1)[:, None], centres)
    assigned = before if np.isfinite(before).all() else centres

    def label(batches):
        for batch in batches:
            p = matrix_of(batch.column(1))
            at = nearest(p, assigned) if len(p) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at.astype(np.int32))], [id_col, "cluster"])

    return x.mapInArrow(label, f"{id_col} {kind}, cluster int")


def hierarchical(vectors: DataFrame, clusters: int, id_col: str = "word_id", vec: str = "vec", most: int | None = None) -> DataFrame:
    """(id_col, cluster) by average linkage of cosine similarity: the two most
    similar clusters merge until `clusters` are left; of merges level with the last, those found first count.
    Pairs with a zero norm count for nothing. Clusters are numbered by their first row.

    The vectors are on the driver, in memory linear in their number; the time is quadratic. With
    `most`, more rows are an error."""
    v = vectors.where(F.col(vec).isNotNull()).select(id_col, doubles(vec).alias("v")).orderBy(id_col)
    got = (v if most is None else v.limit(most + 1)).toArrow()
    n = got.num_rows
    if most is not None and n > most:
        raise ValueError(f"average linkage is for at most {most} vectors")
    spark, kind = vectors.sparkSession, vectors.schema[id_col].dataType.simpleString()
    if not n:
        return spark.createDataFrame([], f"{id_col} {kind}, cluster int")
    owner = linked(matrix_of(got.column("v")), clusters)
    number = {o: c for c, o in enumerate(dict.fromkeys(owner.tolist()))}
    return spark.createDataFrame(pa.table({id_col: got.column(id_col), "cluster": pa.array([number[o] for o in owner.tolist()], pa.int32())}))


def linked(x: np.ndarray, clusters: int) -> np.ndarray:
    """The first row of each row's cluster. The mean similarity of two clusters is the product of the means of
    their unit vectors, so no matrix of similarities is kept. Two clusters that are nearest to each other merge
    at once: whatever else merges, they would later, at the same similarity. The merges at the greatest similarities count."""
    n = len(x)
    size = np.sqrt((x * x).sum(axis=1))
    mean, weight = np.divide(x, size[:, None], out=np.zeros_like(x), where=size[:, None] > 0), (size > 0).astype(float)
    alive, near, sim, height = np.ones(n, bool), np.zeros(n, np.int64), np.zeros(n), np.full(n, np.inf)
    merges: list[tuple[float, int, int]] = []

    def look(rows: np.ndarray) -> None:
        ids = np.flatnonzero(alive)
        m = mean[ids].T
        step = max(1, _TILE // len(ids))
        for k in range(0, len(rows), step):
            some = rows[k : k + step]
            s = mean[some] @ m
            s[np.arange(len(some)), np.searchsorted(ids, some)] = -np.inf
            at = s.argmax(axis=1)
            near[some], sim[some] = ids[at], s[np.arange(len(some)), at]

    stale = np.arange(n)
    while len(merges) < n - 1:
        look(stale)
        ids = np.flatnonzero(alive)
        first = ids[(near[near[ids]] == ids) & (ids < near[ids])]
        if not len(first):  # a ring of equal similarities
            i = ids[sim[ids].argmax()]
            first = np.array([min(i, near[i])])
            near[first[0]], sim[first[0]] = max(i, near[i]), sim[i]
        second = near[first]
        height[first] = np.minimum(sim[first], np.minimum(height[first], height[second]))
        merges += zip(height[first].tolist(), first.tolist(), second.tolist())
        both = weight[first] + weight[second]
        total = mean[first] * weight[first, None] + mean[second] * weight[second, None]
        mean[first] = np.divide(total, both[:, None], out=np.zeros_like(total), where=both[:, None] > 0)
        weight[first] = both
        alive[second] = False
        gone = np.zeros(n, bool)
        gone[first] = gone[second] = True
        stale = np.flatnonzero(alive & (gone | gone[near]))
    owner = np.arange(n)
    for _, i, j in sorted(merges, key=lambda m: -m[0])[: n - max(1, clusters)] if n > clusters else []:
        owner[j] = i
    while not np.array_equal(up := owner[owner], owner):
        owner = up
    return owner


class Aligner:
    """A matrix that takes vectors of one space to another; the identity at first."""

    def __init__(self, dim: int):
        self.w = np.eye(dim)

    def align(self, v):
        """Column expression of w @ v."""
        from ..functions.vector import matrix_times

        return matrix_times(self.w, v)

    def fit_sgd(self, pairs: DataFrame, epochs: int, rate: float, order: list[str] | None = None, src: str = "src", tgt: str = "tgt") -> Aligner:
        """Descent pair by pair in a fixed order; a dictionary of pairs is small and held on the driver."""
        rows = (pairs.orderBy(*order) if order else pairs).select(doubles(src).alias("s"), doubles(tgt).alias("t")).collect()
        for _ in range(epochs):
            for s, t in rows:
                s = np.array(s)
                self.w -= rate * np.outer(self.w @ s - np.array(t), s)
        return self

    def fit(self, pairs: DataFrame, damp: float = 1e-9, src: str = "src", tgt: str = "tgt") -> Aligner:
        """The least-squares solution. Tasks send sums of outer products, whose size doesn't grow with the pairs."""
        d = len(self.w)

        def sums(batches):
            xx, xy = np.zeros((d, d)), np.zeros((d, d))
            for batch in batches:
                s, t = matrix_of(batch.column(0)), matrix_of(batch.column(1))
                if len(s):
                    xx += s.T @ s
                    xy += s.T @ t
            yield pa.RecordBatch.from_arrays([pa.array([xx.ravel(), xy.ravel()], pa.list_(pa.float64())), pa.array([0, 1], pa.int32())], ["m", "k"])

        got = pairs.select(doubles(src).alias("s"), doubles(tgt).alias("t")).mapInArrow(sums, "m array<double>, k int").toArrow()
        m, k = matrix_of(got.column("m")), got.column("k").to_numpy()
        xx, xy = (m[k == i].sum(axis=0).reshape(d, d) for i in (0, 1))
        self.w = np.linalg.solve(xx + damp * np.eye(d), xy).T
        return self
