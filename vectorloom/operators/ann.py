"""Approximate search: hyperplane hashing and small-world graphs."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rng import generator, u01_py
from ..functions.vector import cosine, doubles, matrix_of, norm

PLANES = 32
#: Rows of a block where buckets are compared block by block.
BLOCK = 4096


class LshIndex:
    """`tables` hash tables of 32 random hyperplanes; a bit is set where the dot product is above 0."""

    def __init__(self, dim: int, tables: int = 4, planes: int = PLANES, seed: int = 1):
        self.tables, self.planes = tables, planes
        self.matrix = np.array([[[2 * u01_py(seed, t, p, d) - 1 for d in range(dim)] for p in range(planes)] for t in range(tables)])

    def buckets(self, vectors: DataFrame, id_col: str = "word_id", vec: str = "vec") -> DataFrame:
        """(table_id, bucket, id_col): one row a vector and table."""
        flat = self.matrix.reshape(-1, self.matrix.shape[2])
        weights = (1 << np.arange(self.planes)).astype(np.int64)

        def run(batches):
            for batch in batches:
                x = matrix_of(batch.column(1))
                if not len(x):
                    continue
                # one sum a component, in order, so that a bit never depends on the size of the batch
                bits = (np.stack([(x * p).sum(axis=1) for p in flat], axis=1) > 0).reshape(len(x), self.tables, self.planes)
                h = (bits * weights).sum(axis=2)
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(self.tables), len(x)).astype(np.int32)), pa.array(h.ravel()), batch.column(0).take(pa.array(np.repeat(np.arange(len(x)), self.tables)))], ["table_id", "bucket", id_col])

        kind = vectors.schema[id_col].dataType.simpleString()
        return vectors.where(F.col(vec).isNotNull()).select(id_col, doubles(vec).alias("v")).mapInArrow(run, f"table_id int, bucket long, {id_col} {kind}")

    def query(self, vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "word_id", vec: str = "vec") -> DataFrame:
        """(query, neighbor, similarity, rank) for every row of queries: the
        candidates of all its buckets, each once, ranked by cosine. A query without company has no rows.

        Where buckets are few, most pairs are candidates: blocks of vectors then meet blocks of queries, and
        only k rows a query and block are shuffled. Else the buckets are joined."""
        wide = self.tables * 16 >= 1 << self.planes and vectors.schema[id_col].dataType.simpleString() in ("int", "bigint")
        if wide:
            x = self._met(vectors, queries, k, id_col, vec)
        else:
            b = self.buckets(vectors, id_col, vec)
            q = b.join(queries.select(id_col).distinct(), id_col, "left_semi").select("table_id", "bucket", F.col(id_col).alias("query"))
            met = q.join(b.withColumnRenamed(id_col, "neighbor"), ["table_id", "bucket"]).where("query <> neighbor").select("query", "neighbor").distinct()
            v = vectors.select(F.col(id_col).alias("i"), F.col(vec).alias("v"), norm(vec).alias("n"))
            x = met.join(v.toDF("query", "_qv", "_qn"), "query").join(v.toDF("neighbor", "_v", "_n"), "neighbor")
            x = x.select("query", "neighbor", cosine("_qv", "_v", F.col("_qn"), F.col("_n")).alias("similarity")).where("similarity is not null")
        w = Window.partitionBy("query").orderBy(F.desc("similarity"), "neighbor")
        return x.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    def _met(self, vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vec: str) -> DataFrame:
        """(query, neighbor, similarity) of the k best candidates, and those level with them, of every query and block."""
        kind = vectors.schema[id_col].dataType.simpleString()

        def packed(t: DataFrame) -> tuple[DataFrame, int]:
            n = max(1, -(-t.count() // BLOCK))
            rows = t.where(F.col(vec).isNotNull()).select(F.col(id_col).cast("long").alias("id"), doubles(vec).alias("v"), F.pmod(F.xxhash64(id_col), F.lit(n)).alias("b"))
            return rows.groupBy("b").agg(F.collect_list(F.struct("id", "v")).alias("rows")).select("rows.id", F.flatten("rows.v").alias("v")), n

        asked = vectors.join(queries.select(id_col).distinct(), id_col, "left_semi")
        (data, n), (asked, m) = packed(vectors), packed(asked)

        def unpacked(ids: pa.Scalar, flat: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            x = flat.values.to_numpy().reshape(len(ids.values), -1)
            size = np.sqrt((x * x).sum(axis=1))
            ok = size > 0
            x = x[ok]
            return ids.values.to_numpy()[ok], x / size[ok, None], self._codes(x)

        def meet(batches):
            for batch in batches:
                for r in range(batch.num_rows):
                    qi, q, qb = unpacked(batch.column(0)[r], batch.column(1)[r])
                    di, d, db = unpacked(batch.column(2)[r], batch.column(3)[r])
                    for at in range(0, len(qi), 256):
                        some = slice(at, at + 256)
                        share = np.zeros((len(qi[some]), len(di)), bool)
                        for t in range(self.tables):
                            share |= qb[t, some, None] == db[t]
                        share &= qi[some, None] != di
                        i, j, s = best_pairs(q[some], d, share, k)
                        yield pa.RecordBatch.from_arrays([pa.array(qi[some][i]), pa.array(di[j]), pa.array(s)], ["query", "neighbor", "similarity"])

        both = asked.toDF("qi", "qv").repartition(min(m, 64)).crossJoin(data.toDF("di", "dv").repartition(min(n, 64)))
        met = both.mapInArrow(meet, "query long, neighbor long, similarity double")
        return met.select(F.col("query").cast(kind).alias("query"), F.col("neighbor").cast(kind).alias("neighbor"), "similarity")

    def _codes(self, x: np.ndarray) -> np.ndarray:
        """(tables, rows): the bucket of each row, in as few bytes as hold it."""
        small = next(t for bits, t in ((8, np.uint8), (16, np.uint16), (64, np.int64)) if self.planes <= bits)
        out = np.zeros((self.tables, len(x)), small)
        for t in range(self.tables):
            for p in range(self.planes):
                out[t] |= ((x * self.matrix[t, p]).sum(axis=1) > 0).astype(small) << small(p)
        return out


def best_pairs(q: np.ndarray, x: np.ndarray, open_: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of x, product) of the k greatest products of each row of q among the open
    pairs, with all that are level with the last. Products are summed again row by row, so that equal vectors have equal ones."""
    s = np.where(open_, q @ x.T, -np.inf)
    least = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)
    i, j = np.nonzero((s >= least[:, None] - 1e-12) & (s > -np.inf))
    return i, j, (q[i] * x[j]).sum(axis=1)


class Hnsw:
    """One graph over the rows of a matrix. Inserts are sequential; vectors
    are at unit length, a zero vector is at distance 1 from all."""

    def __init__(self, x: np.ndarray, m: int = 16, ef_construction: int = 100, ef_search: int = 50, seed: int = 1):
        self.m, self.ef, self.ef_search = max(2, m), max(ef_construction, m), max(ef_search, m)
        size = np.sqrt((x * x).sum(axis=1, keepdims=True))
        self.x = np.divide(x, size, out=np.zeros_like(x, float), where=size > 0)
        self.rng = generator("hnsw", seed)
        self.layers: list[dict[int, np.ndarray]] = []
        self.entry = -1
        for i in range(len(x)):
            self._insert(i)

    def __len__(self) -> int:
        return len(self.x)

    def _far(self, q: np.ndarray, ids) -> np.ndarray:
        return 1 - np.clip(self.x[ids] @ q, -1, 1)

    def _level(self) -> int:
        p, level = 1 / math.log(self.m), 0
        while level < 16 and self.rng.random() < p:
            level += 1
        return level

    def _search(self, q: np.ndarray, starts: list[int], ef: int, layer: int) -> list[tuple[float, int]]:
        far = self._far(q, starts)
        seen = set(starts)
        todo = [(float(d), i) for d, i in zip(far, starts)]
        heapq.heapify(todo)
        best = [(-d, -i) for d, i in todo]
        heapq.heapify(best)
        while todo:
            d, i = heapq.heappop(todo)
            if len(best) >= ef and d > -best[0][0]:
                break
            fresh = [j for j in self.layers[layer].get(i, ()) if j not in seen]
            if not fresh:
                continue
            seen.update(fresh)
            for d, j in zip(self._far(q, fresh).tolist(), fresh):
                if len(best) < ef or d < -best[0][0]:
                    heapq.heappush(todo, (d, j))
                    heapq.heappush(best, (-d, -j))
                    if len(best) > ef:
                        heapq.heappop(best)
        return sorted((-d, -i) for d, i in best)

    def _shrunk(self, i: int, ids, layer: int) -> np.ndarray:
        """The nearest of the neighbours that the layer's degree allows."""
        ids = np.array(sorted(set(ids)), np.int64)
        return ids[np.argsort(self._far(self.x[i], ids), kind="stable")[: 2 * self.m if layer == 0 else self.m]]

    def _insert(self, i: int) -> None:
        level, q = self._level(), self.x[i]
        top = len(self.layers) - 1
        starts = [self.entry]
        if self.entry >= 0:
            for layer in range(top, level, -1):
                starts = [self._search(q, starts, 1, layer)[0][1]]
            for layer in range(min(level, top), -1, -1):
                found = self._search(q, starts, self.ef, layer)
                near = [j for _, j in found[: self.m]]
                self.layers[layer][i] = np.array(near, np.int64)
                for j in near:
                    self.layers[layer][j] = self._shrunk(j, [*self.layers[layer].get(j, ()), i], layer)
                starts = [j for _, j in found]
        for layer in range(len(self.layers), level + 1):
            self.layers.append({i: np.zeros(0, np.int64)})
            self.entry = i

    def query(self, q: np.ndarray, k: int) -> list[tuple[int, float]]:
        """(row, distance) of about the k nearest."""
        if self.entry < 0:
            return []
        size = math.sqrt(float(q @ q))
        q, starts = q / size if size else q, [self.entry]
        for layer in range(len(self.layers) - 1, 0, -1):
            starts = [self._search(q, starts, 1, layer)[0][1]]
        return [(i, d) for d, i in self._search(q, starts, max(self.ef_search, k), 0)[:k]]


    def corrected(self, asked: np.ndarray, x: np.ndarray, ids: np.ndarray, found: list[tuple[int, int, float]], k: int) -> list[tuple[int, int, float]]:
        """The k nearest of each query for certain: vectors no farther than the last one that the graph found for it."""
        floor: dict[int, list[float]] = {}
        for q, _, s in found:
            floor.setdefault(q, []).append(s)
        last = np.array([min(f) if len(f := floor.get(q, ())) >= k else -np.inf for q in asked.tolist()])
        size = np.sqrt((x * x).sum(axis=1))
        some = np.flatnonzero(np.any(self.x != 0, axis=1))
        rows, out = self.x[some], []
        for at in range(0, len(x), 256):
            here = at + np.flatnonzero(size[at : at + 256] > 0)
            q = x[here] / size[here, None]
            i, j, s = best_pairs(q, rows, (asked[here, None] != ids[some]) & (q @ rows.T >= last[here, None] - 1e-9), k)
            out += zip(asked[here[i]].tolist(), ids[some[j]].tolist(), s.tolist())
        return out


def hnsw_search(vectors: DataFrame, queries: DataFrame, k: int = 10, shards: int | None = None, m: int = 16, ef_construction: int = 100, ef_search: int = 50, id_col: str = "word_id", vec: str = "vec", shard_rows: int = 20_000, seed: int = 1, checked: bool = False) -> DataFrame:
    """(query, neighbor, similarity, rank) for every row of queries. Each shard
    of about `shard_rows` vectors has its graph; all are asked and the results merged.

    With `checked`, what the graph found is held against the whole shard, by matrix products, and
    vectors of some length that it missed take their places: the result is exact, the work quadratic."""
    n = shards or max(1, -(-vectors.count() // shard_rows))
    v = vectors.where(F.col(vec).isNotNull()).select(F.col(id_col).cast("long").alias("id"), doubles(vec).alias("v"))
    data = v.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    asked = queries.where(F.col(vec).isNotNull()).select(F.col(id_col).cast("long").alias("id"), doubles(vec).alias("v"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("shard"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if left.num_rows and right.num_rows:
            left = left.sort_by("id")
            ids = left.column("id").to_numpy()
            graph = Hnsw(matrix_of(left.column("v")), m, ef_construction, ef_search, seed)
            asked_, x = right.column("id").to_numpy(), matrix_of(right.column("v"))
            for q, v in zip(asked_.tolist(), x):
                hits = [(q, int(ids[i]), 1 - d) for i, d in graph.query(v, k + 1) if ids[i] != q]
                out += hits[:k]
            if checked:
                out = graph.corrected(asked_, x, ids, out, k)
        cols = list(zip(*out)) if out else [[]] * 3
        return pa.table({"query": pa.array(cols[0], pa.int64()), "neighbor": pa.array(cols[1], pa.int64()), "similarity": pa.array(cols[2], pa.float64())})

    data, asked = (x.select(*[F.col(c).alias(c) for c in x.columns]) for x in (data, asked))
    found = data.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(run, "query long, neighbor long, similarity double")
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "neighbor")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
