"""Functions of vectors kept as ARRAY columns: higher-order SQL functions for
expressions, numpy over Arrow batches for bulk work."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def doubles(v) -> Column:
    return _c(v).cast("array<double>")


def total(v) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a, b) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v) -> Column:
    return F.sqrt(total(F.transform(doubles(v), lambda x: x * x)))


def cosine(a, b, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity; null if a norm is zero. Norms known already may be given."""
    n = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(n > 0, dot(a, b) / n)


def cosine_or_zero(a, b) -> Column:
    """Cosine similarity; 0 for a zero norm, vectors of unequal length and a null."""
    return F.when(F.size(_c(a)) == F.size(_c(b)), F.coalesce(cosine(a, b), F.lit(0.0))).otherwise(0.0)


def cosine_distance(a, b) -> Column:
    """1 - cosine, held to [0, 2]; 1 for a zero norm."""
    return 1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(cosine(a, b), F.lit(0.0))))


def add(a, b) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x + y)


def subtract(a, b) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x - y)


def add_scaled(a, b, scale: float) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x + y * scale)


def interpolate(a, b, alpha: float) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x * alpha + y * (1 - alpha))


def normalized(v) -> Column:
    """At unit length; a zero vector stays."""
    n = norm(v)
    return F.when(n > 0, F.transform(doubles(v), lambda x: x / n)).otherwise(doubles(v))


def variance(v) -> Column:
    """Population variance of the components."""
    d = doubles(v)
    mean = total(d) / F.size(d)
    return total(F.transform(d, lambda x: (x - mean) * (x - mean))) / F.size(d)


def squared_distance(a, b) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def _product_udf(m: np.ndarray):
    @F.arrow_udf(ArrayType(DoubleType()))
    def product(v: pa.Array) -> pa.Array:
        out = [None] * len(v)
        rows = [i for i, x in enumerate(v) if x.is_valid]
        if rows:
            y = np.stack([np.asarray(v[i].values, float) for i in rows]) @ m.T
            for i, x in zip(rows, y):
                out[i] = x
        return pa.array(out, pa.list_(pa.float64()))

    return product


def matrix_times(matrix: np.ndarray, v) -> Column:
    """matrix @ v for a matrix known on the driver: an expression if it is small, else
    products of whole batches."""
    m = np.asarray(matrix, float)
    if m.size > 256:
        return _product_udf(m)(doubles(v))
    rows = [F.array(*[F.lit(float(x)) for x in row]) for row in np.asarray(matrix)]
    return F.array(*[dot(r, v) for r in rows])


# --- fusion of two vectors ---


def concatenate(a, b) -> Column:
    return F.concat(doubles(a), doubles(b))


def weighted_average(a, b, weight: float) -> Column:
    """Null for vectors of unequal length."""
    return F.when(F.size(_c(a)) == F.size(_c(b)), interpolate(a, b, weight))


def attention_fusion(a, b) -> Column:
    """Average whose weight of `a` is (1 + tanh(cosine)) / 2. `a` itself for a
    zero norm, null for vectors of unequal length."""
    c = cosine(a, b)
    w = 0.5 + 0.5 * F.tanh(c)
    mixed = F.when(c.isNull(), doubles(a)).otherwise(F.zip_with(doubles(a), doubles(b), lambda x, y: x * w + y * (1 - w)))
    return F.when(F.size(_c(a)) == F.size(_c(b)), mixed)


def project_and_fuse(a, b, a_proj: np.ndarray, b_proj: np.ndarray) -> Column:
    """Mean of both projections (vector times matrix); null if their widths differ."""
    a_proj, b_proj = np.asarray(a_proj), np.asarray(b_proj)
    if a_proj.shape[1] != b_proj.shape[1]:
        return F.lit(None).cast("array<double>")
    return interpolate(matrix_times(a_proj.T, a), matrix_times(b_proj.T, b), 0.5)


# --- aggregation ---


def sum_vectors(df: DataFrame, keys: list[str], vec: str, dim: int | None = None) -> DataFrame:
    """(keys, n, total): the sum of the vectors of each key.

    With `dim` known and small it is one sum a component, inside code
    generation. Otherwise partial sums are made task by task in numpy and only those are shuffled."""
    if dim is not None and dim <= 128:
        sums = df.groupBy(*keys).agg(F.count(vec).alias("n"), *[F.sum(doubles(vec)[i]).alias(f"_{i}") for i in range(dim)])
        return sums.select(*keys, "n", F.array(*[f"_{i}" for i in range(dim)]).alias("total"))
    schema = df.select(*keys).schema.add("n", LongType()).add("total", ArrayType(DoubleType()))

    def merge(table: pa.Table) -> pa.Table:
        x = np.stack([np.asarray(v, float) for v in table.column("total").to_pylist()])
        out = {k: table.column(k).slice(0, 1) for k in keys}
        return pa.table(out | {"n": pa.array([int(sum(table.column("n").to_pylist()))]), "total": pa.array([x.sum(axis=0)], pa.list_(pa.float64()))})

    def partial(batches):
        held: dict = {}
        for batch in batches:
            for *key, v in zip(*(batch.column(c).to_pylist() for c in [*keys, vec])):
                if v is not None:
                    n, s = held.get(tuple(key), (0, 0.0))
                    held[tuple(key)] = n + 1, s + np.asarray(v, float)
            if len(held) > 20_000:
                yield _rows(held, keys, batch)
                held = {}
        if held:
            yield _rows(held, keys, batch)

    return df.select(*keys, vec).mapInArrow(partial, schema).groupBy(*keys).applyInArrow(merge, schema)


def _rows(held: dict, keys: list[str], like: pa.RecordBatch) -> pa.RecordBatch:
    cols = [pa.array(c, like.schema.field(k).type) for k, c in zip(keys, zip(*held))]
    return pa.RecordBatch.from_arrays([*cols, pa.array([n for n, _ in held.values()], pa.int64()), pa.array([s for _, s in held.values()], pa.list_(pa.float64()))], [*keys, "n", "total"])


def mean_vectors(df: DataFrame, keys: list[str], vec: str, dim: int | None = None, name: str = "vec") -> DataFrame:
    """(keys, name): the mean vector of each key."""
    return sum_vectors(df.where(F.col(vec).isNotNull()), keys, vec, dim).select(*keys, F.transform("total", lambda x: x / F.col("n")).alias(name))


def matrix_of(column: pa.Array) -> np.ndarray:
    """The rows of an Arrow column of equally long lists, without a Python object for each number."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def lists_of(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as an Arrow list column."""
    x = np.ascontiguousarray(x, float)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel())) if len(x) and x.shape[1] else pa.array([[]] * len(x), pa.list_(pa.float64()))
