"""Quantized vectors: 8-bit integers with a scale a row, or 16-bit floats."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, ShortType

from ..functions.vector import cosine_or_zero, doubles, total

RATIO = {"int8": 4.0, "fp16": 2.0}


def int8_scale(v) -> Column:
    """Largest absolute component / 127; 1 for a zero vector."""
    top = F.array_max(F.transform(doubles(v), F.abs))
    return F.when(top > 0, top / 127).otherwise(1.0)


def int8(v, scale: Column) -> Column:
    """Components in steps of the scale, halves rounded away from zero."""
    return F.transform(doubles(v), lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.round(x / scale))).cast("tinyint"))


@F.arrow_udf(ArrayType(ShortType()))
def _half(v: pa.Array) -> pa.Array:
    flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float16).view(np.int16)
    offsets = v.offsets.to_numpy()
    return pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), pa.array(flat), mask=v.is_null() if v.null_count else None)


@F.arrow_udf(ArrayType(DoubleType()))
def _whole(v: pa.Array) -> pa.Array:
    flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.int16).view(np.float16).astype(float)
    offsets = v.offsets.to_numpy()
    return pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), pa.array(flat), mask=v.is_null() if v.null_count else None)


def quantize(vectors: DataFrame, mode: str = "int8", vec: str = "vec") -> DataFrame:
    """vectors with `q` and `scale` ("int8"), or `h`, the bits of 16-bit floats ("fp16"), in place of vec."""
    if mode == "int8":
        return vectors.withColumn("scale", int8_scale(vec)).withColumn("q", int8(vec, F.col("scale"))).withColumn("scale", F.col("scale").cast("float")).drop(vec)
    if mode == "fp16":
        return vectors.withColumn("h", _half(doubles(vec))).drop(vec)
    raise ValueError(f"unknown mode {mode}: int8 or fp16")


def dequantize(q: DataFrame, vec: str = "vec") -> DataFrame:
    if "h" in q.columns:
        return q.withColumn(vec, _whole("h")).drop("h")
    return q.withColumn(vec, F.transform("q", lambda x: x * F.col("scale").cast("double"))).drop("q", "scale")


def quantized_similarity(q: DataFrame, a, b, word_col: str = "word") -> DataFrame:
    """(similarity): one row; 0 for a zero norm, none for an unknown word."""
    v = dequantize(q.where(F.col(word_col).isin(a, b)), "_v")
    x, y = (v.where(F.col(word_col) == w).select(F.col("_v").alias(k)) for w, k in ((a, "x"), (b, "y")))
    return x.crossJoin(y).select(cosine_or_zero("x", "y").alias("similarity"))


def reconstruction_error(vectors: DataFrame, mode: str = "int8", vec: str = "vec") -> DataFrame:
    """(error): the mean absolute difference over all components."""
    both = dequantize(quantize(vectors.withColumn("_orig", doubles(vec)), mode, vec), vec)
    off = total(F.transform(F.arrays_zip(F.col("_orig").alias("a"), F.col(vec).alias("b")), lambda s: F.abs(s["a"] - s["b"])))
    return both.agg((F.sum(off) / F.sum(F.size("_orig"))).alias("error"))


def compression_ratio(mode: str) -> float:
    return RATIO[mode]
