"""A small transformer encoder over sequences of vectors, in numpy batches.

Queries, keys and values share one projection; the second feed-forward
matrix is drawn once from the seed, so results can be repeated. Attention goes tile
by tile, so the scores of a whole sequence are never held.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rng import generator
from ..functions.vector import doubles, lists_of, matrix_of
from ..sources.shared import written

EPSILON = 1e-5
#: Rows of a block of a sequence, and blocks whose queries one task works out at a time.
BLOCK, GROUP = 1024, 4
#: Queries and keys of one tile of scores.
_QUERIES, _KEYS = 128, 1024


def position_encoding(length: int, dim: int, start: int = 0) -> np.ndarray:
    """Sine at even components, cosine at odd ones, with the even one's wave length."""
    even = np.arange(dim) // 2 * 2
    angle = np.arange(start, start + length)[:, None] / 10000.0 ** (even / dim)
    return np.where(np.arange(dim) % 2 == 0, np.sin(angle), np.cos(angle))


def position_column(pos: Column, dim: int) -> Column:
    """The same for a column of positions."""
    return F.array(*[(F.sin if i % 2 == 0 else F.cos)(pos / F.lit(10000.0 ** ((i // 2 * 2) / dim))) for i in range(dim)])


def layer_norm(x: np.ndarray, gamma: np.ndarray, beta: np.ndarray) -> np.ndarray:
    d = x - x.mean(axis=-1, keepdims=True)
    return d / np.sqrt((d * d).mean(axis=-1, keepdims=True) + EPSILON) * gamma + beta


class Encoder:
    def __init__(self, layers: int, heads: int, dim: int, hidden: int, max_length: int = 512, seed: int = 1):
        if dim % heads:
            raise ValueError("dim must be a multiple of the number of heads")
        self.heads, self.dim, self.max_length = heads, dim, max_length
        rng = generator("transformer", seed)

        def draw(*shape):
            return rng.uniform(-1, 1, shape) / np.sqrt(shape[0])

        self.layers = [
            {"qkv": draw(dim, dim), "out": draw(dim, dim), "w1": draw(dim, hidden), "b1": np.zeros(hidden), "w2": draw(hidden, dim), "gamma": np.ones(dim), "beta": np.zeros(dim)} for _ in range(layers)
        ]

    def attention(self, x: np.ndarray, p: dict, among: np.ndarray | None = None) -> np.ndarray:
        """What the rows of x take from all rows of `among` (default: x). Sums of weights
        are carried from tile to tile, with the greatest score so far taken off."""
        n, size = len(x), self.dim // self.heads
        h = x @ p["qkv"]
        k = h if among is None else among @ p["qkv"]
        out = np.empty((n, self.dim))
        for head in range(self.heads):
            at = slice(head * size, (head + 1) * size)
            keys = np.ascontiguousarray(k[:, at].T)
            values = np.concatenate([k[:, at], np.ones((len(k), 1))], axis=1)  # the last column adds up the weights
            for i in range(0, n, _QUERIES):
                q = h[i : i + _QUERIES, at] / np.sqrt(size)
                total, most = np.zeros((len(q), size + 1)), np.full((len(q), 1), -np.inf)
                for j in range(0, len(k), _KEYS):
                    s = q @ keys[:, j : j + _KEYS]
                    now = np.maximum(most, s.max(axis=1, keepdims=True))
                    s -= now
                    np.exp(s, out=s)
                    total = total * np.exp(most - now) + s @ values[j : j + _KEYS]
                    most = now
                out[i : i + _QUERIES, at] = total[:, :-1] / total[:, -1:]
        return out @ p["out"]

    def layer(self, x: np.ndarray, p: dict, among: np.ndarray | None = None) -> np.ndarray:
        x = layer_norm(x + self.attention(x, p, among), p["gamma"], p["beta"])
        return layer_norm(x + np.maximum(x @ p["w1"] + p["b1"], 0) @ p["w2"], p["gamma"], p["beta"])

    def encode(self, x: np.ndarray) -> np.ndarray:
        """One sequence (length, dim)."""
        x = x + position_encoding(len(x), self.dim)
        for p in self.layers:
            x = self.layer(x, p)
        return x


def encode_sequences(rows: DataFrame, encoder: Encoder, key: str, pos: str, vec: str = "vec", block: int = BLOCK) -> DataFrame:
    """(key, pos, vec): every sequence, the rows of one key in the order of pos, encoded.

    Sequences are cut into packed blocks. In each layer a task takes the queries of some
    blocks and meets all blocks of their sequence, so a long one is spread over tasks. A task holds
    the rows of one sequence, never their scores against each other. Work is quadratic in the length."""
    kinds, dim = {c: rows.schema[c].dataType.simpleString() for c in (key, pos)}, encoder.dim
    state_of, names = f"key {kinds[key]}, block int, groups int, pos array<{kinds[pos]}>, x array<double>", ["key", "block", "groups", "pos", "x"]
    one = Window.partitionBy("key")
    flat = rows.select(F.col(key).alias("key"), F.col(pos).alias("pos"), doubles(vec).alias("v"))
    flat = flat.withColumns({"place": F.row_number().over(one.orderBy("pos")) - 1, "groups": F.ceil(F.count("*").over(one) / (block * GROUP)).cast("int")})

    def packed(x: np.ndarray) -> pa.Array:
        return lists_of(x.reshape(1, -1))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        first = table.slice(0, 1)
        x = matrix_of(table.column("v")) + position_encoding(table.num_rows, dim, table.column("place")[0].as_py())
        places = pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), table.column("pos").combine_chunks())
        return pa.Table.from_arrays([first.column("key"), first.column("block"), first.column("groups"), places, packed(x)], names)

    state = written(flat.withColumn("block", F.floor(F.col("place") / block).cast("int")).groupBy("key", "block").applyInArrow(pack, state_of), "blocks")
    # by number, so that the few large groups stay apart
    parts = max(1, 2 * -(-state.count() // GROUP))

    def rows_of(x: pa.Scalar) -> np.ndarray:
        return x.values.to_numpy().reshape(-1, dim)

    def layer_of(p: dict):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            among = np.concatenate([rows_of(x) for x in right.sort_by("block").column("x")])
            x = [packed(encoder.layer(rows_of(x), p, among)) for x in left.column("x")]
            return left.select(names[:-1]).append_column("x", pa.chunked_array(x))

        return run

    for p in encoder.layers:
        mine = state.withColumn("of", F.floor(F.col("block") / GROUP).cast("int")).repartition(parts, "key", "of")
        all_ = state.select("key", "block", "x", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("of")).repartition(parts, "key", "of")
        state = written(mine.groupBy("key", "of").cogroup(all_.groupBy("key", "of")).applyInArrow(layer_of(p), state_of), "blocks")

    def unpack(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                places = batch.column(1)[r].values
                yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(0)[r], len(places)), places, lists_of(rows_of(batch.column(2)[r]))], [key, pos, vec])

    return state.select("key", "pos", "x").mapInArrow(unpack, f"{key} {kinds[key]}, {pos} {kinds[pos]}, {vec} array<double>")
