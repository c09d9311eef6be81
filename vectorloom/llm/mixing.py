"""Mixing sources to target weights.

Tokens are packed into blocks of a fixed length, source by source. Each
output shard draws the number of blocks of every source from a multinomial
distribution; the draws of a source, counted through over all shards, pass
through a pseudorandom permutation of its block numbers, epoch by epoch, and
the blocks are joined by number.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import END_OF_TEXT, TOKENIZER, bpe, cut, lean, mix64, small, written

BLOCK, SHARD, CHUNK_DOCS, ALPHA = 2048, 1024, 256, 0.7
#: Rests of chunks that are packed together in one task.
FAN = 256


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Position of each index under a permutation of 0..size-1 chosen by the
    key: a balanced Feistel network over the next power of four, walked on while it leaves the range."""
    index, size, key = (np.asarray(x).astype(np.uint64) for x in (index, size, key))
    bits = np.maximum(1, np.ceil(np.log2(np.maximum(size, 2).astype(float)) / 2)).astype(np.uint64)
    low = (np.uint64(1) << bits) - np.uint64(1)
    out, todo = index.copy(), np.arange(len(index))
    while len(todo):
        left, right = out[todo] >> bits[todo], out[todo] & low[todo]
        for r in range(6):
            left, right = right, left ^ (mix64(right * np.uint64(0x9E3779B97F4A7C15) + key[todo] + np.uint64(r)) & low[todo])
        out[todo] = (left << bits[todo]) | right
        todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


_BLOCKS = "source string, chunk int, k int, doc_ids array<long>, n_tokens int, tokens binary"


def _emit(source: str, chunk: int, ids: list, sizes: list[int], tokens: np.ndarray, block: int, whole: bool) -> pa.RecordBatch:
    """The blocks of one chunk; its short tail too unless `whole`."""
    ends = np.cumsum(sizes)
    n = len(tokens) // block if whole else -(-len(tokens) // block)
    rows = []
    for k in range(n):
        part = tokens[k * block : (k + 1) * block]
        a, b = np.searchsorted(ends, k * block, "right"), np.searchsorted(ends, k * block + len(part), "left")
        rows.append((source, chunk, k, list(dict.fromkeys(ids[a : b + 1])), len(part), part.tobytes()))
    cols = list(zip(*rows)) if rows else [[]] * 6
    types = (pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], ["source", "chunk", "k", "doc_ids", "n_tokens", "tokens"])


def _runs(batches, keys: int):
    """Consecutive rows of equal first columns, across batches."""
    held, key = [], None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:keys] != key:
                if held:
                    yield key, held
                held, key = [], row[:keys]
            held.append(row[keys:])
    if held:
        yield key, held


def packed(docs: DataFrame, block: int = BLOCK, chunk_docs: int = CHUNK_DOCS, tokenizer: str = TOKENIZER, fan: int = FAN) -> DataFrame:
    """(source, chunk, k, doc_ids, n_tokens, tokens) blocks of all tokens of
    all documents, each document followed by an end-of-text token. `tokens`
    holds little-endian 16-bit ids.

    The documents of a source are spread by a hash of doc_id over chunks of
    about `chunk_docs` and are in the order of doc_id in each. What is left of a
    chunk after its last whole block is packed with the rests of up to `fan` neighbouring chunks, what those
    leave with that of `fan` such groups, and so on (chunks below 0), so that no task gets all rests of a source;
    only a source's last block may be short. A null source is "(none)". Null and
    empty texts have no tokens and no end mark. A null doc_id is packed and shown as -1.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("(none)")).alias("source"), "text").where("length(text) > 0")
    sizes = docs.groupBy("source").count()
    n = sizes.count()
    chunks = sizes.select("source", F.ceil(F.col("count") / chunk_docs).cast("int").alias("chunks"))
    docs = docs.join(small(chunks, n), "source")
    docs = docs.select("source", F.pmod(F.xxhash64("doc_id"), "chunks").cast("int").alias("chunk"), F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), "text")
    docs = docs.repartition("source", "chunk").sortWithinPartitions("source", "chunk", "doc_id", "text")

    def pack(batches):
        coder = bpe(tokenizer)
        end = np.array([END_OF_TEXT], np.uint16)
        for (source, chunk), rows in _runs(batches, 2):
            parts = [np.concatenate([coder.ids(t), end]) for _, t in rows]
            ids, lengths, tokens = [i for i, _ in rows], [len(p) for p in parts], np.concatenate(parts)
            yield _emit(source, chunk, ids, lengths, tokens, block, False)

    blocks = written(docs.mapInArrow(lean(pack), _BLOCKS), "blocks")
    out, level = blocks.where(F.col("n_tokens") == block), 0
    rests = blocks.where(F.col("n_tokens") < block).select("source", "chunk", "doc_ids", "tokens")
    many = (rests.agg(F.max("chunk")).first()[0] or 0) + 1
    while True:
        level += 1
        # level by level: so many rests of a source together, of which each task leaves one, until all fit in one task
        last = many <= fan
        group = F.lit(0) if last else F.floor(F.col("chunk") / fan).cast("int")
        order = rests.select("source", F.col("chunk").alias("was"), group.alias("chunk"), "doc_ids", "tokens")
        made = order.repartition("source", "chunk").sortWithinPartitions("source", "chunk", "was").select("source", "chunk", "doc_ids", "tokens").mapInArrow(_rest(block), _BLOCKS)
        if last:
            return out.union(made.withColumn("chunk", F.lit(-level)))
        made = written(made, "rests")
        out = out.union(made.where(F.col("n_tokens") == block).withColumn("chunk", -1 - level * F.lit(1 << 20) - F.col("chunk")))
        rests, many = made.where(F.col("n_tokens") < block).select("source", "chunk", "doc_ids", "tokens"), -(-many // fan)


def _rest(block: int):
    """Packs what chunks left over, source by source and chunk by chunk; the last block may be short."""

    def run(batches):
        for (source, chunk), rows in _runs(batches, 2):
            ids, held, k = [], np.zeros(0, np.uint16), 0
            for doc_ids, tokens in rows:
                ids, held = ids + [i for i in doc_ids if i not in ids[-1:]], np.concatenate([held, np.frombuffer(tokens, np.uint16)])
                if len(held) >= block:
                    yield _one(source, chunk, k, ids, held[:block])
                    held, k, ids = held[block:], k + 1, list(doc_ids)
            if len(held):
                yield _one(source, chunk, k, ids, held)

    return run


def _one(source: str, chunk: int, k: int, ids: list[int], tokens: np.ndarray) -> pa.RecordBatch:
    cols = ([source], [chunk], [k], [ids], [len(tokens)], [tokens.tobytes()])
    types = (pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["source", "chunk", "k", "doc_ids", "n_tokens", "tokens"])


def mix(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, block: int = BLOCK, shard_blocks: int = SHARD, seed: int = 7, tokenizer: str = TOKENIZER) -> DataFrame:
    """(shard, slot, source, block, epoch, doc_ids, n_tokens, tokens): a
    mixture with as many blocks as the packed corpus.

    `weights` gives each source's share (sources it leaves out get none,
    those without blocks are ignored); by default a share is proportional to
    a source's number of blocks to the power `alpha`. Block numbers of a source are used up epoch by epoch, so
    that none is used again before all were. Equal rows are packed as often as they are there;
    other columns are ignored; an empty table, or weights without any source that exists, gives no rows.
    See :func:`packed` for nulls and empty texts.
    """
    spark = docs.sparkSession
    blocks = packed(docs, block, tokenizer=tokenizer)
    per_chunk = cut(blocks.groupBy("source", "chunk").agg(F.count("*").alias("n")))
    sizes = {r["source"]: r["n"] for r in per_chunk.groupBy("source").agg(F.sum("n").alias("n")).orderBy("source").collect()}
    share = {s: (n**alpha if weights is None else weights.get(s, 0.0)) for s, n in sizes.items()}
    names = [s for s in sizes if share[s] > 0]
    total = sum(sizes.values()) if names else 0
    p = np.array([share[s] for s in names]) / (sum(share[s] for s in names) or 1)
    shards = -(-total // shard_blocks)

    def draw(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                n = min(shard_blocks, total - k * shard_blocks)
                counts = np.random.Generator(np.random.Philox(key=[seed, k])).multinomial(n, p)
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(names), pa.int64()), pa.array(range(len(names)), pa.int32()), pa.array(counts, pa.int64()), pa.array(np.cumsum(counts) - counts, pa.int64()), pa.array([n] * len(names), pa.int64())], ["shard", "s", "n", "before", "filled"])

    draws = cut(spark.range(0, shards).mapInArrow(draw, "shard long, s int, n long, before long, filled long"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("s").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slots = draws.withColumn("earlier", earlier).where("n > 0").select("shard", "s", "before", "earlier", "filled", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    counts = np.array([sizes[s] for s in names], np.int64)

    def place(batches):
        for batch in batches:
            shard, s, before, earlier, filled, i = (c.to_numpy() for c in batch.columns)
            t = earlier + i
            size = counts[s]
            epoch = t // size
            key = mix64(np.uint64(seed) * np.uint64(1_000_003) + s.astype(np.uint64) * np.uint64(65_537) + mix64(epoch))
            number = permuted(t % size, size, key)
            slot = permuted(before + i, filled, mix64(shard.astype(np.uint64) + np.uint64(seed) * np.uint64(7919)))
            yield pa.RecordBatch.from_pandas(pd.DataFrame({"shard": shard, "slot": slot, "source": [names[x] for x in s], "block": number, "epoch": epoch}), preserve_index=False)

    slots = slots.mapInArrow(place, "shard long, slot long, source string, block long, epoch long")
    first = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbers = per_chunk.withColumn("first", first).select("source", "chunk", "first", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("k"))
    numbers = numbers.select("source", "chunk", "k", (F.col("first") + F.col("k")).alias("block"))
    # joined by a shuffle at every size: the list grows with the corpus
    wanted = cut(slots.join(numbers, ["source", "block"]))
    return blocks.join(wanted.hint("shuffle_hash"), ["source", "chunk", "k"]).select("shard", "slot", "source", "block", "epoch", "doc_ids", "n_tokens", "tokens")
