"""MinHash near-duplicate search with sequential Bayesian verification.

Word shingles -> MinHash signatures -> banded candidates. A candidate pair is
compared hash batch by hash batch; after each batch the posterior probability
that its similarity reaches the threshold is bounded, and the pair is pruned
once that falls under the chosen miss probability. Survivors are verified on
their whole shingle sets. Groups are the connected components.

Pairs of one bucket are not all compared at once. Round one compares every
member of a bucket with its smallest; round two compares all members of a
bucket that still lie in different components. A pair left out is in one
component already, so the groups are those of all banded pairs while a bucket
of m copies costs m - 1 comparisons.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, lean, small, window_hashes
from .textarray import parts, word_hashes

HASHES, ROWS, SHINGLE, THRESHOLD, BATCH, MISS = 128, 4, 3, 0.55, 16, 0.01
_SET_BYTES = 5


def shingles(texts: list[str], width: int = SHINGLE):
    """For each text the hashes of its words and the distinct hashes of its
    word shingles, sorted; a text of fewer words is one shingle."""
    for a, b in parts(texts):
        h, at = word_hashes(texts[a:b])
        runs = window_hashes(h, width)
        for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
            words = h[i:j]
            yield words, np.unique(runs[i : j - width + 1] if j - i >= width else window_hashes(words, j - i) if j > i else words)


@lru_cache(1)
def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.Philox(20_11))
    return (rng.integers(0, 1 << 32, n, np.uint32) | np.uint32(1)), rng.integers(0, 1 << 32, n, np.uint32)


def signature(s: np.ndarray, n: int = HASHES) -> np.ndarray:
    a, b = _permutations(n)
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(n, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        v = x[at : at + 2048, None] * a
        v += b
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        np.minimum(out, v.min(axis=0), out=out)
    return out


def bands(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band; the band's number is part of it."""
    k = sig.reshape(-1, rows).astype(np.uint64)
    h = np.arange(len(k), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(rows):
        h = (h ^ k[:, j]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


@lru_cache(8)
def least_matches(threshold: float, hashes: int, batch: int, miss: float) -> tuple[int, ...]:
    """For each number of compared hashes, the fewest matches with which
    P(similarity >= threshold | matches) is still at least `miss`, for a
    uniform prior: that probability is P(Bin(n + 1, threshold) <= matches)."""
    out = []
    for n in range(batch, hashes + 1, batch):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def prune(a: np.ndarray, b: np.ndarray, threshold: float, batch: int = BATCH, miss: float = MISS) -> np.ndarray:
    """Which pairs of signature fragments (rows of bytes) survive. A byte of
    a hash also agrees by chance, so similarity s shows as s + (1 - s) / 256."""
    seen = threshold + (1 - threshold) / 256
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k, least in enumerate(least_matches(seen, a.shape[1], batch, miss)):
        part = slice(k * batch, (k + 1) * batch)
        matches[alive] += (a[alive, part] == b[alive, part]).sum(axis=1)
        alive = alive[matches[alive] >= least]
    return alive


def _pack(s: np.ndarray) -> bytes:
    return np.ascontiguousarray(s.view(np.uint8).reshape(-1, 8)[:, 3:]).tobytes()


def _unpack(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // _SET_BYTES, 8), np.uint8)
    out[:, 3:] = np.frombuffer(b, np.uint8).reshape(-1, _SET_BYTES)
    return out.view(np.uint64).ravel()


def jaccard(a: bytes, b: bytes) -> float:
    x, y = _unpack(a), _unpack(b)
    both = np.concatenate([x, y])
    both.sort()
    same = int((both[1:] == both[:-1]).sum())
    return same / max(1, len(x) + len(y) - same)


def _sign(batches):
    import xxhash

    for batch in batches:
        ids, keys, frags, keys_of_bands = [], [], [], []
        for i, (words, s) in zip(batch.column(0).to_pylist(), shingles(batch.column(1).to_pylist())):
            if not len(words):
                continue
            sig = signature(s)
            ids.append(i)
            keys.append(xxhash.xxh3_128_digest(words.tobytes()))
            frags.append((sig >> np.uint32(8)).astype(np.uint8).tobytes())
            keys_of_bands.append(bands(sig))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(frags, pa.binary()), pa.array(keys_of_bands, pa.list_(pa.int64()))],
            ["doc_id", "same", "frag", "bands"],
        )


def _sets(batches):
    for batch in batches:
        sets = [_pack(s) for _, s in shingles(batch.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["doc_id", "words"])


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) of every node of the edges (a, b); root is the smallest
    node of the component. Alternating large-star and small-star steps, whose number grows with
    the logarithm of the nodes; not to be done after `rounds` is an error, never a partial result."""

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    was = state(e)
    for _ in range(rounds):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = F.least("a", F.min("b").over(Window.partitionBy("a")))
        large = both.withColumn("m", low).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        m = F.min("b").over(Window.partitionBy("a"))
        least = large.where("a > b").withColumn("m", m)
        e = cut(least.select("a", F.col("m").alias("b")).union(least.select(F.col("b").alias("a"), F.col("m").alias("b"))).where("a > b").distinct())
        now = state(e)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError(f"the components haven't settled in {rounds} rounds")
    return e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))


def _verified(pairs: DataFrame, signed: DataFrame, docs: DataFrame, threshold: float, miss: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar enough; checkpointed."""

    def side(name: str) -> DataFrame:
        return signed.select(F.col("doc_id").alias(name), F.col("frag").alias(f"frag_{name}"))

    def bayes(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 3))
            yield batch.select(["a", "b"]).take(pa.array(prune(x, y, threshold, BATCH, miss)))

    def exact(batches):
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            yield batch.select(["a", "b"]).filter(pa.array([jaccard(x, y) >= threshold for x, y in zip(a, b)], pa.bool_()))

    alive = cut(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "frag_a", "frag_b").mapInArrow(lean(bayes), "a long, b long"))
    used = alive.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = cut(docs.join(small(used, 2 * alive.count()), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(lean(_sets), "doc_id long, words binary"))
    one, two = (sets.select(F.col("doc_id").alias(k), F.col("words").alias(f"words_{k}")) for k in "ab")
    return cut(alive.join(one, "a").join(two, "b").select("a", "b", "words_a", "words_b").mapInArrow(lean(exact), "a long, b long").distinct())


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """(doc_id, duplicate_of) of each document that repeats another; the
    smallest doc_id of a group stays and has no row.

    Similarity: Jaccard of the sets of three-word shingles of the lower-cased
    text. Rows with a null doc_id, a null text or a text without words take no
    part. Rows that share a doc_id are one document. A text of fewer than
    three words is one shingle. Other columns are ignored. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null and text is not null")
    signed = docs.mapInArrow(lean(_sign), "doc_id long, same binary, frag binary, bands array<long>")
    signed = cut(signed.withColumn("rep", F.min("doc_id").over(Window.partitionBy("same"))))
    copies = signed.where("rep < doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    signed = signed.where("rep = doc_id").drop("rep", "same").dropDuplicates(["doc_id", "frag"])
    # a band's extremes are summed up task by task and joined back, so no band has to be in one task
    banded = signed.select("doc_id", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("last")).where("lead < last")
    met = cut(banded.join(shared.select("band", "lead"), "band"))
    frags = signed.select("doc_id", "frag")
    first = met.where("lead < doc_id").select(F.col("doc_id").alias("a"), F.col("lead").alias("b")).distinct()
    found = _verified(first, frags, docs, threshold, miss)
    groups = cut(components(found))
    apart = met.join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    apart = cut(apart.select("band", "doc_id", "root", "lead"))
    mixed = apart.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("band")
    apart = cut(apart.join(mixed, "band"))
    x, y = apart.alias("x"), apart.alias("y")
    cross = x.join(y, F.col("x.band") == F.col("y.band")).where("x.root <> y.root and x.doc_id > y.doc_id and y.doc_id <> y.lead")
    second = cross.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct()
    more = _verified(second, frags, docs, threshold, miss)
    return components(copies.union(found).union(more)).select(F.col("node").alias("doc_id"), F.col("root").alias("duplicate_of"))


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """The rows of docs without those that :func:`near_duplicates` names; all
    columns stay. Rows it can't compare are kept."""
    gone = cut(near_duplicates(docs, threshold, miss).select(F.col("doc_id").alias("_gone")))
    return docs.join(small(gone, gone.count()), docs["doc_id"].cast("long") == gone["_gone"], "left_anti")
