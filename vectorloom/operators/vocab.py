"""Vocabularies, word distributions, and seeded splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rng import u01
from ..functions.text import TextProcessor
from ..sources.shared import written

#: Token numbers a document may have beside its id in one 64-bit position.
_TOKEN_BITS, _BUCKET_BITS = 24, 36


def numbered(df: DataFrame, bucket: Column, order: list, name: str = "rn", start: int = 0) -> DataFrame:
    """df with consecutive numbers in the given order, without sorting
    everything in one task. `bucket` must not fall in that order; rows are sorted
    bucket by bucket and only the buckets' sizes are summed in one place."""
    b = df.withColumn("__bucket", bucket)
    offsets = b.groupBy("__bucket").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = offsets.select(F.col("__bucket").alias("__of"), before.alias("__before"))
    rows = b.withColumn("__row", F.row_number().over(Window.partitionBy("__bucket").orderBy(*order)))
    # null buckets come first and must meet their own offset
    return rows.join(offsets, F.col("__bucket").eqNullSafe(F.col("__of"))).withColumn(name, (F.col("__before") + F.col("__row") - 1 + start).cast("long")).drop("__bucket", "__of", "__before", "__row")


def ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """df as a written table with `__bucket`: ranges of about equal size in the order of
    the columns, as many as the shuffle has partitions. For keys of which no coarse form is known."""
    return written(df.repartitionByRange(*order).withColumn("__bucket", F.spark_partition_id()), "ranges")


def shuffled(df: DataFrame, keys: list[str], seed: int, name: str = "rn", buckets: int = 1024) -> DataFrame:
    """df numbered in a random order that depends on the keys' values and the seed alone."""
    u = df.withColumn("__u", u01(seed, *[F.col(k) for k in keys]))
    return numbered(u, F.floor(F.col("__u") * buckets), ["__u", *keys], name).drop("__u")


# --- vocabulary ---


def build_vocab(docs: DataFrame, processor: TextProcessor | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(word_id, word, freq) of documents with integer keys; ids count from 0
    in the order of first occurrence (by key, then place in the text)."""
    words = F.flatten((processor or TextProcessor()).sentences(F.col(text)))
    t = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), F.posexplode(words).alias("i", "word"))
    # one long, so that the aggregation stays in hash maps; an id or a text too large for it is an error, not a wrong order
    fits = (F.col("i") < 1 << _TOKEN_BITS) & F.col("k").between(-(1 << 63 - _TOKEN_BITS), (1 << 63 - _TOKEN_BITS) - 1)
    place = F.when(fits, F.shiftleft("k", _TOKEN_BITS) + F.col("i")).otherwise(F.raise_error(F.lit("a document has 2^24 tokens or an id beyond 2^39: use vocab_of_sentences")).cast("long"))
    first = t.groupBy("word").agg(F.count("*").alias("freq"), F.min(place).alias("_first"))
    return numbered(first, F.shiftright("_first", _BUCKET_BITS), ["_first"], "word_id").select("word_id", "word", "freq")


def vocab_of_sentences(sentences: DataFrame, key: str = "doc_id") -> DataFrame:
    """The same of (key, sent_id, words) rows, for keys of any type."""
    t = sentences.select(key, "sent_id", F.posexplode("words").alias("pos", "word"))
    first = t.groupBy("word").agg(F.count("*").alias("freq"), F.min(F.struct(key, "sent_id", "pos")).alias("_first"))
    first = ranged(first, ["_first"])
    return numbered(first, F.col("__bucket"), ["_first"], "word_id").select("word_id", "word", "freq")


def total_words(vocab: DataFrame) -> DataFrame:
    return vocab.agg(F.coalesce(F.sum("freq"), F.lit(0)).cast("long").alias("total"))


def negative_distribution(vocab: DataFrame, power: float = 0.75) -> DataFrame:
    """(word_id, word, p): the unigram distribution raised to a power."""
    t = vocab.agg(F.sum(F.pow(F.col("freq"), F.lit(power))).alias("_t"))
    return vocab.crossJoin(F.broadcast(t)).select("word_id", "word", (F.pow(F.col("freq"), F.lit(power)) / F.col("_t")).alias("p"))


def drop_probability(vocab: DataFrame, threshold: float | None) -> DataFrame:
    """(word_id, word, p_drop): the share of a word's uses that sub-sampling skips."""
    t = vocab.agg(F.sum("freq").alias("_t"))
    f = F.col("freq") / F.col("_t")
    p = F.when(f > threshold, 1 - F.sqrt(F.lit(threshold) / f)).otherwise(0.0) if threshold is not None else F.lit(0.0)
    return vocab.crossJoin(F.broadcast(t)).select("word_id", "word", p.alias("p_drop"))


def new_words(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """(word, freq) of the words that the vocabulary lacks."""
    return words.groupBy("word").agg(F.count("*").alias("freq")).join(vocab.select("word"), "word", "left_anti")


def extend_vocab(vocab: DataFrame, words: DataFrame, count: bool = True) -> DataFrame:
    """The vocabulary with the new ones of words (one a row) after its last
    id, in the order of the alphabet. With `count` false they have frequency
    0, so that they are never drawn as negatives."""
    last = vocab.agg(F.coalesce(F.max("word_id"), F.lit(-1)).alias("_last"))
    fresh = numbered(new_words(words, vocab), F.substring("word", 1, 2), ["word"])
    fresh = fresh.crossJoin(F.broadcast(last)).select((F.col("_last") + 1 + F.col("rn")).alias("word_id"), "word", F.col("freq") if count else F.lit(0).cast("long").alias("freq"))
    return vocab.select("word_id", "word", "freq").union(fresh)


# --- splits ---


def split(df: DataFrame, keys: list[str], ratio: float, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """floor(n * ratio) rows, and the others."""
    n = df.count()
    r = shuffled(df, keys, seed, "_rn")
    k = int(n * ratio)
    return r.where(F.col("_rn") < k).drop("_rn"), r.where(F.col("_rn") >= k).drop("_rn")


def folds(df: DataFrame, keys: list[str], k: int, seed: int = 1) -> DataFrame:
    """df with `fold`: n // k rows each, the last one has the rest too."""
    n = df.count()
    if not 2 <= k <= n:
        raise ValueError(f"k must lie between 2 and the {n} rows")
    return shuffled(df, keys, seed, "_rn").withColumn("fold", F.least(F.floor(F.col("_rn") / (n // k)), F.lit(k - 1)).cast("int")).drop("_rn")


def batches(df: DataFrame, keys: list[str], size: int, bucket: Column | None = None, shuffle_seed: int | None = None) -> DataFrame:
    """df with `batch_id` (consecutive rows in the order of keys) and `place`
    inside the batch, shuffled there if a seed is given. `bucket` is a coarse form
    of the first key (see :func:`numbered`)."""
    r = numbered(df, F.col(keys[0]) if bucket is None else bucket, keys, "_rn").withColumn("batch_id", F.floor(F.col("_rn") / size))
    order = [u01(shuffle_seed, *[F.col(k) for k in keys]), *keys] if shuffle_seed is not None else keys
    return r.withColumn("place", F.row_number().over(Window.partitionBy("batch_id").orderBy(*order)) - 1).drop("_rn")
