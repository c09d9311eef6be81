"""Vectors of sentences, documents and of words made of parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokenizers import char_ngrams
from ..functions.vector import mean_vectors

#: Vectors (rows) up to which the words of all sentences are joined where they are read.
BROADCAST_ROWS = 200_000


def sentence_vectors(sentences: DataFrame, vectors: DataFrame, key: str = "doc_id", dim: int | None = None) -> DataFrame:
    """(key, sent_id, vec): the mean vector of a sentence's known words, each
    as often as it occurs; a sentence without any has no row."""
    v = vectors.select("word", F.col("vec").alias("_v"))
    # beyond that size AQE splits the rows of frequent words
    v = F.broadcast(v) if vectors.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else v
    t = sentences.select(key, "sent_id", F.explode("words").alias("word")).join(v, "word")
    return mean_vectors(t, [key, "sent_id"], "_v", dim)


def document_vectors(sentences: DataFrame, vectors: DataFrame, key: str = "doc_id", dim: int | None = None) -> DataFrame:
    """(key, vec): the mean of the sentences' means."""
    return mean_vectors(sentence_vectors(sentences, vectors, key, dim), [key], "vec", dim)


def subword_vectors(words: DataFrame, grams: DataFrame, shortest: int = 3, longest: int = 6, word: str = "word", dim: int | None = None) -> DataFrame:
    """(word, vec): the mean of the known n-gram vectors (gram, vec) of each
    distinct word, repeats counted; a word without any has no row."""
    g = words.select(F.col(word).alias("word")).distinct().select("word", F.explode(char_ngrams(F.col("word"), shortest, longest)).alias("gram"))
    return mean_vectors(g.join(grams.select("gram", F.col("vec").alias("_v")), "gram"), ["word"], "_v", dim)
