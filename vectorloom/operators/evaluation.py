"""Metrics of a model: pair classification, rank correlation, cross-validation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import written
from .search import pair_similarity, quality_score
from .vocab import folds, ranged

METRICS = ("accuracy", "precision", "recall", "f1_score", "mean_similarity", "vector_quality")


def _safe(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def classification(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row of metrics of (similarity, positive): pairs at or above the threshold count as predicted."""
    s, p = F.col("similarity"), F.col("positive")
    hit = s >= threshold

    def n(c: Column) -> Column:
        return F.coalesce(F.sum(c.cast("long")), F.lit(0))

    m = scored.where(s.isNotNull()).agg(n(p & hit).alias("tp"), n(~p & hit).alias("fp"), n(p & ~hit).alias("fn"), n(~p & ~hit).alias("tn"), F.avg(F.when(p, s)).alias("mp"), F.avg(F.when(~p, s)).alias("mn"))
    m = m.withColumns({"precision": _safe(F.col("tp"), F.col("tp") + F.col("fp")), "recall": _safe(F.col("tp"), F.col("tp") + F.col("fn"))})
    return m.select(
        _safe(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("accuracy"),
        "precision",
        "recall",
        _safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1_score"),
        ((F.coalesce("mp", F.lit(0.0)) + F.coalesce("mn", F.lit(0.0))) / 2).alias("mean_similarity"),
    )


def evaluate(vectors: DataFrame, positive: DataFrame, negative: DataFrame, threshold: float = 0.5, word_col: str = "word", vec: str = "vec") -> DataFrame:
    """The six metrics. Pairs (word1, word2) with an unknown word or a zero
    norm are skipped; equal pairs are looked up once and counted as often as they are there."""
    pairs = positive.select("word1", "word2", F.lit(True).alias("positive")).unionByName(negative.select("word1", "word2", F.lit(False).alias("positive")))
    scored = pair_similarity(pairs, vectors, word_col=word_col, vec=vec)
    return classification(scored, threshold).crossJoin(F.broadcast(quality_score(vectors, vec).select(F.col("quality").alias("vector_quality"))))


#: Values closer than this to the first of a run of values share its rank.
TIE = 1e-9


def _ranks_of(values: np.ndarray, counts: np.ndarray, before: int) -> np.ndarray:
    """The mean rank of each of the rising distinct values, `before` rows being lower than all."""
    first = np.concatenate([[True], np.diff(values) >= TIE]) if len(values) else np.zeros(0, bool)
    starts = np.flatnonzero(first)
    for i, j in zip(starts, np.append(starts[1:], len(values))):
        if values[j - 1] - values[i] >= TIE:  # a chain of near values is longer than one run
            for k in range(i + 1, j):
                if values[k] - values[i] >= TIE:
                    first[k], i = True, k
    starts, run = np.flatnonzero(first), np.cumsum(first) - 1
    n = np.add.reduceat(counts, starts) if len(starts) else counts
    return (before + np.cumsum(n) - n + (n + 1) / 2)[run]


def average_rank(df: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """df with 1-based ranks; values within :data:`TIE` of the first of their run
    share their mean rank. Distinct values are counted and ranked range by range; only the ranges' sizes
    are summed in one place. Should a border of two ranges part near values, all are ranked in one task."""
    counts = ranged(df.groupBy(F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__n")), ["__v"])
    sizes = counts.groupBy("__bucket").agg(F.min("__v").alias("low"), F.max("__v").alias("high"), F.sum("__n").alias("n")).orderBy("__bucket").collect()
    if any(b["low"] - a["high"] < TIE for a, b in zip(sizes, sizes[1:])):
        counts = counts.withColumn("__bucket", F.lit(-1))
    before = dict(zip([r["__bucket"] for r in sizes], np.cumsum([0, *[r["n"] for r in sizes]]).tolist()))

    def rank(t: pa.Table) -> pa.Table:
        t = t.sort_by("__v")
        v, n = t.column("__v").to_numpy(), t.column("__n").to_numpy()
        return pa.table({"__v": t.column("__v"), "__rank": _ranks_of(v, n, before.get(t.column("__bucket")[0].as_py(), 0))})

    ranks = counts.groupBy("__bucket").applyInArrow(rank, "__v double, __rank double").select("__v", F.col("__rank").alias(name))
    return df.join(ranks, F.col(value).cast("double") == F.col("__v")).drop("__v")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """(n, correlation): Pearson's correlation of the ranks; 0 for fewer than two rows or no variance."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    both = written(both, "values")  # read five times by what follows, made once
    r = average_rank(average_rank(both, "x", "rx"), "y", "ry")
    c = F.try_divide(F.covar_pop("rx", "ry"), F.stddev_pop("rx") * F.stddev_pop("ry"))
    return r.agg(F.count("*").alias("n"), F.coalesce(c, F.lit(0.0)).alias("correlation"))


def benchmark(pairs: DataFrame, vectors: DataFrame, word_col: str = "word", vec: str = "vec") -> DataFrame:
    """(num_pairs, num_evaluated, correlation) of (word1, word2, score) rows against cosine similarity."""
    scored = pair_similarity(pairs, vectors, word_col=word_col, vec=vec)
    total = pairs.agg(F.count("*").alias("num_pairs"))
    return spearman(scored, "similarity", "score").crossJoin(F.broadcast(total)).select("num_pairs", F.col("n").alias("num_evaluated"), "correlation")


def validation_data(sentences: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Positive pairs, negative pairs and analogies read off sentences."""
    from .windows import analogy_quads, negative_pairs, positive_pairs

    return positive_pairs(sentences, key), negative_pairs(sentences, key), analogy_quads(sentences, key)


def cross_validate(sentences: DataFrame, config, k: int, key: str = "doc_id") -> DataFrame:
    """(fold, metrics) for each fold, and fold -1 with their means. Each fold
    gets a model of its own, trained on the others' sentences."""
    from ..plans.training import train

    spark: SparkSession = sentences.sparkSession
    f = written(folds(sentences, [key, "sent_id"], k, config.seed), "folds")
    rows = []
    for i in range(k):
        model = train(f.where(F.col("fold") != i).drop("fold"), config, key)
        pos, neg, _ = validation_data(f.where(F.col("fold") == i).drop("fold"), key)
        rows.append((i, *[float(v) for v in evaluate(model.vectors, pos, neg).first()]))
    rows.append((-1, *[sum(r[j] for r in rows) / k for j in range(1, 7)]))
    return spark.createDataFrame(rows, "fold int, " + ", ".join(f"{m} double" for m in METRICS))
