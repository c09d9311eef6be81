"""Exact similarity search over tables of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import cosine, cosine_or_zero, doubles, matrix_of, norm

#: Vectors in a block of the all-pairs search.
BLOCK = 4096


def lookup(vectors: DataFrame, word, word_col: str = "word") -> DataFrame:
    """The row of a word, none if it is unknown. The filter reaches the scan."""
    return vectors.where(F.col(word_col) == word)


def similarity(vectors: DataFrame, a, b, word_col: str = "word", vec: str = "vec") -> DataFrame:
    """(similarity): one row; null for an unknown word or a zero norm."""
    one = vectors.where(F.col(word_col).isin(a, b)).agg(F.max(F.when(F.col(word_col) == a, F.col(vec))).alias("a"), F.max(F.when(F.col(word_col) == b, F.col(vec))).alias("b"))
    return one.select(cosine("a", "b").alias("similarity"))


def pair_similarity(pairs: DataFrame, vectors: DataFrame, a: str = "word1", b: str = "word2", word_col: str = "word", vec: str = "vec") -> DataFrame:
    """pairs with `similarity`, for pairs whose words both have a vector of some length."""
    v = vectors.select(F.col(word_col), F.col(vec).alias("_v"), norm(vec).alias("_n"))
    x, y = (v.select(F.col(word_col).alias(k), F.col("_v").alias(f"_v{i}"), F.col("_n").alias(f"_n{i}")) for i, k in enumerate((a, b)))
    both = pairs.join(x, a).join(y, b)
    return both.withColumn("similarity", cosine("_v0", "_v1", F.col("_n0"), F.col("_n1"))).where("similarity is not null").drop("_v0", "_v1", "_n0", "_n1")


def top_k(vectors: DataFrame, query: DataFrame, k: int, exclude: list | None = None, word_col: str = "word", vec: str = "vec", order: str | None = None, zero_norms: bool = False) -> DataFrame:
    """(word_col, similarity): the k rows nearest to the one row of query
    (`query`), by cosine; ties by `order` (default: the word). Rows of zero norm are left out, or have similarity 0.

    The query is one row, whatever the table's size, so it may be broadcast."""
    rows = vectors if not exclude else vectors.where(~F.col(word_col).isin(*exclude))
    sim = cosine_or_zero(vec, "_q") if zero_norms else cosine(vec, "_q", norm_b=F.col("_qn"))
    order = order or word_col
    q = query.select(doubles("query").alias("_q"), norm("query").alias("_qn")).limit(1)
    found = rows.crossJoin(F.broadcast(q)).select(word_col, *({order} - {word_col}), sim.alias("similarity"))
    return found.where("similarity is not null").orderBy(F.desc("similarity"), order).limit(k).select(word_col, "similarity")


def semantic_search(vectors: DataFrame, word, k: int = 10, word_col: str = "word", vec: str = "vec", order: str = "word_id") -> DataFrame:
    """The k nearest other words; none for an unknown word."""
    return top_k(vectors, lookup(vectors, word, word_col).select(F.col(vec).alias("query")), k, [word], word_col, vec, order)


def most_similar(vectors: DataFrame, word, k: int = 10, word_col: str = "word", vec: str = "vec") -> DataFrame:
    """As semantic_search, but rows of zero norm stay with similarity 0."""
    return top_k(vectors, lookup(vectors, word, word_col).select(F.col(vec).alias("query")), k, [word], word_col, vec, zero_norms=True)


def _target(vectors: DataFrame, weights: dict, word_col: str, vec: str) -> DataFrame:
    """One row: the weighted sum of the words' vectors; no row if one is unknown."""
    w = F.create_map(*[F.lit(x) for item in weights.items() for x in item])
    some = vectors.where(F.col(word_col).isin(*weights)).select(F.col(word_col).alias("w"), F.posexplode(F.transform(doubles(vec), lambda x: x * w[F.col(word_col)])).alias("i", "x"))
    sums = some.groupBy("i").agg(F.sum("x").alias("x"), F.countDistinct("w").alias("n")).where(F.col("n") == len(weights))
    one = sums.agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    return one.where(F.size("v") > 0).select(F.transform("v", lambda s: s["x"]).alias("query"))


def analogy(vectors: DataFrame, a, b, c, k: int = 10, word_col: str = "word", vec: str = "vec", order: str = "word_id") -> DataFrame:
    """The k words nearest to c + a - b, without those three."""
    weights: dict = {}
    for word, sign in ((a, 1.0), (b, -1.0), (c, 1.0)):
        weights[word] = weights.get(word, 0.0) + sign
    return top_k(vectors, _target(vectors, weights, word_col, vec), k, [a, b, c], word_col, vec, order)


def expand_query(vectors: DataFrame, word, k: int = 5, word_col: str = "word", vec: str = "vec", order: str = "word_id") -> DataFrame:
    """(rank, term): the word itself, known or not, and its k nearest."""
    near = semantic_search(vectors, word, k, word_col, vec, order)
    ranked = near.select(F.row_number().over(Window.orderBy(F.desc("similarity"), word_col)).alias("rank"), F.col(word_col).cast("string").alias("term"))
    return vectors.sparkSession.createDataFrame([(0, str(word))], "rank int, term string").union(ranked)


def classify(items: DataFrame, prototypes: DataFrame, vec: str = "vec", label: str = "label", proto: str = "proto") -> DataFrame:
    """items with the `predicted` label of the nearest prototype and its
    `similarity`; ties go to the least label, zero norms match nothing. Prototypes are few: one a class."""
    p = prototypes.select(F.col(label).alias("_label"), doubles(proto).alias("_p"), norm(proto).alias("_pn")).where("_pn > 0")
    all_p = F.broadcast(p.agg(F.array_sort(F.collect_list(F.struct("_label", "_p", "_pn"))).alias("_all")))
    withn = items.withColumn("_n", norm(vec)).crossJoin(all_p)
    scored = F.transform("_all", lambda q: F.struct(cosine(vec, q["_p"], F.col("_n"), q["_pn"]).alias("s"), q["_label"].alias("l")))
    best = F.aggregate(
        F.filter(scored, lambda s: s["s"].isNotNull()),
        F.lit(None).cast(f"struct<s:double,l:{prototypes.schema[label].dataType.simpleString()}>"),
        lambda a, b: F.when(a.isNull() | (b["s"] > a["s"]), b).otherwise(a),
    )
    return withn.withColumn("_best", best).withColumns({"predicted": F.col("_best.l"), "similarity": F.col("_best.s")}).drop("_best", "_all", "_n")


def knn(vectors: DataFrame, k: int = 10, id_col: str = "word_id", vec: str = "vec", block: int = BLOCK, queries: DataFrame | None = None) -> DataFrame:
    """(id_col, neighbor, similarity, rank): the k nearest others of every
    vector, or of every row of queries, by cosine, exactly; ties by id. Zero norms take no part.

    Vectors are packed into blocks of rows and every two blocks meet in one
    matrix product, so no task holds more than two blocks at a time; only k rows a
    query and block are shuffled. The work is quadratic; see the hashed index for less."""

    def packed(t: DataFrame) -> tuple[DataFrame, int]:
        n = max(1, -(-t.count() // block))
        rows = t.where(F.col(vec).isNotNull()).select(F.col(id_col).cast("long").alias("id"), doubles(vec).alias("v"), F.pmod(F.xxhash64(id_col), F.lit(n)).alias("b"))
        return rows.groupBy("b").agg(F.collect_list(F.struct("id", "v")).alias("rows")).select("rows.id", F.flatten("rows.v").alias("v")), n

    data, n = packed(vectors)
    asked, m = packed(queries) if queries is not None else (data, n)
    left, right = asked.toDF("qi", "qv"), data.toDF("di", "dv")

    def unit(ids, flat):
        x = np.asarray(flat, float).reshape(len(ids), -1)
        size = np.sqrt((x * x).sum(axis=1))
        ok = size > 0
        return np.asarray(ids)[ok], x[ok] / size[ok, None]

    def meet(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                qi, q = unit(*(batch.column(c)[r].values.to_numpy(zero_copy_only=False) for c in (0, 1)))
                di, d = unit(*(batch.column(c)[r].values.to_numpy(zero_copy_only=False) for c in (2, 3)))
                for at in range(0, len(qi), 512):
                    s = q[at : at + 512] @ d.T
                    s[qi[at : at + 512, None] == di[None]] = -np.inf
                    least = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)
                    i, j = np.nonzero((s >= least[:, None] - 1e-12) & (s > -np.inf))
                    yield pa.RecordBatch.from_arrays([pa.array(qi[at + i]), pa.array(di[j]), pa.array(s[i, j])], ["q", "d", "s"])

    # every two partitions are one task; the product itself is never shuffled
    both = left.repartition(min(m, 64)).crossJoin(right.repartition(min(n, 64)))
    met = both.mapInArrow(meet, "q long, d long, s double")
    w = Window.partitionBy("q").orderBy(F.desc("s"), "d")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("q").alias(id_col), F.col("d").alias("neighbor"), F.col("s").alias("similarity"), "rank")


def quality_score(vectors: DataFrame, vec: str = "vec") -> DataFrame:
    """(quality): the root of mean norm times mean variance, 1 at most."""
    from ..functions.vector import variance

    q = F.sqrt(F.avg(norm(vec)) * F.avg(variance(vec)))
    return vectors.agg(F.coalesce(F.least(F.lit(1.0), q), F.lit(0.0)).alias("quality"))


def vector_column(vectors: DataFrame, vec: str = "vec") -> Column:
    return doubles(vectors[vec])
