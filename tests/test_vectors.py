"""Vector functions, search, hashed and graph indexes, clustering, metrics, quantizing, transfer."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vectorloom import queries
from vectorloom.functions import vector
from vectorloom.operators import ann, clustering, evaluation, quantize, search, transfer, transformer


@pytest.fixture(scope="module")
def words(spark):
    rows = [(0, "king", [1.0, 0.0]), (1, "queen", [0.9, 0.1]), (2, "man", [0.1, 1.0]), (3, "woman", [0.2, 0.9]), (4, "zero", [0.0, 0.0])]
    return spark.createDataFrame(rows, "word_id long, word string, vec array<float>")


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 12)) + 4 * np.eye(12)[rng.integers(0, 5, 400)]
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "word_id long, vec array<double>")


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def arr(*x):
    return F.array(*[F.lit(float(v)) for v in x])


def test_scalar_functions(spark):
    a, b, z = arr(1, 2, 3), arr(4, 5, 6), arr(0, 0, 0)
    assert one(spark, vector.dot(a, b), vector.add_scaled(a, b, 2.0), vector.subtract(b, a)) == (32.0, [9.0, 12.0, 15.0], [3.0, 3.0, 3.0])
    assert one(spark, vector.cosine(a, z), vector.cosine_or_zero(a, z), vector.cosine_distance(a, z), vector.cosine_or_zero(a, arr(1))) == (None, 0.0, 1.0, 0.0)
    assert one(spark, vector.interpolate(a, b, 0.25), vector.normalized(z), vector.concatenate(a, b)) == ([3.25, 4.25, 5.25], [0.0] * 3, [float(x) for x in range(1, 7)])
    assert one(spark, vector.weighted_average(a, b, 0.5), vector.weighted_average(a, arr(1), 0.5)) == ([2.5, 3.5, 4.5], None)
    c = 32 / math.sqrt(14 * 77)
    w = 0.5 + 0.5 * math.tanh(c)
    got = one(spark, vector.attention_fusion(a, b), vector.attention_fusion(a, z), vector.attention_fusion(a, arr(1)))
    assert got[0] == pytest.approx([x * w + y * (1 - w) for x, y in zip((1, 2, 3), (4, 5, 6))]) and got[1:] == ([1.0, 2.0, 3.0], None)
    p, q = np.arange(6).reshape(3, 2), np.ones((3, 2))
    assert one(spark, vector.project_and_fuse(a, b, p, q))[0] == pytest.approx((np.array([1, 2, 3]) @ p + np.array([4, 5, 6]) @ q) / 2)
    assert one(spark, vector.project_and_fuse(a, b, p, np.ones((3, 4)))) == (None,)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(-100, 100, width=32), min_size=3, max_size=3), st.lists(st.floats(-100, 100, width=32), min_size=3, max_size=3))
def test_cosine_and_unit_length(spark, a, b):
    c, n = one(spark, vector.cosine(arr(*a), arr(*b)), vector.norm(vector.normalized(arr(*a))))
    assert c is None or -1.000001 <= c <= 1.000001
    assert n == pytest.approx(1, abs=1e-6) or not any(abs(x) > 1e-150 for x in a)


@pytest.mark.parametrize("dim", [None, 3])
def test_sums_and_means(spark, dim):
    df = spark.createDataFrame([("a", 1, [1.0, 2.0, 3.0]), ("a", 1, [3.0, 2.0, 1.0]), ("b", 2, [5.0, 5.0, 5.0]), ("b", 2, None)], "k string, j int, v array<double>")
    got = {(r["k"], r["j"]): r["m"] for r in vector.mean_vectors(df, ["k", "j"], "v", dim, "m").collect()}
    assert got == {("a", 1): [2.0, 2.0, 2.0], ("b", 2): [5.0, 5.0, 5.0]}


def found(df):
    return [(r[0], round(r[1], 6)) for r in df.collect()]


def test_search(words):
    assert found(search.most_similar(words, "king", 2))[0][0] == "queen"
    assert [w for w, _ in found(search.semantic_search(words, "king", 10))] == ["queen", "woman", "man"]
    assert found(search.most_similar(words, "king", 9))[-1] == ("zero", 0.0)
    assert found(search.semantic_search(words, "nobody", 3)) == []
    t = np.array([0.1, 1.0]) + [1, 0] - np.array([0.9, 0.1])
    cos = lambda v: float(np.dot(t, v) / np.linalg.norm(t) / np.linalg.norm(v))
    assert found(search.analogy(words, "king", "queen", "man", 5)) == [("woman", pytest.approx(cos([0.2, 0.9]), abs=1e-5))]
    assert found(search.analogy(words, "king", "nobody", "man", 5)) == []
    assert [r["term"] for r in search.expand_query(words, "king", 2).orderBy("rank").collect()] == ["king", "queen", "woman"]
    assert [r["term"] for r in search.expand_query(words, "nobody", 2).collect()] == ["nobody"]
    assert search.similarity(words, "king", "zero").first()[0] is None and search.similarity(words, "king", "nobody").first()[0] is None
    assert search.similarity(words, "king", "king").first()[0] == pytest.approx(1)


def test_zero_shot(spark):
    p = spark.createDataFrame([("class_b", [0.0, 1.0, 0.0]), ("class_a", [1.0, 0.0, 0.0]), ("void", [0.0, 0.0, 0.0])], "label string, proto array<double>")
    q = spark.createDataFrame([(1, [0.9, 0.1, 0.0]), (2, [1.0, 1.0, 0.0]), (3, [0.0, 0.0, 0.0])], "id int, vec array<double>")
    got = {r["id"]: (r["predicted"], r["similarity"]) for r in search.classify(q, p).collect()}
    assert got[1][0] == "class_a" and got[1][1] > 0.9 and got[2][0] == "class_a" and got[3] == (None, None)


def exact(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    return {(i, int(j)) for i in range(len(x)) for j in np.lexsort((np.arange(len(x)), -s[i]))[:k]}


@pytest.mark.parametrize("block", [4096, 60])
def test_all_pairs(cloud, block):
    x, df = cloud
    got = search.knn(df, 5, block=block).collect()
    assert {(r["word_id"], r["neighbor"]) for r in got} == exact(x, 5) and {r["rank"] for r in got} == {1, 2, 3, 4, 5}


def test_hyperplanes(cloud):
    x, df = cloud
    index = ann.LshIndex(12, 6, planes=8)
    got = {(r["table_id"], r["word_id"]): r["bucket"] for r in index.buckets(df).collect()}
    for t in range(6):
        for i in range(0, 400, 37):
            assert got[t, i] == sum(1 << p for p in range(8) if index.matrix[t][p] @ x[i] > 0)
    near = index.query(df, df, 5).collect()
    mates = {(a, b) for a in range(400) for b in range(400) if a != b and any(got[t, a] == got[t, b] for t in range(6))}
    assert {(r["query"], r["neighbor"]) for r in near} <= mates
    assert len({(r["query"], r["neighbor"]) for r in near if r["rank"] <= 5} & exact(x, 5)) > 0.7 * 2000
    assert index.query(df, df.limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
@pytest.mark.parametrize("name", ["lsh_topk", "hnsw_topk"])
def test_registered_searches_find_the_nearest(spark, name, sf):
    folder = f"/root/testdata/{sf}"
    rows = queries.emb(spark, folder).orderBy("vec_id").collect()
    ids = [r["vec_id"] for r in rows]
    want = {(ids[a], ids[b]) for a, b in exact(np.array([r["vec"] for r in rows], float), 10) if ids[a] % 50 == 0}
    got = {(r["query"], r["neighbor"]) for r in queries.QUERIES[name](spark, folder).collect()}
    assert got and len(got & want) >= 0.9 * len(want)


@pytest.mark.parametrize("shards", [1, 4])
def test_graph_recall(cloud, shards):
    x, df = cloud
    got = ann.hnsw_search(df, df, 10, shards).collect()
    pairs = {(r["query"], r["neighbor"]) for r in got}
    assert len(pairs) == 4000 and len(pairs & exact(x, 10)) >= 0.9 * 4000
    assert ann.Hnsw(np.zeros((0, 3))).query(np.ones(3), 5) == [] and len(ann.Hnsw(np.zeros((3, 3)))) == 3


def test_kmeans(cloud):
    x, df = cloud
    got = {r["word_id"]: r["cluster"] for r in clustering.kmeans(df, 5, 3, seed=None).collect()}
    c, at = x[:5].copy(), np.zeros(400, int)
    for _ in range(3):
        new = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        if (new == at).all():
            break
        at = new
        c = np.stack([x[at == k].mean(axis=0) if (at == k).any() else c[k] for k in range(5)])
    assert [got[i] for i in range(400)] == at.tolist()
    assert {r["cluster"] for r in clustering.kmeans(df.limit(8), 100).collect()} == set(range(8))
    assert {r["cluster"] for r in clustering.kmeans(df.limit(8), 1).collect()} == {0}
    assert clustering.kmeans(df.limit(0), 3).count() == 0


def test_average_linkage(spark, cloud):
    x, df = cloud
    x, few = x[:40], df.where("word_id < 40")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    groups = [[i] for i in range(40)]
    while len(groups) > 6:
        best = max(((np.mean([u[a] @ u[b] for a in p for b in q]), -i, -j) for i, p in enumerate(groups) for j, q in enumerate(groups) if i < j))
        i, j = -best[1], -best[2]
        groups[i] += groups.pop(j)
    got: dict = {}
    for r in clustering.hierarchical(few, 6).collect():
        got.setdefault(r["cluster"], set()).add(r["word_id"])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups))
    with pytest.raises(ValueError):
        clustering.hierarchical(df, 3, most=10)
    assert clustering.hierarchical(df.limit(0), 3).count() == 0


def test_alignment(spark):
    pairs = spark.createDataFrame([([1.0] + [0.0] * 3, [2.0] + [0.0] * 3)], "src array<double>, tgt array<double>")
    assert one(spark, clustering.Aligner(4).align(arr(1, 2, 3, 4))) == ([1.0, 2.0, 3.0, 4.0],)
    w = clustering.Aligner(4).fit_sgd(pairs, 100, 0.1)
    assert one(spark, w.align(arr(1, 0, 0, 0)))[0][0] == pytest.approx(2, abs=0.1)
    rng = np.random.default_rng(3)
    m, s = rng.normal(size=(4, 4)), rng.normal(size=(50, 4))
    df = spark.createDataFrame([(a.tolist(), (m @ a).tolist()) for a in s], "src array<double>, tgt array<double>")
    assert np.allclose(clustering.Aligner(4).fit(df).w, m, atol=1e-5)


def test_metrics(spark, words):
    pairs = lambda *p: spark.createDataFrame(list(p), "word1 string, word2 string")
    got = evaluation.evaluate(words, pairs(("king", "queen"), ("king", "man"), ("king", "nobody"), ("king", "zero")), pairs(("man", "woman"), ("king", "woman"))).first().asDict()
    cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    s = [cos([1, 0], [0.9, 0.1]), cos([1, 0], [0.1, 1]), cos([0.1, 1], [0.2, 0.9]), cos([1, 0], [0.2, 0.9])]
    assert got["accuracy"] == 0.5 and got["precision"] == 0.5 and got["recall"] == 0.5 and got["f1_score"] == 0.5
    assert got["mean_similarity"] == pytest.approx(((s[0] + s[1]) / 2 + (s[2] + s[3]) / 2) / 2, abs=1e-6)
    none = evaluation.evaluate(words, pairs(("x", "y")).limit(0), pairs(("x", "y")).limit(0)).first()
    assert list(none)[:5] == [0.0] * 5 and 0 < none["vector_quality"] <= 1


def test_rank_correlation(spark):
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 12, 80), rng.integers(0, 7, 80)
    rank = lambda v: [(sum(w < a for w in v) + (sum(w == a for w in v) + 1) / 2) for a in v]
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(x, y)], "x int, y int")
    got = evaluation.spearman(df, "x", "y").first()
    assert got["n"] == 80 and got["correlation"] == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1])
    assert evaluation.spearman(df.limit(1), "x", "y").first()["correlation"] == 0
    flat = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "x int, y int")
    assert evaluation.spearman(flat, "x", "y").first()["correlation"] == 0


def test_word_pair_benchmark(spark, words):
    pairs = spark.createDataFrame([("king", "queen", 9.0), ("king", "man", 2.0), ("king", "woman", 3.0), ("king", "nobody", 1.0)], "word1 string, word2 string, score float")
    assert tuple(evaluation.benchmark(pairs, words).first()) == (4, 3, pytest.approx(1.0))


def test_quantizing(spark, cloud):
    x, df = cloud
    q = quantize.quantize(df)
    for r, v in zip(q.orderBy("word_id").limit(20).collect(), x):
        s = np.abs(v).max() / 127
        assert r["scale"] == pytest.approx(s, rel=1e-6) and r["q"] == [int(math.copysign(math.floor(abs(c) / s + 0.5), c)) for c in v]
    back = quantize.dequantize(q).orderBy("word_id").collect()
    assert max(abs(a - b) for r, v in zip(back, x) for a, b in zip(r["vec"], v)) < 0.05
    assert quantize.reconstruction_error(df).first()[0] < 0.05 and quantize.reconstruction_error(df, "fp16").first()[0] < 1e-3
    half = quantize.dequantize(quantize.quantize(df, "fp16")).orderBy("word_id").collect()
    assert all(np.array_equal(np.float16(v).astype(float), r["vec"]) for r, v in zip(half, x))
    zero = spark.createDataFrame([("z", [0.0, 0.0]), ("a", [1.0, 2.0])], "word string, vec array<double>")
    assert quantize.quantize(zero).where("word = 'z'").first()["scale"] == 1.0
    assert quantize.quantized_similarity(quantize.quantize(zero), "z", "a").first()[0] == 0.0
    assert quantize.quantized_similarity(quantize.quantize(zero), "a", "a").first()[0] == pytest.approx(1)
    assert quantize.quantized_similarity(quantize.quantize(zero), "a", "b").count() == 0
    assert (quantize.compression_ratio("int8"), quantize.compression_ratio("fp16")) == (4.0, 2.0)
    with pytest.raises(ValueError):
        quantize.quantize(df, "int3")


def test_vectors_of_sentences_documents_and_parts(spark, words):
    s = spark.createDataFrame([(1, 0, ["king", "king", "queen", "x"]), (1, 1, ["man"]), (2, 0, ["x"])], "doc_id long, sent_id int, words array<string>")
    got = {(r["doc_id"], r["sent_id"]): r["vec"] for r in transfer.sentence_vectors(s, words, dim=2).collect()}
    assert got[1, 0] == pytest.approx([2.9 / 3, 0.1 / 3], abs=1e-6) and set(got) == {(1, 0), (1, 1)}
    d = transfer.document_vectors(s, words).collect()
    assert len(d) == 1 and d[0]["vec"] == pytest.approx([(2.9 / 3 + 0.1) / 2, (0.1 / 3 + 1) / 2], abs=1e-6)
    g = spark.createDataFrame([("<ab", [1.0]), ("ab>", [3.0]), ("aaa", [5.0])], "gram string, vec array<double>")
    w = spark.createDataFrame([("ab",), ("aaaa",), ("zz",)], "word string")
    assert {r["word"]: r["vec"] for r in transfer.subword_vectors(w, g, 3, 3).collect()} == {"ab": [2.0], "aaaa": [5.0]}


def test_transformer(spark):
    pe = transformer.position_encoding(5, 6)
    assert pe[0].tolist() == [0, 1] * 3 and pe[3, 2] == pytest.approx(math.sin(3 / 10000 ** (2 / 6))) and pe[3, 3] == pytest.approx(math.cos(3 / 10000 ** (2 / 6)))
    enc = transformer.Encoder(2, 2, 6, 8)
    rng = np.random.default_rng(1)
    x = {k: rng.normal(size=(3 + k, 6)) for k in (1, 2)}
    df = spark.createDataFrame([(k, i, v.tolist()) for k, m in x.items() for i, v in enumerate(m)], "k int, i int, vec array<double>")
    got = {(r["k"], r["i"]): r["vec"] for r in transformer.encode_sequences(df, enc, "k", "i").collect()}
    for k, m in x.items():
        out = enc.encode(m)
        assert np.allclose([got[k, i] for i in range(len(m))], out) and np.allclose(out.mean(axis=1), 0) and np.allclose(out.std(axis=1), 1, atol=1e-3)
    with pytest.raises(ValueError):
        transformer.Encoder(1, 4, 6, 8)


def test_long_sequences_are_encoded_in_tiles(spark):
    import tracemalloc

    enc = transformer.Encoder(2, 2, 6, 8)
    x = np.random.default_rng(2).normal(size=(2500, 6))
    tracemalloc.start()
    out = enc.encode(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6  # the scores of one head alone take 50 MB
    h = x + transformer.position_encoding(2500, 6)
    p = enc.layers[0]
    q = (h @ p["qkv"]).reshape(2500, 2, 3)
    s = np.einsum("ihd,jhd->hij", q, q) / np.sqrt(3)
    w = np.exp(s - s.max(axis=2, keepdims=True))
    whole = np.einsum("hij,jhd->ihd", w / w.sum(axis=2, keepdims=True), q).reshape(2500, 6) @ p["out"]
    assert np.allclose(enc.attention(h, p), whole, atol=1e-12)
    df = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(x)] + [(2, 7, [1.0] * 6)], "k int, i int, vec array<double>").repartition(3)
    got = {(r["k"], r["i"]): r["vec"] for r in transformer.encode_sequences(df, enc, "k", "i", block=100).collect()}
    assert len(got) == 2501 and np.allclose([got[1, i] for i in range(2500)], out, atol=1e-12) and np.allclose(got[2, 7], enc.encode(np.ones((1, 6))))


def test_checked_graph_search_is_exact(cloud):
    x, df = cloud
    loose = {(r["query"], r["neighbor"]) for r in ann.hnsw_search(df, df, 10, 1, m=2, ef_construction=2, ef_search=2).collect()}
    got = ann.hnsw_search(df, df, 10, 2, m=2, ef_construction=2, ef_search=2, checked=True).collect()
    assert loose != exact(x, 10) and {(r["query"], r["neighbor"]) for r in got} == exact(x, 10) and len(got) == 4000


def test_hashed_search_by_blocks_gives_the_joined_pairs(spark, cloud, monkeypatch):
    x, df = cloud
    df = df.select("word_id", "vec").union(spark.createDataFrame([(900, [0.0] * x.shape[1]), (901, x[3].tolist()), (902, None)], "word_id long, vec array<double>"))
    monkeypatch.setattr(ann, "BLOCK", 90)
    index = ann.LshIndex(x.shape[1], 5, 3)
    bucket = {(r["table_id"], r["word_id"]): r["bucket"] for r in index.buckets(df).collect()}
    v = {r["word_id"]: np.array(r["vec"]) for r in df.collect() if r["vec"] and any(r["vec"])}
    cos = lambda a, b: float(v[a] @ v[b] / np.linalg.norm(v[a]) / np.linalg.norm(v[b]))
    want = []
    for q in (0, 3, 7, 901):
        near = sorted((-round(cos(q, o), 9), o) for o in v if o != q and any(bucket[t, q] == bucket[t, o] for t in range(5)))[:6]
        want += [(q, o, rank) for rank, (_, o) in enumerate(near, 1)]
    found = index.query(df, df.where("word_id in (0, 3, 7, 900, 901)"), 6)
    assert sorted((r["query"], r["neighbor"], r["rank"]) for r in found.collect()) == sorted(want)
    assert "Cartesian" in found._jdf.queryExecution().toString()


def test_average_linkage_keeps_no_matrix():
    import tracemalloc

    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(9000, 8)), np.zeros((2, 8))])
    tracemalloc.start()
    owner = clustering.linked(x, 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6 and len(set(owner.tolist())) == 10  # the matrix alone takes 648 MB
