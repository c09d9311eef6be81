"""Texts, code, subword tokenizers, vocabularies, windows."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.functions import code, text, tokenizers
from vectorloom.operators import vocab, windows


def cut(spark, t, **settings):
    df = spark.createDataFrame([(t,)], "text string")
    return df.select(text.TextProcessor(**settings).sentences(F.col("text"))).first()[0]


@pytest.mark.parametrize(
    "t, settings, want",
    [
        ('Hello world! This is my test.', {}, 'hello world | this is my test'),
        ('', {}, ''),
        ('hello', {}, 'hello'),
        ('<p>Good day!</p> Here is <i>some</i> text.', {'lowercase': False, 'remove_punctuation': False, 'remove_html': True}, 'Good day | Here is some text'),
        ('Go to https://site.net/a for help. Try www.there.org too.', {'remove_urls': True}, 'go to for help | try too'),
        ("We can't go. It's late.", {'expand_contractions': True}, 'we cannot go | it is late'),
        ("<p>Go http://site.net! It's one more of 57 lines.</p>", {'remove_html': True, 'remove_urls': True, 'remove_numbers': True, 'expand_contractions': True}, 'go it is one more of lines'),
        ('cafe\u0301', {'remove_punctuation': False}, 'caf\xe9'),
        ('\u732b\u5750\u5728\u57ab\u5b50\u4e0a\u3002\u72d7 a', {}, '\u732b \u5750 \u5728 \u57ab \u5b50 \u4e0a | \u72d7 a'),
        ("pi is 3.14; it's\nnext", {}, 'pi is 3 | 14 its | next'),
        ('one\xa0two\u3000three', {}, 'o n e t w o t h r e e'),
        ('a\xa0b', {}, 'a b'),
        ('see http://x.org\nnow', {'remove_urls': True}, 'see now'),
        ('x <b unclosed. tag', {'remove_html': True}, 'x'),
        ("don't, don't 'll", {'expand_contractions': True}, 'dont do not will'),
        ('!!! ...', {}, ''),
    ],
)
def test_sentences(spark, t, settings, want):
    assert cut(spark, t, **settings) == [s.split() for s in want.split(" | ") if s]


def test_null_text_has_no_sentences(spark):
    df = spark.createDataFrame([(1, None), (2, "a b.")], "doc_id long, text string")
    assert [(r[0], r[1], r[2]) for r in text.sentences(df).collect()] == [(2, 0, ["a", "b"])]


def test_contractions_are_whole_words():
    assert len(text.CONTRACTIONS) == 30 and text.CONTRACTIONS["won't"] == "will not" and text.CONTRACTIONS["'re"] == " are" and len(text.STOP_WORDS) == 46


def test_detect_language(spark):
    df = spark.createDataFrame([("the cat is on the mat",), ("le chat noir dort sur le tapis",), ("",), ("The",), ("x y z the",), ("x y z the w",)], "t string")
    assert [r[0] for r in df.select(text.detect_language(F.col("t"))).collect()] == ["en", "unknown", "unknown", "en", "en", "unknown"]


def code_of(spark, t, **settings):
    return spark.createDataFrame([(t,)], "c string").select(code.CodeProcessor(**settings).sentences(F.col("c"))).first()[0]


def test_code(spark):
    assert code_of(spark, "let x = 5;\nlet y = 10;") == [["let", "x"], ["let", "y"]]
    assert code_of(spark, "HTTPResponse URLLoader getX2 snake_Case aB") == [["http", "response", "url", "loader", "get", "x2", "snake_case", "ab"]]
    assert "computeEmbeddingVector" in code_of(spark, "fn computeEmbeddingVector() {}", split_camel_case=False)[0]
    assert code_of(spark, "let a = 7; // set up\n/* many\nlines */ let b = 9;") == [["let", "a"], ["let", "b"]]
    assert code_of(spark, "x = 5  # initialize\ny = 10", language="python") == [["x"], ["y"]]
    assert code_of(spark, "x # no") == [["x", "no"]]
    assert code_of(spark, 'let msg = "hello \\" world"; let x = 1;') == [["let", "msg", "let", "x"]]
    assert code_of(spark, "a /* never ends", remove_comments=True) == [["a"]]
    assert code_of(spark, "x 12 " + "y" * 65, remove_numbers=False) == [["x", "12"]]


WORDS = ["low"] * 5 + ["lower"] * 2 + ["newest"] * 6 + ["widest"] * 3


def brute_bpe(words, size):
    seqs = [[*w, "</w>"] for w in words]
    vocab = {c for s in seqs for c in s}
    merges = []
    while len(vocab) < size:
        pairs = Counter(p for s in seqs for p in zip(s, s[1:]))
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], p))
        merges.append(best)
        vocab.add("".join(best))
        seqs = [list(tokenizers._merged(tuple(s), *best)) for s in seqs]
    return merges


def test_byte_pairs(spark):
    df = spark.createDataFrame([(w,) for w in WORDS], "word string")
    counts = tokenizers.word_counts(df)
    bpe = tokenizers.Bpe.train(counts, 25)
    assert list(bpe.merges) == brute_bpe(WORDS, 25)
    pairs = {(r["left"], r["right"]): r["n"] for r in tokenizers.pair_counts(counts).collect()}
    assert pairs == Counter(p for w in WORDS for p in zip([*w], [*w[1:], "</w>"]))
    seqs = df.distinct().select("word", bpe.encode(F.col("word")).alias("s")).select("word", tokenizers.Bpe.decode(F.col("s")).alias("back")).collect()
    assert all(r["word"] == r["back"] for r in seqs)
    slow = ["lowest", "newer", "wider", "xyz", "", "low low"]
    for w in slow:
        s = (*w, "</w>")
        for m in bpe.merges:
            s = tokenizers._merged(s, *m)
        assert bpe.encode_py(w) == list(s)


def test_byte_pairs_from_few_runs_at_a_time(spark, monkeypatch):
    import random

    held = []
    merge = tokenizers.Bpe._merge
    monkeypatch.setattr(tokenizers.Bpe, "_merge", staticmethod(lambda words, *more: held.append(len(words)) or merge(words, *more)))
    rnd = random.Random(5)
    for letters, most in (("ab", 30), ("aeinrst\u00e9\U0001f600", 100)):
        words = ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 9))) for _ in range(400)]
        counts = tokenizers.word_counts(spark.createDataFrame([(w,) for w in words], "word string"))
        held.clear()
        bpe = tokenizers.Bpe.train(counts, 40, most)
        assert list(bpe.merges) == brute_bpe(words, 40)
        assert bpe.vocab == {s: k for k, s in enumerate(dict.fromkeys([*sorted({*"".join(words), tokenizers.END}), *map("".join, bpe.merges)]))}
        assert len(held) > 1 and max(held) <= most


def test_word_pieces(spark):
    df = spark.createDataFrame([(w,) for w in WORDS], "word string")
    wp = tokenizers.WordPiece.train(tokenizers.word_counts(df), 40)
    assert len(wp.vocab) == 40 and list(wp.vocab)[:5] == list(tokenizers.SPECIALS)
    assert tokenizers.WordPiece({"un": 0, "able": 1, "a": 2}).word_py("Unable") == ["un", "##able"]
    assert tokenizers.WordPiece({"un": 0}).word_py("unz") == ["un", "[UNK]"]
    t = spark.createDataFrame([("low newest widest",), ("lower",)], "t string")
    back = t.select("t", tokenizers.WordPiece.decode(wp.encode(F.col("t"))).alias("b")).collect()
    assert all(r["t"] == r["b"] for r in back)


def test_char_ngrams(spark):
    got = spark.createDataFrame([("apple",), ("é",)], "w string").select(tokenizers.char_ngrams(F.col("w"), 3, 5)).collect()
    b = "<apple>"
    assert got[0][0] == [b[i : i + n] for n in (3, 4, 5) for i in range(len(b) - n + 1)] and got[1][0] == ["<é>"]


def corpus(spark, sents):
    return spark.createDataFrame([(d, s, w) for d, s, w in sents], "doc_id long, sent_id int, words array<string>")


def test_vocabularies(spark):
    docs = spark.createDataFrame([(5, "zeta beta. beta"), (2, "the cat. the dog"), (9000, "cat omega"), (None, "lost")], "doc_id long, text string")
    got = {r["word"]: (r["word_id"], r["freq"]) for r in vocab.build_vocab(docs).collect()}
    assert got == {"the": (0, 2), "cat": (1, 2), "dog": (2, 1), "zeta": (3, 1), "beta": (4, 2), "omega": (5, 1)}
    again = {r["word"]: (r["word_id"], r["freq"]) for r in vocab.vocab_of_sentences(text.sentences(docs.where("doc_id is not null"))).collect()}
    assert got == again
    assert vocab.total_words(vocab.build_vocab(docs)).first()[0] == 9
    v = vocab.extend_vocab(vocab.build_vocab(docs), spark.createDataFrame([("new",), ("cat",), ("also",), ("new",)], "word string"))
    assert {r["word"]: (r["word_id"], r["freq"]) for r in v.where("word_id > 5").collect()} == {"also": (6, 1), "new": (7, 2)}
    assert vocab.build_vocab(docs.limit(0)).count() == 0


def test_numbered_is_a_global_order(spark):
    rng = np.random.default_rng(1)
    x = rng.permutation(5000).tolist() + [None]
    df = spark.createDataFrame([(v,) for v in x], "x int").repartition(7)
    got = vocab.numbered(df, F.floor(F.col("x") / 100), ["x"]).collect()
    assert all(r["rn"] == (0 if r["x"] is None else r["x"] + 1) for r in got)


def test_splits(spark):
    df = spark.range(10).withColumnRenamed("id", "doc_id")
    a, b = vocab.split(df, ["doc_id"], 0.7)
    assert (a.count(), b.count()) == (7, 3) and a.union(b).distinct().count() == 10
    a, b = vocab.split(df, ["doc_id"], 1.0)
    assert (a.count(), b.count()) == (10, 0)
    f = {r["fold"]: r["n"] for r in vocab.folds(df, ["doc_id"], 3).groupBy("fold").agg(F.count("*").alias("n")).collect()}
    assert f == {0: 3, 1: 3, 2: 4}
    for k in (0, 1, 100):
        with pytest.raises(ValueError):
            vocab.folds(df, ["doc_id"], k)
    g = vocab.batches(df, ["doc_id"], 4, shuffle_seed=3).collect()
    assert Counter(r["batch_id"] for r in g) == {0: 4, 1: 4, 2: 2} and all(r["doc_id"] // 4 == r["batch_id"] for r in g)


def test_windows_against_loops(spark):
    sents = [(0, 0, "the cat sat on the mat".split()), (0, 1, ["hello", "world"]), (1, 0, ["one"]), (2, 0, []), (3, 0, "a b a c".split())]
    df = corpus(spark, sents)
    got = Counter((r["target"], r["context"], r["distance"]) for r in windows.context_pairs(df, 2).collect())
    assert got == Counter((w[i], w[j], j - i) for _, _, w in sents for i in range(len(w)) for j in range(max(0, i - 2), min(len(w), i + 3)) if i != j)
    assert windows.positive_pairs(corpus(spark, [sents[1]])).count() == 1 and windows.negative_pairs(corpus(spark, [sents[1]])).count() == 0
    assert Counter((r["word1"], r["word2"]) for r in windows.negative_pairs(df).collect()) == Counter((w[i], w[i + 2]) for _, _, w in sents for i in range(len(w) - 2))
    assert [tuple(r) for r in windows.analogy_quads(df).collect()] == []
    assert [tuple(r) for r in windows.analogy_quads(corpus(spark, [sents[0], sents[1], sents[2], sents[4]])).collect()] == [(0, "the", "hello", "one", "a")]


def test_drop_and_negative_distributions(spark):
    v = spark.createDataFrame([(0, "a", 90), (1, "b", 9), (2, "c", 1)], "word_id long, word string, freq long")
    p = {r["word"]: r["p"] for r in vocab.negative_distribution(v).collect()}
    s = sum(f**0.75 for f in (90, 9, 1))
    assert p["a"] == pytest.approx(90**0.75 / s) and sum(p.values()) == pytest.approx(1)
    d = {r["word"]: r["p_drop"] for r in vocab.drop_probability(v, 0.05).collect()}
    assert d["a"] == pytest.approx(1 - (0.05 / 0.9) ** 0.5) and d["c"] == 0
    assert {r["p_drop"] for r in vocab.drop_probability(v, None).collect()} == {0.0}


def test_any_text_is_processed(spark):
    rng = np.random.default_rng(11)
    texts = ["".join(chr(int(c)) for c in rng.choice([*range(1, 0x300), 0x301, 0x4E2D, 0x1F600, 0x2028, 0xFF01, 10, 46, 32, 60, 62], 60)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    every = text.TextProcessor(remove_html=True, remove_urls=True, remove_numbers=True, expand_contractions=True)
    for r in text.sentences(df, every).collect():
        assert r["words"] and all(w and not re.search(r"[0-9.!?\s]", w) for w in r["words"])
    code.code_sentences(df, code.CodeProcessor(language="python")).count()


def test_pairs_are_summed_up_document_by_document(spark):
    df = spark.createDataFrame([(1, "the cat sat. one! a b c\nz y"), (2, "alone. single"), (3, None), (1, "b a"), (4, "two words")], "doc_id long, text string")
    s = text.sentences(df)
    pair = F.concat_ws(" ", "word1", "word2")
    both = windows.positive_pairs(s).withColumn("apart", F.lit(1)).union(windows.negative_pairs(s).withColumn("apart", F.lit(2)))
    want = both.groupBy("doc_id", "apart").agg(F.count("*").alias("n"), F.min(pair).alias("least"), F.max(pair).alias("last"))
    got = windows.pair_summaries(df, text.TextProcessor().sentences(F.col("text")))
    assert got.schema == want.schema or got.dtypes == want.dtypes
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_cooccurrence_shuffles_once(spark):
    df = corpus(spark, [(0, 0, "a b a a c".split()), (1, 0, ["one"]), (2, 0, "b a".split())])
    want = Counter((r["target"], r["context"]) for r in windows.context_pairs(df, 2).collect())
    got = windows.cooccurrence(df, 2)
    assert {(r["target"], r["context"]): r["n"] for r in got.collect()} == want
    assert got._jdf.queryExecution().sparkPlan().toString().count("HashAggregate") == 2


def test_contexts_are_counted_without_being_made(spark):
    df = corpus(spark, [(d, i, ["w"] * n) for d, i, n in [(0, 0, 7), (0, 1, 1), (1, 0, 1), (2, 0, 0), (3, 0, 2), (3, 1, 30), (4, 0, 6)]])
    for w in (1, 5):
        want = {(r["doc_id"], r["count"]) for r in windows.context_pairs(df, w).groupBy("doc_id").count().collect()}
        got = windows.context_counts(df, w)
        assert {tuple(r) for r in got.collect()} == want and "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_spearman_reads_its_values_once(spark):
    from vectorloom.operators import evaluation

    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def slow(x):
        seen.add(1)
        return float(x * 7 % 13)

    df = spark.range(40).select(F.col("id").alias("x"), slow.asNondeterministic()("id").alias("y"))
    r = evaluation.spearman(df, "x", "y").first()
    assert r["n"] == 40 and seen.value <= 80  # the filter may ask once more
