"""Training against loops written out, and everything around it."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.functions import text
from vectorloom.functions.rng import u01, u01_py
from vectorloom.operators import evaluation
from vectorloom.operators.vocab import vocab_of_sentences
from vectorloom.plans import training
from vectorloom.plans.config import EarlyStopping, History, Schedule, Stopper, TrainingConfig
from vectorloom.sources import models
from vectorloom.streaming import incremental

BASE = "the cat slept by the mat. the dog slept by the log. the cat fled the dog."
CONFIG = TrainingConfig(dim=8, learning_rate=0.1, epochs=2, batch_size=4, context_window=1, negative_samples=2)


@pytest.fixture(scope="module")
def sents(spark):
    return text.sentences(spark.createDataFrame([(0, BASE), (1, "foxes jump. machines learn some vectors of words.")], "doc_id long, text string")).cache()


@pytest.fixture(scope="module")
def vocab(sents):
    return vocab_of_sentences(sents).cache()


def matrix(df):
    return np.array([r["vec"] for r in df.orderBy("word_id").collect()], float)


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def looped_step(e, words, sizes, rows, sampler, c, epoch, rate):
    """One full-batch step, pair by pair and component by component, with the draws the engine makes."""
    targets, of, context, negatives = training.examples(words, sizes, rows, sampler, c, epoch)
    g, loss, n = {}, 0.0, 0
    clip = lambda x: max(-c.gradient_clip, min(c.gradient_clip, x)) if c.gradient_clip else x
    l2 = c.l2_regularization or 0.0

    def add(word, values):
        g.setdefault(word, [0.0] * e.shape[1])
        for i, x in enumerate(values):
            g[word][i] += clip(x)

    for i, t in enumerate(targets):
        ctx = [int(w) for w, o in zip(context, of) if o == i]
        neg = [int(w) for w in negatives[i] if w >= 0]
        if c.model_type == "skipgram":
            for w in ctx:
                n += 1
                for o, label in [(w, 1)] + [(k, 0) for k in neg]:
                    p = sigmoid(float(e[t] @ e[o]))
                    loss -= math.log(p if label else 1 - p)
                    add(int(t), [rate * (p - label) * b - l2 * a for a, b in zip(e[t], e[o])])
                    add(o, [rate * (p - label) * a - l2 * b for a, b in zip(e[t], e[o])])
        elif ctx:
            n += 1
            h = np.mean([e[w] for w in ctx], axis=0)
            for o, label in [(int(t), 1)] + [(k, 0) for k in neg]:
                p = sigmoid(float(h @ e[o]))
                loss -= math.log(p if label else 1 - p)
                for w in ctx:
                    add(w, [rate * (p - label) * b - l2 * a for a, b in zip(e[w], e[o])])
                add(o, [rate * (p - label) * a - l2 * b for a, b in zip(h, e[o])])
    out = e.astype(float).copy()
    for w, values in g.items():
        out[w] -= [clip(x / n) for x in values]
    return out, loss, n


@pytest.mark.parametrize("kind", ["skipgram", "cbow"])
@pytest.mark.parametrize("extra", [{}, {"gradient_clip": 0.004, "l2_regularization": 0.01}, {"subsample_threshold": 0.05, "use_unigram_negative_sampling": False, "context_window": 3}])
def test_a_step_against_loops(spark, sents, vocab, kind, extra):
    c = TrainingConfig(**{**CONFIG.__dict__, "model_type": kind, **extra})
    e = (matrix(training.init_vectors(vocab, 8)) * 3).astype(np.float32)
    freq = np.array([r["freq"] for r in vocab.orderBy("word_id").collect()])
    sampler = training.Sampler.of(freq, c.use_unigram_negative_sampling, c.subsample_threshold)
    rows = training.encoded(sents, vocab).orderBy("row").collect()
    words, sizes, names = np.array([w for r in rows for w in r["ids"]]), np.array([len(r["ids"]) for r in rows]), np.array([r["row"] for r in rows])
    want, loss, n = looped_step(e, words, sizes, names, sampler, c, 1, 0.5)
    df = training.encoded(sents, vocab)
    for parts in (1, 5):  # the result doesn't depend on the partitioning
        got = training.broadcast_step(df.repartition(parts), e, sampler, c, 1, 0.5)
        assert np.allclose(got[0], want, atol=1e-6) and got[1] == pytest.approx(loss) and got[2] == n > 0
    table = spark.createDataFrame([(i, str(i), v.tolist()) for i, v in enumerate(e)], "word_id long, word string, vec array<double>")
    new, loss2, n2 = training.joined_step(df, table, sampler, c, 1, 0.5, chunk=2)
    assert np.allclose(matrix(new), want, atol=1e-6) and loss2 == pytest.approx(loss) and n2 == n


def test_windows_and_negatives(sents, vocab):
    freq = np.array([r["freq"] for r in vocab.orderBy("word_id").collect()])
    words = np.array([0, 1, -1, 2, 3, 4, 0])
    t, of, ctx, neg = training.examples(words, np.array([4, 3]), np.array([9, 8]), training.Sampler.of(freq, True, None), TrainingConfig(context_window=2, negative_samples=3), 0)
    assert t.tolist() == [0, 1, 2, 3, 4, 0]
    assert sorted(zip(of.tolist(), ctx.tolist())) == [(0, 1), (1, 0), (1, 2), (2, 1), (3, 0), (3, 4), (4, 0), (4, 3), (5, 3), (5, 4)]
    for a, n in zip(t, neg):
        assert len(set(n.tolist())) == 3 and a not in n
    # fewer words than are asked for: no endless search
    few = training.Sampler.of(np.array([5, 3]), True, None).negatives(5, np.array([0, 1]), np.array([1, 1]), np.array([0, 1]), 1, 0)
    assert few.tolist() == [[1, -1, -1, -1, -1], [0, -1, -1, -1, -1]]
    rare = training.Sampler.of(np.array([10**12, 1, 1, 0]), True, None).negatives(2, np.array([0]), np.array([1]), np.array([0]), 1, 0)
    assert sorted(rare[0].tolist()) == [1, 2]


def test_negatives_follow_the_distribution():
    s = training.Sampler.of(np.array([81, 16, 16, 1]), True, None)
    n = 20_000
    got = s.negatives(1, np.full(n, 3), np.arange(n), np.zeros(n, int), 1, 0).ravel()
    p = np.array([27, 8, 8]) / 43
    assert np.allclose(np.bincount(got, minlength=3)[:3] / n, p, atol=0.02)


@pytest.mark.parametrize("kind", ["skipgram", "cbow"])
def test_loss_falls_and_seeds_repeat(sents, vocab, kind):
    c = TrainingConfig(**{**CONFIG.__dict__, "epochs": 25, "learning_rate": 1.0, "model_type": kind, "minibatches": 2})
    a, b = (training.VectorModel.new(c, vocab).train(sents) for _ in range(2))
    loss = [r["loss"] for r in a.history.rows]
    assert len(loss) == 25 and sum(loss[-5:]) < sum(loss[:5])
    assert np.array_equal(matrix(a.vectors), matrix(b.vectors))


def test_joined_and_broadcast_runs_agree(sents, vocab):
    whole = training.VectorModel.new(CONFIG, vocab).train(sents)
    parts = training.VectorModel.new(CONFIG, vocab).train(sents, broadcast_bytes=0)
    assert np.allclose(matrix(whole.vectors), matrix(parts.vectors), atol=1e-5)
    assert whole.history.final_loss() == pytest.approx(parts.history.final_loss(), rel=1e-5)


def test_mini_batches_in_order(sents, vocab):
    c = TrainingConfig(**{**CONFIG.__dict__, "use_parallel": False, "epochs": 15, "learning_rate": 0.5})
    m = training.VectorModel.new(c, vocab).train(sents)
    assert m.history.final_loss() < m.history.rows[0]["loss"]
    one = TrainingConfig(**{**CONFIG.__dict__, "use_parallel": False, "epochs": 1, "batch_size": 10**9})
    full = TrainingConfig(**{**CONFIG.__dict__, "epochs": 1})
    a, b = (training.VectorModel.new(x, vocab).train(sents) for x in (one, full))
    assert np.allclose(matrix(a.vectors), matrix(b.vectors), atol=1e-6)


def test_uniform_numbers(spark):
    df = spark.range(50).select("id", u01(3, F.col("id"), "x").alias("u"))
    assert all(r["u"] == u01_py(3, r["id"], "x") and 0 <= r["u"] < 1 for r in df.collect())


def test_settings():
    c = CONFIG.with_dim(16).with_lr_schedule(Schedule("step", step_size=2, gamma=0.5)).with_early_stopping(3, 0.1).with_warmup_epochs(4)
    assert TrainingConfig.from_json(c.to_json()) == c and c.dim == 16 and c.with_window(9).context_window == 9
    rates = [c.learning_rate_at(e) for e in range(4)]
    assert rates[0] == 0 and TrainingConfig(warmup_epochs=4).learning_rate_at(0) < TrainingConfig(warmup_epochs=4).learning_rate_at(1) < TrainingConfig(warmup_epochs=4).learning_rate_at(2)
    with pytest.raises(ValueError):
        TrainingConfig.from_json("{}")
    with pytest.raises(AttributeError):
        c.with_nothing(1)
    assert TrainingConfig().dim == 300


def test_early_stopping():
    s = Stopper(EarlyStopping(2, 0.5))
    assert [s.stop(x) for x in (5.0, 4.9, 4.8, 4.8, 4.8)] == [False, False, False, False, True]
    assert not any(Stopper(None).stop(1.0) for _ in range(9))


def test_history(spark):
    h = History()
    assert h.average_loss() == h.final_loss() == 0.0
    h.record_epoch(1, 4.0, 0.1)
    h.record_epoch(2, 2.0, 0.1)
    h.record_validation(dict.fromkeys(evaluation.METRICS, 0.5))
    assert h.average_loss() == 3.0 and h.final_loss() == 2.0 and len(json.loads(h.to_json())["epochs"]) == 2
    assert h.to_df(spark).where("validation_metrics.accuracy = 0.5").count() == 1


def test_models_and_checkpoints(spark, sents, vocab, tmp_path):
    c = TrainingConfig(**{**CONFIG.__dict__, "epochs": 4, "checkpoint_interval": 2, "checkpoint_path": str(tmp_path)})
    m = training.VectorModel.new(c, vocab).train(sents)
    half = models.load_checkpoint(spark, f"{tmp_path}/checkpoint_epoch_2")
    assert half.epochs_done == 2 and half.config == c
    assert np.allclose(matrix(half.train(sents).vectors), matrix(m.vectors), atol=1e-6) and half.epochs_done == 4
    models.save_model(m, f"{tmp_path}/m")
    assert np.array_equal(matrix(models.load_model(spark, f"{tmp_path}/m").vectors), matrix(m.vectors))


def test_pretrained_start(spark, vocab):
    p = spark.createDataFrame([("cat", [1.0] * 8), ("nowhere", [2.0] * 8)], "word string, vec array<double>")
    v = {r["word"]: r["vec"] for r in training.init_with_pretrained(vocab, p, 8).collect()}
    assert v["cat"] == [1.0] * 8 and max(map(abs, v["dog"])) <= 0.5 / math.sqrt(8) + 1e-6 and "nowhere" not in v
    with pytest.raises(ValueError):
        training.init_with_pretrained(vocab, p, 9)


def test_incremental_and_domain_training(spark, sents, vocab):
    m = training.VectorModel.new(CONFIG, vocab).train(sents)
    n = vocab.count()
    more = spark.createDataFrame([(7, 0, ["brand", "new", "cat"])], "doc_id long, sent_id int, words array<string>")
    u, corpus = training.update(m, sents, more, 1)
    assert u.vocab.count() == n + 2 and corpus.count() == sents.count() + 1 and u.epochs_done == 3
    assert {r["freq"] for r in u.vocab.where("word in ('brand', 'new')").collect()} == {0}
    a = training.adapt(m, more, 2)
    assert a.vectors.count() == n + 2


def test_streams(spark, vocab, sents, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("the cat sat. on a mat\n\nthe dog\n")
    (tmp_path / "in/b.txt").write_text("fresh words here\n")
    incremental.count_stream(incremental.sentence_stream(spark, f"{tmp_path}/in", files_per_trigger=1), f"{tmp_path}/counts")
    got = {r["word"]: r["freq"] for r in incremental.counted(spark, f"{tmp_path}/counts").collect()}
    assert got["the"] == 2 and got["fresh"] == 1 and sum(got.values()) == 11
    m = incremental.stream_train(incremental.sentence_stream(spark, f"{tmp_path}/in"), training.VectorModel.new(CONFIG, vocab), sents, f"{tmp_path}/state", 2, 1)
    assert m.vectors.where("word = 'fresh'").count() == 1 and m.epochs_done == 2


def test_cross_validation(spark, sents):
    got = evaluation.cross_validate(sents, CONFIG, 2).orderBy("fold").collect()
    assert [r["fold"] for r in got] == [-1, 0, 1] and all(0 <= r["accuracy"] <= 1 for r in got)
    assert got[0]["accuracy"] == pytest.approx((got[1]["accuracy"] + got[2]["accuracy"]) / 2)
