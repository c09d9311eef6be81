"""Command line: train, similarity, info, export, validate, interactive."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.code import CodeProcessor, code_sentences
from .functions.text import sentences
from .functions.vector import norm
from .operators.evaluation import METRICS, evaluate, validation_data
from .operators.search import analogy, semantic_search, similarity
from .operators.vocab import split, vocab_of_sentences
from .plans.config import TrainingConfig
from .plans.training import VectorModel
from .sources.formats import EXPORTS, export, save_text, whole_text
from .sources.models import load_model, save_model
from .sources.shared import written


def _session() -> SparkSession:
    return SparkSession.builder.appName("vectorloom").getOrCreate()


def _sentences(spark: SparkSession, path: str, code: bool = False, language: str = "rust") -> DataFrame:
    docs = whole_text(spark, path)
    return written(code_sentences(docs, CodeProcessor(language=language)) if code else sentences(docs), "input")


def _config(a: argparse.Namespace) -> TrainingConfig:
    if getattr(a, "config", None):
        with open(a.config, encoding="utf-8") as f:
            return TrainingConfig.from_json(f.read())
    names = {"dim": "dim", "learning_rate": "learning_rate", "epochs": "epochs", "batch_size": "batch_size", "window": "context_window", "negative_samples": "negative_samples", "model_type": "model_type"}
    return TrainingConfig(**{to: getattr(a, k) for k, to in names.items() if hasattr(a, k)})


def _report(model: VectorModel, held: DataFrame, path: str | None) -> dict[str, float]:
    pos, neg, _ = validation_data(held)
    metrics = dict(zip(METRICS, map(float, evaluate(model.vectors, pos, neg).first())))
    print("\n".join(f"{k}: {v:.4f}" for k, v in metrics.items()))
    if path:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(metrics, f, indent=2)
    return metrics


def train(a: argparse.Namespace) -> None:
    s = _sentences(_session(), a.input, a.code, a.language)
    held, config = None, _config(a)
    # a configuration file's ratio comes before the flag
    ratio = a.validation_ratio if config.validation_ratio is None else config.validation_ratio
    if ratio > 0:
        s, held = split(s, ["doc_id", "sent_id"], 1 - ratio)
        vocab = vocab_of_sentences(s.unionByName(held))
    else:
        vocab = vocab_of_sentences(s)
    model = VectorModel.new(config, written(vocab, "vocab")).train(s)
    save_model(model, a.output)
    save_text(model.vectors, a.vectors)
    print(f"final loss {model.history.final_loss():.4f} after {model.epochs_done} epochs")
    if held is not None:
        model.history.record_validation(_report(model, held, a.validation_output))


def show_similarity(a: argparse.Namespace) -> None:
    s = similarity(load_model(_session(), a.model).vectors, a.word1, a.word2).first()["similarity"]
    if s is None:
        sys.exit("one of the words isn't in the vocabulary")
    print(f"{s:.4f}")


def info(a: argparse.Namespace) -> None:
    m = load_model(_session(), a.model)
    print(f"words {m.vocab.count()}, dimension {m.config.dim}, {m.config.model_type}, epochs {m.config.epochs}, rate {m.config.learning_rate}, window {m.config.context_window}")
    for r in m.vectors.orderBy("word_id").limit(10).select("word", norm("vec").alias("n")).collect():
        print(f"  {r['word']}: norm {r['n']:.3f}")


def run_export(a: argparse.Namespace) -> None:
    export(load_model(_session(), a.model).vectors, a.output, a.format)


def validate(a: argparse.Namespace) -> None:
    spark = _session()
    _report(load_model(spark, a.model), _sentences(spark, a.input), a.output)


def answer(model: VectorModel, line: str) -> str:
    """One line of the interactive mode: "sim a b", "analogy a b c" or "search a"."""
    what, *words = line.split() or [""]
    if what == "sim" and len(words) == 2:
        s = similarity(model.vectors, *words).first()["similarity"]
        return "unknown word" if s is None else f"{s:.4f}"
    if what in ("analogy", "search") and len(words) == (3 if what == "analogy" else 1):
        found = analogy(model.vectors, *words, 5) if what == "analogy" else semantic_search(model.vectors, words[0], 10)
        return "\n".join(f"{r['word']} {r['similarity']:.4f}" for r in found.collect()) or "nothing found"
    return "sim WORD WORD, analogy WORD WORD WORD, search WORD, or quit"


def interactive(a: argparse.Namespace) -> None:
    s = _sentences(_session(), a.input)
    model = VectorModel.new(_config(a), written(vocab_of_sentences(s), "vocab")).train(s)
    save_model(model, a.output)
    for line in sys.stdin:
        if line.strip() in ("quit", "exit"):
            break
        print(answer(model, line), flush=True)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="vectorloom", description=__doc__)
    sub = top.add_subparsers(required=True)

    def command(name, run, *options):
        p = sub.add_parser(name)
        p.set_defaults(run=run)
        for flags, settings in options:
            p.add_argument(*flags.split(), **settings)

    def o(flags, **settings):
        return flags, settings

    need = {"required": True}
    tuning = [o("--epochs", type=int, default=10), o("-l --learning-rate", type=float, default=0.025), o("-w --window", type=int, default=5), o("-n --negative-samples", type=int, default=5)]
    command(
        "train", train, o("-i --input", **need), o("-o --output", **need), o("-e --vectors", **need), o("-c --config"), o("-d --dim", type=int, default=300), o("-b --batch-size", type=int, default=32), *tuning,
        o("-m --model-type", choices=["skipgram", "cbow"], default="skipgram"), o("--validation-ratio", type=float, default=0.0), o("--validation-output"), o("--code", action="store_true"), o("--language", default="rust"),
    )
    command("similarity", show_similarity, o("word1"), o("word2"), o("-m --model", **need), o("-v --vocab"))
    command("info", info, o("-m --model", **need), o("-v --vocab"))
    command("export", run_export, o("-m --model", **need), o("-v --vocab"), o("-o --output", **need), o("-f --format", choices=list(EXPORTS), default="text"))
    command("validate", validate, o("-m --model", **need), o("-i --input", **need), o("-o --output"))
    command("interactive", interactive, o("-i --input", **need), o("-o --output", default="model"), o("-d --dim", type=int, default=100), *tuning, o("-m --model-type", choices=["skipgram", "cbow"], default="skipgram"))
    return top


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    a.run(a)


if __name__ == "__main__":
    main()
