"""Subword tokenizers: byte-pair merges, greedy word pieces, character n-grams.

Training counts words with Spark; what is left for the driver is one pass a
merge over a bounded number of different runs of symbols. Encoding is an Arrow UDF that remembers words.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..sources.shared import written

#: Different runs of symbols that the driver merges at a time.
MOST_RUNS = 100_000
END, UNKNOWN = "</w>", "[UNK]"
SPECIALS = ("[PAD]", UNKNOWN, "[CLS]", "[SEP]", "[MASK]")


def word_counts(words: DataFrame, word: str = "word", count: str | None = None) -> DataFrame:
    """(word, n) of trimmed, lower-cased words; `count` names a column of counts there already."""
    w = F.lower(F.trim(word))
    return words.select(w.alias("word"), (F.col(count) if count else F.lit(1)).cast("long").alias("n")).where("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))


def pair_counts(counts: DataFrame) -> DataFrame:
    """(left, right, n): neighbouring symbols of all words before any merge."""
    c = F.concat(F.split("word", ""), F.array(F.lit(END)))
    pairs = F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda i: F.struct(F.element_at(c, i).alias("left"), F.element_at(c, i + 1).alias("right")))
    return counts.select("n", F.explode(pairs).alias("p")).groupBy("p.left", "p.right").agg(F.sum("n").alias("n"))


def _merged(symbols: tuple, a, b, both=None) -> tuple:
    out, i, both = [], 0, a + b if both is None else both
    while i < len(symbols):
        if i + 1 < len(symbols) and symbols[i] == a and symbols[i + 1] == b:
            out.append(both)
            i += 2
        else:
            out.append(symbols[i])
            i += 1
    return tuple(out)


def _numbers(words: pa.Array, codes: np.ndarray, end: int, merges: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of words laid end to end, as numbers and after all merges (a, b, both), and the word of each."""
    points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), "<u4")
    sizes = pc.utf8_length(words).to_numpy() + 1
    flat, word = np.full(int(sizes.sum()), end, np.int64), np.repeat(np.arange(len(sizes)), sizes)
    inside = np.ones(len(flat), bool)
    inside[np.cumsum(sizes) - 1] = False
    flat[inside] = np.searchsorted(codes, points)
    for a, b, both in merges:
        hit = np.flatnonzero((flat[:-1] == a) & (flat[1:] == b) & (word[:-1] == word[1:]))
        if not len(hit):
            continue
        if a == b:  # every other one of hits side by side, from the left
            first = np.concatenate([[True], np.diff(hit) != 1])
            hit = hit[(np.arange(len(hit)) - np.maximum.accumulate(np.where(first, np.arange(len(hit)), 0))) % 2 == 0]
        flat[hit] = both
        flat, word = np.delete(flat, hit + 1), np.delete(word, hit + 1)
    return flat, word


def _symbol_pairs(words: DataFrame, numbers: tuple) -> dict[tuple[int, int], int]:
    """How often every two symbols are neighbours."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                flat, word = _numbers(batch.column(0), *numbers)
                near = word[:-1] == word[1:]
                t = pa.table({"a": flat[:-1][near], "b": flat[1:][near], "n": batch.column(1).to_numpy()[word[:-1][near]]})
                yield from t.group_by(["a", "b"]).aggregate([("n", "sum")]).select(["a", "b", "n_sum"]).rename_columns(["a", "b", "n"]).to_batches()

    got = words.mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).toArrow()
    return {(a, b): n for a, b, n in zip(*(got.column(c).to_pylist() for c in ("a", "b", "n")))}


def _runs(words: DataFrame, numbers: tuple, kept: list[tuple[int, int]]) -> DataFrame:
    """(run, n): the longest runs of symbols whose neighbours all are pairs of `kept`."""
    base = 1 + max(max(p) for p in kept)
    keys = np.sort(np.array([a * base + b for a, b in kept], np.int64))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, word = _numbers(batch.column(0), *numbers)
            key = np.where((flat[:-1] < base) & (flat[1:] < base), flat[:-1] * base + flat[1:], -1)
            on = (word[:-1] == word[1:]) & (keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key)
            after, before = np.append(on, False), np.insert(on, 0, False)
            used, first = after | before, after & ~before
            if not first.any():
                continue
            starts = (np.cumsum(used) - 1)[first]
            ends = np.append(starts, used.sum()) * 4
            found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat[used].astype(np.int32))])
            t = pa.table({"run": found, "n": batch.column(1).to_numpy()[word[first]]}).group_by("run").aggregate([("n", "sum")])
            yield from t.select(["run", "n_sum"]).rename_columns(["run", "n"]).to_batches()

    return written(words.mapInArrow(run, "run binary, n long").groupBy("run").agg(F.sum("n").alias("n")), "runs")


@dataclass(frozen=True)
class Bpe:
    """merges in the order they were learned; vocab maps symbols to ids."""

    merges: tuple[tuple[str, str], ...]
    vocab: dict[str, int]

    @classmethod
    def train(cls, counts: DataFrame, size: int, most: int = MOST_RUNS) -> Bpe:
        """Learns merges from (word, n) until the vocabulary has `size`
        symbols. The most frequent pair goes first; ties go to the least pair.

        Words stay in the tasks. Each round counts all pairs and cuts the words to runs of the most
        frequent ones, of which the driver gets at most `most` different ones (more only if one pair alone has them).
        A pair across a cut, and any that merges make there, is no more frequent than the first pair left
        out, so the round's merges are those of the whole words while they are more frequent than that."""
        words = written(counts.select("word", F.col("n").cast("long").alias("n")), "words")
        n_words = words.count()
        chars = sorted(r["c"] for r in words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().collect())
        symbols = [*chars, END] if n_words else []
        vocab = {s: k for k, s in enumerate(sorted(symbols))}
        number = {s: k for k, s in enumerate(symbols)}
        codes, merges, keep = np.array([ord(c) for c in chars], np.int64), [], 64
        while len(vocab) < size:
            numbers = (codes, len(chars), list(merges))
            pairs = _symbol_pairs(words, numbers)
            if not pairs:
                break
            ranked = sorted(pairs, key=lambda p: (-pairs[p], symbols[p[0]], symbols[p[1]]))
            keep = len(ranked) if n_words <= most else min(keep, len(ranked))
            while (runs := _runs(words, numbers, ranked[:keep])).count() > most and keep > 1:
                keep //= 2
            least = pairs[ranked[keep]] if keep < len(ranked) else 0
            got = runs.toArrow()
            held = [[tuple(np.frombuffer(r, np.int32).tolist()), n] for r, n in zip(got.column("run").to_pylist(), got.column("n").to_pylist())]
            if len(held) < most // 4:
                keep *= 2
            merges += cls._merge(held, symbols, number, vocab, size, least)
        return cls(tuple((symbols[a], symbols[b]) for a, b, _ in merges), vocab)

    @staticmethod
    def _merge(words: list, symbols: list[str], number: dict[str, int], vocab: dict[str, int], size: int, least: int) -> list[tuple[int, int, int]]:
        """The merges of [symbols, n] while the best pair is more frequent than `least`, one in any case.
        Ends where a merge gives a symbol that was there: its pairs may lie across several cuts."""
        pairs: Counter = Counter()
        where: dict[tuple[int, int], set[int]] = defaultdict(set)
        for i, (w, n) in enumerate(words):
            for p in zip(w, w[1:]):
                pairs[p] += n
                where[p].add(i)
        out: list[tuple[int, int, int]] = []
        while len(vocab) < size and pairs:
            best = min(pairs, key=lambda p: (-pairs[p], symbols[p[0]], symbols[p[1]]))
            if out and pairs[best] <= least:
                break
            text = symbols[best[0]] + symbols[best[1]]
            known = text in number
            if not known:
                number[text] = len(symbols)
                symbols.append(text)
            vocab.setdefault(text, len(vocab))
            out.append((*best, number[text]))
            if known and least:
                break
            for i in sorted(where.pop(best)):
                w, n = words[i]
                new = _merged(w, *best, number[text])
                for p in zip(w, w[1:]):
                    pairs[p] -= n
                    if pairs[p] <= 0:
                        del pairs[p]
                for p in zip(new, new[1:]):
                    pairs[p] += n
                    where[p].add(i)
                words[i][0] = new
            pairs.pop(best, None)
        return out

    def encode_py(self, text: str) -> list[str]:
        """The symbols of a text, taken as one word: each merge is applied once, in the order learned."""
        rank = self._rank
        w, last, none = (*text.lower(), END), -1, len(rank)
        while len(w) > 1:
            k = min(r if (r := rank.get(p, none)) > last else none for p in zip(w, w[1:]))
            if k == none:
                break
            w, last = _merged(w, *self.merges[k]), k
        return list(w)

    @cached_property
    def _rank(self) -> dict[tuple[str, str], int]:
        return {m: k for k, m in enumerate(self.merges)}

    def encode(self, text: Column) -> Column:
        return _remembered(self.encode_py)(text)

    @staticmethod
    def decode(symbols: Column) -> Column:
        return F.trim(F.replace(F.array_join(symbols, ""), F.lit(END), F.lit(" ")))


def _remembered(f):
    @F.arrow_udf(ArrayType(StringType()))
    def run(v: pa.Array) -> pa.Array:
        known: dict[str, list[str]] = {}

        def one(t):
            if t is None:
                return None
            if t not in known:
                if len(known) > 200_000:
                    known.clear()
                known[t] = f(t)
            return known[t]

        return pa.array([one(t) for t in v.to_pylist()], pa.list_(pa.string()))

    return run


def substring_counts(counts: DataFrame, shortest: int = 2, longest: int = 8) -> DataFrame:
    """(sub, n): all substrings of these lengths, in characters, of (word, n)."""
    grams = _substrings(F.lower("word"), shortest, longest)
    return counts.select("n", F.explode(grams).alias("sub")).groupBy("sub").agg(F.sum("n").alias("n"))


def _substrings(w: Column, shortest: int, longest: int) -> Column:
    """Substrings by length, then by place."""
    n = F.length(w)

    def of(k: int) -> Column:
        return F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.array(*[of(k) for k in range(shortest, longest + 1)]))


@dataclass(frozen=True)
class WordPiece:
    vocab: dict[str, int]

    @classmethod
    def train(cls, counts: DataFrame, size: int) -> WordPiece:
        """Special pieces, all characters in order, then the most frequent
        substrings (ties: the least first) up to `size` pieces."""
        vocab = {s: k for k, s in enumerate(SPECIALS)}
        for r in counts.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().orderBy("c").collect():
            vocab.setdefault(r["c"], len(vocab))
        for r in substring_counts(counts).orderBy(F.desc("n"), "sub").limit(max(0, size)).collect():
            if len(vocab) >= size:
                break
            vocab.setdefault(r["sub"], len(vocab))
        return cls(vocab)

    def word_py(self, word: str) -> list[str]:
        """Longest known piece first, lower-cased; pieces after the first are
        marked "##", and a character that begins no piece is unknown."""
        out, at, word = [], 0, word.lower()
        longest = self._longest
        while at < len(word):
            end = next((e for e in range(min(len(word), at + longest), at, -1) if word[at:e] in self.vocab), 0)
            out.append(UNKNOWN if not end else ("##" if at else "") + word[at:end])
            at = end or at + 1
        return out

    @cached_property
    def _longest(self) -> int:
        return max(map(len, self.vocab), default=1)

    def encode(self, text: Column) -> Column:
        return _remembered(lambda t: [p for w in t.split() for p in self.word_py(w)])(text)

    @staticmethod
    def decode(pieces: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(F.array_join(pieces, " "), r" ##", ""), r"^##", "")


def char_ngrams(word: Column, shortest: int = 3, longest: int = 6) -> Column:
    """Character n-grams of "<word>", by length and then by place."""
    return _substrings(F.concat(F.lit("<"), word, F.lit(">")), shortest, longest)
