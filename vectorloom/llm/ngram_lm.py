"""Language-model scores from a trigram trie in Elias-Fano form.

Counts cover every word of every document. Probabilities are interpolated
with absolute discounting and quantised to 8 bits. The trie is cut into
shards by ranges of (first word, second word); each is one file in the
shared folder that scoring tasks memory-map. The words after a bigram are
stored by their rank among the words that follow its last word, so a
successor search is relative to the shorter context.

The shared folder must be mounted as a file system on every machine.
"""

from __future__ import annotations

import os
import shutil

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, local, shared_path, written
from .eliasfano import EliasFano, map_arrays, nested, unnested, write_arrays
from .textarray import parts, word_hashes

#: Words have 31-bit ids, more than any corpus has words, so that a bigram fits 62 bits, as does a trigram by the place of its bigram. 0 is any other word and 1 the start of a text.
BITS, UNKNOWN, START, WORDS = 31, 0, 1, 2
VOCABULARY = (1 << BITS) - WORDS
LEAST_WORD, LEAST_BIGRAM, LEAST_TRIGRAM, DISCOUNT, SHARD_TOKENS = 2, 2, 2, 0.75, 4_000_000
_LOW = np.int64((1 << BITS) - 1)
#: Characters counted and scored at once: the more, the fewer times an n-gram is shuffled or looked up and a shard visited.
PART, SCORED = 2_000_000, 4_000_000


def word_ids(h: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    at = np.searchsorted(vocabulary, h)
    at[at == len(vocabulary)] = 0
    known = vocabulary[at] == h if len(vocabulary) else np.zeros(len(h), bool)
    return np.where(known, at + WORDS, UNKNOWN)


def with_starts(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids with a start mark before each text, and the number of words before each place inside its text."""
    n = np.diff(at)
    begins = at[:-1] + np.arange(len(n))
    out = np.empty(len(ids) + len(n), np.int64)
    word = np.ones(len(out), bool)
    word[begins] = False
    out[begins], out[word] = START, ids
    return out, np.arange(len(out)) - np.repeat(begins, n + 1)


def _squeeze(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys and counts, byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(keys.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes() + np.ascontiguousarray(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return zstandard.ZstdCompressor(1).compress(planes)


def _expand(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n = len(raw) // 12
    return np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view("<i8").ravel(), np.ascontiguousarray(raw[8 * n :].reshape(4, n).T).view("<u4").ravel()


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def shard_bounds(counts: np.ndarray, shards: int) -> np.ndarray:
    """First (first word, second word) key of each shard. Ranges of words hold
    about equal counts; a word above a shard's share is cut by its second word, as if that were independent."""
    share = np.cumsum(counts) / max(1, counts.sum())
    out = {0}
    for q in np.arange(1, shards) / shards:
        u = int(np.searchsorted(share, q, "left"))
        inside = (q - (share[u - 1] if u else 0)) / max(1e-300, counts[u] / counts.sum())
        v = int(np.searchsorted(share, inside, "left")) if counts[u] * shards > counts.sum() else 0
        out.add((u << BITS) + min(v, len(counts) - 1))
    return np.array(sorted(out), np.int64)


def _quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """8-bit codes and the means of up to 256 equally filled bins."""
    if not len(x):
        return np.zeros(0, np.uint8), np.zeros(1, np.float32)
    edges = np.unique(np.quantile(x, np.arange(1, 256) / 256, method="lower"))
    code = np.searchsorted(edges, x, "left")
    n = np.bincount(code, minlength=len(edges) + 1)
    return code.astype(np.uint8), (np.bincount(code, x, len(edges) + 1) / np.maximum(n, 1)).astype(np.float32)


def _relative(values: np.ndarray, pointers: np.ndarray) -> np.ndarray:
    """Groups of rising values as one rising sequence: each group begins
    after the last value of the one before."""
    n = np.diff(pointers)
    ends = np.cumsum(np.where(n > 0, values[np.maximum(pointers[1:] - 1, 0)] + 1, 0)) if len(values) else np.zeros(len(n), np.int64)
    base = np.concatenate([[0], ends])[:-1]
    return values + np.repeat(base, n)


def _in_group(seq: EliasFano, pointers: EliasFano, group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value lies in its group of the sequence, or -1, and where
    the group begins. A group that is asked several times in a row is opened once."""
    fresh = np.concatenate([[True], group[1:] != group[:-1]])
    groups, of = group[fresh], np.cumsum(fresh) - 1
    lo, hi = pointers[groups], pointers[groups + 1]
    base = np.zeros(len(lo), np.int64)
    later = lo > 0
    base[later] = seq[lo[later] - 1] + 1
    at, first = seq.find(base[of] + value), lo[of]
    return np.where((at >= first) & (at < hi[of]), at, -1), first


class Model:
    """The trie, opened in the process that asks."""

    def __init__(self, folder: str):
        self.words = map_arrays(f"{folder}/words")
        self.vocabulary, self.bounds = self.words["vocabulary"], self.words["bounds"]
        self.folder, self.opened = folder, {}

    def shard(self, k: int) -> tuple[int, int, dict[str, EliasFano], dict[str, np.ndarray]]:
        """First word, entries of it in earlier shards, sequences and tables of a shard, mapped when it is first asked."""
        if k not in self.opened:
            a = map_arrays(f"{self.folder}/shard-{k}")
            self.opened[k] = int(a["first"][0]), int(a["first"][1]), {s: EliasFano(unnested(s, a)) for s in ("p2", "v2", "p3", "v3")}, a
        return self.opened[k]

    def _by_shard(self, key: np.ndarray):
        shard = np.searchsorted(self.bounds, key, "right") - 1
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(len(self.bounds) + 1))
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            yield self.shard(k), order[cuts[k] : cuts[k + 1]]

    def bigrams(self, u: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
        """For each bigram: its place in its shard or -1, log10 probability,
        log10 back-off weight, and rank among the successors of u."""
        n = len(u)
        out = {"at": np.full(n, -1, np.int64), "p": np.zeros(n), "bow": np.zeros(n), "rank": np.zeros(n, np.int64)}
        for (first, carry, seqs, a), i in self._by_shard((u << BITS) + v):
            g = u[i] - first
            inside = g < seqs["p2"].n - 1
            i, g = i[inside], g[inside]
            if not len(i):
                continue
            at, lo = _in_group(seqs["v2"], seqs["p2"], g, v[i])
            hit = at >= 0
            i, at, lo, g = i[hit], at[hit], lo[hit], g[hit]
            out["at"][i], out["rank"][i] = at, at - lo + np.where(g == 0, carry, 0)
            out["p"][i], out["bow"][i] = a["book2"][a["code2"][at]], a["bookw"][a["codew"][at]]
        return out

    def trigrams(self, u, v, at: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """log10 probability of the trigrams whose first bigram is at `at` and
        whose last word has `rank` after the second; NaN where there is none."""
        out = np.full(len(u), np.nan)
        for (_, _, seqs, a), i in self._by_shard((u << BITS) + v):
            k, _ = _in_group(seqs["v3"], seqs["p3"], at[i], rank[i])
            out[i[k >= 0]] = a["book3"][a["code3"][k[k >= 0]]]
        return out

    def log10(self, ids: np.ndarray, place: np.ndarray) -> np.ndarray:
        """log10 probability of each word given the two before it, for the
        output of :func:`with_starts`; 0 at start marks."""
        out = np.zeros(len(ids))
        w = np.flatnonzero(place > 0)
        if not len(w):
            return out
        # each different n-gram is looked up once, in the order of the trie
        grams, of = np.unique((ids[w - 1] << BITS) + ids[w], return_inverse=True)
        u, v = grams >> BITS, grams & _LOW
        b = self.bigrams(u, v)
        p = np.where(b["at"] >= 0, b["p"], self.words["bow"][u] + self.words["p"][v])[of]
        gram = np.full(len(ids), -1, np.int64)
        gram[w] = of
        t = np.flatnonzero(place[w] > 1)
        before = gram[w[t] - 1]
        p[t] += b["bow"][before]
        known = (b["at"][before] >= 0) & (b["at"][of[t]] >= 0)
        t, before = t[known], before[known]
        three, of3 = np.unique((before << BITS) + b["rank"][of[t]], return_inverse=True)
        context = three >> BITS
        full = self.trigrams(u[context], v[context], b["at"][context], three & _LOW)[of3]
        p[t] = np.where(np.isnan(full), p[t], full)
        out[w] = p
        return out


_models: dict[str, Model] = {}


def opened(folder: str) -> Model:
    """The model of a folder, opened once in a Python process."""
    if folder not in _models:
        _models.clear()
        _models[folder] = Model(folder)
    return _models[folder]


def _vocabulary(texts: DataFrame, size: int, least: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted hashes and counts of the words in the model, and the number of
    all words. Words of equal count are all in or all out."""

    def count(batches):
        for batch in batches:
            found = batch.column(0).to_pylist()
            for a, b in parts(found):
                h, n = np.unique(word_hashes(found[a:b])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    spark = texts.sparkSession
    path = shared_path(spark, "words")
    texts.mapInArrow(lean(count, 16 << 20), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).write.parquet(path)
    words = spark.read.parquet(path)
    sizes = sorted(((r["n"], r["count"]) for r in words.groupBy("n").count().collect()), reverse=True)
    kept, cutoff = 0, None
    for n, c in sizes:
        if n < least or kept + c > size:
            break
        kept, cutoff = kept + c, n
    h, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if cutoff is not None:
        got = words.where(F.col("n") >= cutoff).toArrow()
        h, n = got.column("h").to_numpy().view(np.uint64), got.column("n").to_numpy()
        order = np.argsort(h)
        h, n = h[order], n[order]
    shutil.rmtree(local(path), ignore_errors=True)
    return h, n, sum(a * b for a, b in sizes)


def train(docs: DataFrame, vocabulary: int = VOCABULARY, least_word: int = LEAST_WORD, least_bigram: int = LEAST_BIGRAM, least_trigram: int = LEAST_TRIGRAM, discount: float = DISCOUNT, shard_tokens: int = SHARD_TOKENS) -> str:
    """Builds the model of all texts in the shared folder; returns its path.

    Every word is counted. The `vocabulary` most frequent words that occur at
    least `least_word` times have entries of their own, all others share one.
    Bigrams and trigrams rarer than their limits get no entry; their mass goes
    to the back-off weight, so probabilities still sum to one.
    """
    if least_trigram < least_bigram:
        raise ValueError("a trigram's entry needs those of its bigrams")
    spark: SparkSession = docs.sparkSession
    texts = docs.select("text").where("text is not null")
    folder = local(shared_path(spark, "lm"))
    os.makedirs(folder)
    h, n, total = _vocabulary(texts, vocabulary, least_word)
    n_texts = texts.count()
    counts = np.concatenate([[total - n.sum(), n_texts], n]).astype(np.int64)
    bounds = shard_bounds(counts + 1, max(1, total // shard_tokens))
    np.save(f"{folder}/vocabulary.npy", h)
    np.save(f"{folder}/bounds.npy", bounds)

    def count(batches):
        known, limits = np.load(f"{folder}/vocabulary.npy"), np.load(f"{folder}/bounds.npy")
        for batch in batches:
            found = batch.column(0).to_pylist()
            for a, b in parts(found, PART):
                hashes, at = word_hashes(found[a:b])
                ids, place = with_starts(word_ids(hashes, known), at)
                two = (ids[:-1] << BITS) + ids[1:]
                keys, c = np.unique(two[place[1:] > 0], return_counts=True)
                # a trigram is known by the place of its bigram among those of the batch
                third = place[2:] > 1
                keys3, c3 = np.unique((np.searchsorted(keys, two[:-1][third]) << BITS) + ids[2:][third], return_counts=True)
                cuts = np.searchsorted(keys, np.append(limits, np.int64(1) << 2 * BITS))
                cuts3 = np.searchsorted(keys3, cuts << BITS)
                rows = [(k, _squeeze(keys[i:j], c[i:j]), _squeeze(keys3[x:y] - (int(i) << BITS), c3[x:y])) for k, (i, j, x, y) in enumerate(zip(cuts[:-1], cuts[1:], cuts3[:-1], cuts3[1:])) if i < j]
                cols = list(zip(*rows)) if rows else [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(cols, (pa.int32(), pa.binary(), pa.binary()))], ["shard", "two", "three"])

    def merge(group: pa.Table) -> pa.Table:
        k = group.column("shard")[0].as_py()
        got = [_expand(b) for b in group.column("two").to_pylist()]
        two, c2 = _summed(*(np.concatenate(x) for x in zip(*got)))
        found = []
        for (keys, _), b in zip(got, group.column("three").to_pylist()):
            more, c = _expand(b)
            found.append(((np.searchsorted(two, keys)[more >> BITS] << BITS) + (more & _LOW), c))
        three, c3 = _summed(*(np.concatenate(x) for x in zip(*found)))
        keep2, keep3 = c2 >= least_bigram, c3 >= least_trigram
        of, place = three >> BITS, np.cumsum(keep2) - 1  # a trigram's bigram, and where kept bigrams will lie
        known = keep2[of]
        context = np.bincount(place[of[known]], c3[known], int(keep2.sum())).astype(np.int64)
        write_arrays(f"{folder}/raw-{k}", {"two": two[keep2], "c2": c2[keep2], "context": context, "three": (place[of[keep3]] << BITS) + (three[keep3] & _LOW), "c3": c3[keep3]})
        u, first = np.unique(two >> BITS, return_index=True)
        stats = [u] + [np.add.reduceat(x, first) for x in (c2, np.where(keep2, c2, 0), keep2.astype(np.int64))] if len(u) else [u] * 4
        return pa.table([pa.array([k] * len(u), pa.int32()), *(pa.array(x.astype(np.int64)) for x in stats)], ["shard", "u", "total", "kept", "types"])

    merged = texts.mapInArrow(lean(count, 16 << 20), "shard int, two binary, three binary").groupBy("shard").applyInArrow(merge, "shard int, u long, total long, kept long, types long")
    merged = written(merged, "lm-words")
    # one row a word comes to the driver, however many shards a word has
    stats = merged.groupBy("u").agg(*[F.sum(k).alias(k) for k in ("total", "kept", "types")]).toArrow()
    u = stats.column("u").to_numpy()
    sums = {k: np.bincount(u, stats.column(k).to_numpy(), len(counts)) for k in ("total", "kept", "types")}
    weight = np.where(sums["total"] > 0, 1 - (sums["kept"] - discount * sums["types"]) / np.maximum(sums["total"], 1), 1.0)
    p = counts + 1.0
    p[START] = 0
    # how many entries of a shard's first word lie in earlier shards
    firsts = spark.createDataFrame([(k, int(b) >> BITS) for k, b in enumerate(bounds)], "k int, u long")
    earlier = merged.join(F.broadcast(firsts), "u").where("shard < k").groupBy("k").agg(F.sum("types").alias("n"))
    carry = np.zeros(len(bounds), np.int64)
    for r in earlier.collect():
        carry[r["k"]] = r["n"]
    with np.errstate(divide="ignore"):
        unigrams = np.log10(p / p.sum())
    unigrams[START] = -99
    write_arrays(f"{folder}/words", {"vocabulary": h, "bounds": bounds, "p": unigrams.astype(np.float32), "bow": np.log10(np.maximum(weight, 1e-9)).astype(np.float32), "total": sums["total"].astype(np.int64), "weight": weight, "carry": carry})

    def build(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                _build_shard(folder, k, discount)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64())], ["k"])

    spark.range(0, len(bounds), 1, len(bounds)).mapInArrow(build, "k long").count()
    for name in os.listdir(folder):
        if name.startswith("raw-") or name.endswith(".npy"):
            os.remove(f"{folder}/{name}")
    return folder


def _raw(folder: str, k: int) -> dict[str, np.ndarray]:
    path = f"{folder}/raw-{k}"
    return map_arrays(path) if os.path.exists(path) else {x: np.zeros(0, np.int64) for x in ("two", "c2", "context", "three", "c3")}


def _p2(words, p1, two, c2, discount):
    u, v = two >> BITS, two & _LOW
    return (c2 - discount) / words["total"][u] + words["weight"][u] * p1[v]


def _build_shard(folder: str, k: int, discount: float) -> None:
    words = map_arrays(f"{folder}/words")
    bounds, p1, raw = words["bounds"], 10.0 ** words["p"].astype(float), _raw(folder, k)
    first = int(bounds[k]) >> BITS
    last = int(bounds[k + 1] - 1) >> BITS if k + 1 < len(bounds) else len(p1) - 1
    two, three, c3 = raw["two"], raw["three"], raw["c3"]
    pointers2 = np.searchsorted(two, np.arange(first, last + 2, dtype=np.int64) << BITS)
    pointers3 = np.searchsorted(three, np.arange(len(two) + 1, dtype=np.int64) << BITS)
    # the bigram of the last two words: its probability and its rank, from whichever shard has it
    tail = ((two[three >> BITS] & _LOW) << BITS) + (three & _LOW)
    lower, rank = np.zeros(len(three)), np.zeros(len(three), np.int64)
    shard = np.searchsorted(bounds, tail, "right") - 1
    for s in np.unique(shard):
        i, other = np.flatnonzero(shard == s), _raw(folder, int(s))
        at = np.searchsorted(other["two"], tail[i])
        v = tail[i] >> BITS
        lower[i] = _p2(words, p1, other["two"][at], other["c2"][at], discount)
        rank[i] = at - np.searchsorted(other["two"], v << BITS) + np.where(v == int(bounds[s]) >> BITS, words["carry"][s], 0)
    n = np.diff(pointers3)
    of = np.repeat(np.arange(len(two)), n)
    context = np.maximum(raw["context"], 1)
    kept = np.bincount(of, c3 - discount, len(two)) if len(two) else np.zeros(0)
    weight = 1 - kept / context
    p3 = (c3 - discount) / context[of] + weight[of] * lower
    out = {"first": np.array([first, words["carry"][k]], np.int64)}
    for name, x in (("2", _p2(words, p1, two, raw["c2"], discount)), ("w", np.maximum(weight, 1e-9)), ("3", p3)):
        out[f"code{name}"], out[f"book{name}"] = _quantised(np.log10(x))
    for name, seq in (("p2", pointers2), ("v2", _relative(two & _LOW, pointers2)), ("p3", pointers3), ("v3", _relative(rank, pointers3))):
        out |= nested(name, EliasFano.encode(seq))
    write_arrays(f"{folder}/shard-{k}", out)


def score(docs: DataFrame, folder: str | None = None, **settings) -> DataFrame:
    """(doc_id, n_words, log10_prob, perplexity) for every row of docs, under
    the model in `folder` or, by default, one trained on docs.

    Words are lower-cased runs of letters, digits and "_". A null text or one
    without words has 0 words, log10_prob 0 and a null perplexity. Null
    doc_ids stay; equal rows are scored alike (and counted as often as they
    are there); other columns are ignored; an empty table gives no rows.
    """
    folder = folder or train(docs, **settings)

    def run(batches):
        model = opened(folder)
        for batch in batches:
            found = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in parts(found, SCORED):
                h, at = word_hashes(found[a:b])
                ids, place = with_starts(word_ids(h, model.vocabulary), at)
                p = np.concatenate([[0], np.cumsum(model.log10(ids, place))])
                begins = at + np.arange(len(at))
                total, n = p[begins[1:]] - p[begins[:-1]], np.diff(at)
                with np.errstate(divide="ignore", invalid="ignore"):
                    perplexity = 10 ** (-total / n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n.astype(np.int64)), pa.array(np.where(n > 0, total, 0.0)), pa.array(perplexity, mask=n == 0)], ["doc_id", "n_words", "log10_prob", "perplexity"]
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run, 16 << 20), "doc_id long, n_words long, log10_prob double, perplexity double")
