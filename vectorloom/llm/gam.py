"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees, boosted one feature after the other, become one lookup table a
feature; the pairs that explain most of what is left become small
two-dimensional tables. A document's score is a sum of table entries.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, mix64, window_hashes
from .textarray import DIGIT, LOWER, UPPER, WORD, classes, parts, points, run_hashes, word_hashes

FEATURES = ("log_words", "word_length", "upper", "digits", "signs", "distinct", "top_word", "repeated_trigrams", "log_lines", "repeated_lines", "line_length", "stops", "bars", "exclamations")
BINS, COARSE, ROUNDS, PAIR_ROUNDS, PAIRS, RATE, TRAIN_ROWS, CUT = 32, 8, 150, 60, 8, 0.1, 20_000, 0.5


def features(texts: list[str]) -> np.ndarray:
    """One row of FEATURES for each text; zeros for one without words. Uses the whole text."""
    out = np.zeros((len(texts), len(FEATURES)))
    for a, b in parts(texts):
        chunk = texts[a:b]
        c = points("\0".join(chunk) + "\0")
        ends = np.cumsum(np.array([len(t) for t in chunk]) + 1)
        begins = ends - np.array([len(t) for t in chunk]) - 1
        kind = classes().take(c)

        def share(mask, of):
            s = np.concatenate([[0], np.cumsum(mask)])
            return (s[ends - 1] - s[begins]) / np.maximum(of, 1)

        size = ends - 1 - begins
        letters = share((kind & (UPPER | LOWER)) > 0, 1)
        space = (c == 32) | (c == 10) | (c == 9) | (c == 0)
        h, at = word_hashes(chunk)
        n = np.diff(at)
        inside = share((kind & WORD) > 0, 1)
        line = c == 10
        line[ends - 1] = True
        stops = np.flatnonzero(line)
        starts = np.concatenate([[0], stops[:-1] + 1])
        full = stops > starts
        lines = run_hashes(c, starts[full], stops[full])
        line_at = np.searchsorted(starts[full], np.append(begins, len(c)))
        tri = window_hashes(h, 3)
        rows = out[a:b]
        rows[:, 0], rows[:, 1] = np.log1p(n), inside / np.maximum(n, 1)
        rows[:, 2], rows[:, 3] = share((kind & UPPER) > 0, letters), share((kind & DIGIT) > 0, size)
        rows[:, 4] = share(((kind & WORD) == 0) & ~space, size)
        rows[:, 11] = share((c == ord(".")), n)
        rows[:, 12], rows[:, 13] = share(c == ord("|"), n), share((c == ord("!")), n)
        for k, (i, j) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
            if j > i:
                w = np.sort(h[i:j])
                edge = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1], [True]]))
                rows[k, 5], rows[k, 6] = (len(edge) - 1) / (j - i), np.diff(edge).max() / (j - i)
                if j - i > 3:
                    t = np.sort(tri[i : j - 2])
                    rows[k, 7] = (t[1:] == t[:-1]).sum() / len(t)
            i, j = int(line_at[k]), int(line_at[k + 1])
            rows[k, 8], rows[k, 10] = np.log1p(j - i), size[k] / max(1, j - i)
            if j - i > 1:
                t = np.sort(lines[i:j])
                rows[k, 9] = (t[1:] == t[:-1]).sum() / (j - i)
        rows[n == 0] = 0
    return out


def _best_split(g: np.ndarray, h: np.ndarray, damp: float) -> tuple[float, int]:
    """Gain and last left bin of the best cut of gradient and curvature sums."""
    if len(g) < 2:
        return 0.0, -1
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    total, weight = g.sum(), h.sum()
    gain = a * a / (b + damp) + (total - a) ** 2 / (weight - b + damp) - total * total / (weight + damp)
    k = int(gain.argmax())
    return float(gain[k]), k


def _tree(g: np.ndarray, h: np.ndarray, damp: float, depth: int = 2) -> np.ndarray:
    """Leaf values, bin by bin, of a shallow tree over ordered bins."""
    gain, k = _best_split(g, h, damp)
    if not depth or k < 0 or gain <= 1e-12:
        return np.full(len(g), g.sum() / (h.sum() + damp))
    return np.concatenate([_tree(g[: k + 1], h[: k + 1], damp, depth - 1), _tree(g[k + 1 :], h[k + 1 :], damp, depth - 1)])


def _grid_tree(g: np.ndarray, h: np.ndarray, damp: float) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree that cuts one axis and then each side on the other."""
    best, values = -1.0, np.zeros_like(g)
    for turn in (False, True):
        a, b = (g.T, h.T) if turn else (g, h)
        for k in range(len(a) - 1):
            v, gain = np.zeros_like(a), 0.0
            for rows in (slice(0, k + 1), slice(k + 1, None)):
                x, y = a[rows].sum(axis=0), b[rows].sum(axis=0)
                leaf = _tree(x, y, damp, 1)
                v[rows] = leaf
                gain += float((leaf * x).sum())
            if gain > best:
                best, values = gain, v.T if turn else v
    return best, values


class Gam:
    """edges (bin borders a feature), tables, and pairs with their tables."""

    def __init__(self, edges, tables, pairs, pair_tables, intercept):
        self.edges, self.tables, self.pairs, self.pair_tables, self.intercept = edges, tables, pairs, pair_tables, intercept

    @staticmethod
    def _bins(edges, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1) if len(edges) else np.zeros((len(x), 0), int)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pair_rounds: int = PAIR_ROUNDS, pairs: int = PAIRS, rate: float = RATE, damp: float = 5.0) -> Gam:
        """Newton boosting of the logistic loss, features in turn; deterministic.
        Without rows of both classes the model is a constant."""
        x, y = np.asarray(x, float), np.asarray(y, float)
        m = x.shape[1]
        edges = [np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS, method="lower")) if len(x) else np.zeros(0) for j in range(m)]
        tables = [np.zeros(len(e) + 1) for e in edges]
        p = float(np.clip((y.sum() + 0.5) / (len(y) + 1), 1e-3, 1 - 1e-3))
        intercept = float(np.log(p / (1 - p)))
        if not len(y) or y.min() == y.max():
            return cls(edges, tables, [], [], intercept)
        bins = cls._bins(edges, x)
        score = np.full(len(y), intercept)

        def slopes():
            q = 1 / (1 + np.exp(-score))
            return y - q, q * (1 - q)

        for _ in range(rounds):
            for j in range(m):
                g, h = slopes()
                step = rate * _tree(np.bincount(bins[:, j], g, len(tables[j])), np.bincount(bins[:, j], h, len(tables[j])), damp)
                tables[j] += step
                score += step[bins[:, j]]
        coarse = [(bins[:, j] * COARSE) // len(tables[j]) for j in range(m)]

        def grids(i, j):
            cell = coarse[i] * COARSE + coarse[j]
            g, h = slopes()
            return cell, *(np.bincount(cell, v, COARSE * COARSE).reshape(COARSE, COARSE) for v in (g, h))

        gains = []
        for i, j in itertools.combinations(range(m), 2):
            _, g, h = grids(i, j)
            gains.append((-_grid_tree(g, h, damp)[0], i, j))
        chosen = [(i, j) for _, i, j in sorted(gains)[:pairs]]
        pair_tables = [np.zeros((COARSE, COARSE)) for _ in chosen]
        for _ in range(pair_rounds):
            for (i, j), table in zip(chosen, pair_tables):
                cell, g, h = grids(i, j)
                step = rate * _grid_tree(g, h, damp)[1]
                table += step
                score += step.ravel()[cell]
        return cls(edges, tables, chosen, pair_tables, intercept)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of the positive class for each row."""
        bins = self._bins(self.edges, x)
        score = np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            score += table[bins[:, j]]
        for (i, j), table in zip(self.pairs, self.pair_tables):
            score += table[(bins[:, i] * COARSE) // len(self.tables[i]), (bins[:, j] * COARSE) // len(self.tables[j])]
        return 1 / (1 + np.exp(-score))


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Gam:
    """A model fitted on about `rows` labelled documents at most, chosen by a
    hash of doc_id. Null ids, texts and labels teach nothing; a document with
    several labels counts by the larger part (ties: good)."""
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    share = min(1.0, rows / max(1, labels.count()))
    picked = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")

    def run(batches):
        for batch in batches:
            x = features(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    # picked has about `rows` rows at any size of input, so it may be broadcast
    got = texts.join(F.broadcast(picked), "doc_id").select("doc_id", "quality", "text").mapInArrow(lean(run), "doc_id long, quality int, x array<double>").toArrow().to_pydict()
    order = sorted(range(len(got["doc_id"])), key=lambda k: (got["doc_id"][k], got["x"][k]))
    x = np.array([got["x"][k] for k in order], float).reshape(-1, len(FEATURES))
    return Gam.fit(x, np.array([got["quality"][k] for k in order], float))


def classify(docs: DataFrame, labels: DataFrame | None = None, model: Gam | None = None, cut: float = CUT) -> DataFrame:
    """(doc_id, quality, good) for every row of docs: the probability that
    the text is good, and whether it reaches `cut`.

    A null text or one without words has quality 0 and isn't good. Null
    doc_ids stay; equal rows are scored alike; other columns are ignored; an
    empty table gives no rows, and labels of one kind, or none, a constant score.
    """
    model = model or fit_quality(docs, labels)

    def run(batches):
        for batch in batches:
            x = features([t or "" for t in batch.column(1).to_pylist()])
            q = np.where(x[:, 0] > 0, model.predict(x), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(q), pa.array(q >= cut)], ["doc_id", "quality", "good"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, quality double, good boolean")
