"""Language identification by rank-order n-gram profiles.

A profile is the list of the most frequent 1- to 5-grams of letters, words
padded with a blank on either side. A document goes to the language with the
least out-of-place distance between its own profile and that language's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, mix64
from .textarray import ALPHA, classes, points

LONGEST, LENGTH, FARTHEST = 5, 300, 0.92
#: A document is rejected beyond the distance (in whole parts of 1 / PARTS, rounded up) that this share of the fitted documents of
#: its length keep to, and a margin more, where at least so many were fitted, though never as near as NEAR; else beyond FARTHEST alone.
SHARE, MARGIN, ENOUGH, NEAR, PARTS = 0.99, 0.1, 30, 0.6, 10_000
#: n-grams that a task gathers before it counts them, and different ones it holds before it hands their counts on.
GATHERED, HELD = 1 << 21, 1 << 20
_BITS = 12
_LOW, _FAR = (1 << _BITS) - 1, np.int64(1 << 62)


def gram_codes(text: str, longest: int = LONGEST) -> np.ndarray:
    """A 64-bit code for every n-gram of the whole text: its code points of 12
    bits each where they fit, and a hash of 62 bits, above all those, where one of its characters lies beyond."""
    c = points(f" {text.lower()} ")
    blank = (classes().take(c) & ALPHA) == 0
    keep = np.ones(len(c), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    c, blank = c[keep].astype(np.int64), blank[keep]
    if len(c) < 2:
        return np.zeros(0, np.int64)
    c[blank] = 32
    high = c >> _BITS > 0
    some = bool(high.any())
    before = np.concatenate([[0], np.cumsum(blank)])
    beyond = np.concatenate([[0], np.cumsum(high)])

    def coded(code: np.ndarray, full: np.ndarray, n: int) -> np.ndarray:
        """The code of n-grams, or the hash where one has a character beyond."""
        at = np.arange(len(code))
        far = beyond[at + n] > beyond[at]
        return np.where(far, (mix64(full) >> np.uint64(2)).astype(np.int64) | _FAR, code)

    code, full = c, c.astype(np.uint64)
    parts = [(coded(code, full, 1) if some else code)[~blank]]
    for n in range(2, min(longest, len(c)) + 1):
        code = (code[:-1] << _BITS) | (c[n - 1 :] & _LOW)
        whole = code
        if some:
            full = mix64(full[:-1] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) + c[n - 1 :].astype(np.uint64)
            whole = coded(code, full, n)
        at = np.arange(len(code))
        inner = before[at + n - 1] - before[at + 1]
        parts.append(whole[inner == 0] if n > 2 else whole)
    return np.concatenate(parts)


def ranked(codes: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The most frequent codes, most frequent first; ties by code."""
    found, counts = np.unique(codes, return_counts=True)
    top = counts.max(initial=0)
    order = (top - counts).astype(np.uint16 if top < 65536 else np.int64).argsort(kind="stable")
    return found[order[:length]]


def size_class(codes: np.ndarray) -> int:
    """Documents of like size: the logarithm of the number of n-grams, as short ones lie farther from any profile."""
    return int(np.log2(max(1, len(codes))))


class Profiles:
    """The profiles of all languages as one table of ranks."""

    def __init__(self, profiles: dict[str, list[int]], length: int = LENGTH):
        self.names, self.length = sorted(profiles), length
        self.limits: dict[int, float] = {}
        self.codes = np.unique(np.array([c for p in profiles.values() for c in p], np.int64))
        self.ranks = np.full((len(self.codes) + 1, len(self.names)), -1, np.int64)
        for j, name in enumerate(self.names):
            self.ranks[np.searchsorted(self.codes, np.array(profiles[name], np.int64)), j] = np.arange(len(profiles[name]))

    def accepts(self, codes: np.ndarray, distance: float, farthest: float) -> bool:
        """Whether a document at this distance from the nearest profile is in its language."""
        return distance <= min(farthest, self.limits.get(size_class(codes), farthest))

    def distances(self, codes: np.ndarray) -> np.ndarray:
        """Out-of-place distance to each language as a share of the largest possible; ones for a document without letters."""
        doc = ranked(codes, self.length)
        if not len(doc) or not len(self.codes):
            return np.ones(len(self.names))
        at = np.searchsorted(self.codes, doc)
        at[at == len(self.codes)] = 0
        at[self.codes[at] != doc] = len(self.codes)
        r = self.ranks[at]
        out = np.where(r < 0, self.length, np.abs(r - np.arange(len(doc))[:, None]))
        return out.sum(axis=0) / (self.length * len(doc))


class Counts:
    """How often each n-gram of a language was seen, in bounded memory: codes are gathered, then counted."""

    def __init__(self):
        self.loose: list[np.ndarray] = []
        self.waiting = self.last = 0
        self.sums: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, codes: np.ndarray) -> None:
        self.loose.append(codes)
        self.waiting += len(codes)
        if self.waiting >= GATHERED:
            self.settle()

    def settle(self) -> None:
        if self.waiting:
            found, n = np.unique(np.concatenate(self.loose), return_counts=True)
            self.sums.append((found, n.astype(np.int64)))
        self.loose, self.waiting = [], 0
        if sum(len(c) for c, _ in self.sums) > 2 * self.last:
            self.merged()

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        """Different codes and their counts."""
        if len(self.sums) > 1:
            codes, n = (np.concatenate(x) for x in zip(*self.sums))
            order = codes.argsort(kind="stable")
            codes, n = codes[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
            self.sums = [(codes[first], np.add.reduceat(n, first))]
        self.last = sum(len(c) for c, _ in self.sums)
        return self.sums[0] if self.sums else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def fit_profiles(docs: DataFrame, length: int = LENGTH) -> Profiles:
    """Profiles of the languages named in `lang`, from every document of each; so are the limits.
    Rows without lang or text teach nothing."""
    docs = docs.select("lang", "text").where("lang is not null and text is not null")

    def handed(held: dict[str, Counts]):
        for lang, counts in held.items():
            codes, n = counts.merged()
            for at in range(0, len(codes), 100_000):
                part = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes[part])), pa.array(codes[part]), pa.array(n[part])], ["lang", "gram", "n"])
        held.clear()

    def count(batches):
        held: dict[str, Counts] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(lang, Counts()).add(gram_codes(text))
            for counts in held.values():
                counts.settle()
            if sum(len(c) for counts in held.values() for c, _ in counts.sums) > HELD:
                yield from handed(held)
        yield from handed(held)

    totals = docs.mapInArrow(lean(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    profiles: dict[str, list[int]] = {}
    for r in totals.withColumn("rank", rank).where(F.col("rank") <= length).orderBy("lang", "rank").collect():
        profiles.setdefault(r["lang"], []).append(r["gram"])
    out = Profiles(profiles, length)
    if not profiles:
        return out

    def measure(batches):
        """Documents by size and distance: one row for each that was seen."""
        seen: dict[tuple[int, int], int] = {}
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if len(c := gram_codes(t)):
                    key = size_class(c), int(np.ceil(out.distances(c).min() * PARTS - 1e-6))
                    seen[key] = seen.get(key, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen], pa.int32()), pa.array([x for _, x in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], ["size", "far", "n"])

    far = docs.select("text").mapInArrow(lean(measure), "size int, far int, n long").groupBy("size", "far").agg(F.sum("n").alias("n"))
    sizes: dict[int, list[tuple[int, int]]] = {}
    for r in far.orderBy(F.desc("size"), "far").collect():
        sizes.setdefault(r["size"], []).append((r["far"], r["n"]))
    limit = NEAR
    for size, rows in sizes.items():  # from the longest on: a shorter text may always lie as far
        upto = np.cumsum([n for _, n in rows])
        if upto[-1] >= ENOUGH:
            limit = max(limit, rows[int(np.searchsorted(upto, SHARE * upto[-1]))][0] / PARTS + MARGIN)
            out.limits[size] = limit
    return out


def identify(docs: DataFrame, profiles: Profiles | None = None, farthest: float = FARTHEST) -> DataFrame:
    """(doc_id, language, distance, accepted) for every row of docs.

    `language` is the nearest profile (ties: first by name). A row is not
    accepted, and its language is "und", if its text is null or has no letter,
    or if even the nearest profile is farther than `farthest` (a share of the
    largest possible distance), or than documents of its size that were fitted (see SHARE). Null doc_ids are kept as they are; each of
    several equal rows gets its own row; other columns are ignored; an empty table gives no rows.
    """
    profiles = profiles or fit_profiles(docs)

    def label(batches):
        for batch in batches:
            names, far = [], []
            for text in batch.column(1).to_pylist():
                codes = gram_codes(text or "")
                d = profiles.distances(codes)
                best = int(d.argmin()) if len(d) else -1
                ok = best >= 0 and len(codes) > 0 and profiles.accepts(codes, d[best], farthest)
                names.append(profiles.names[best] if ok else "und")
                far.append(float(d[best]) if best >= 0 else 1.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(far, pa.float64()), pa.array([n != "und" for n in names], pa.bool_())], ["doc_id", "language", "distance", "accepted"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(label), "doc_id long, language string, distance double, accepted boolean")


def keep_known_languages(docs: DataFrame, profiles: Profiles | None = None, farthest: float = FARTHEST) -> DataFrame:
    """The rows of docs whose language :func:`identify` accepts, all columns: rows with a null text, or
    one without letters, go, as nothing can be said of them. Nulls in other columns don't matter; equal rows all
    stay or all go; an empty table gives no rows."""
    profiles = profiles or fit_profiles(docs)

    def known(batches):
        for batch in batches:
            keep = [bool(len(c) and len(d := profiles.distances(c)) and profiles.accepts(c, d.min(), farthest)) for t in batch.column("text").to_pylist() for c in (gram_codes(t or ""),)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(lean(known), docs.schema)
