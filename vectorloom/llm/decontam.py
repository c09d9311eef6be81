"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders. Windows of such templates
are hash-joined between documents and benchmark items; what an item repeats
must then mostly be repeated in the document too, so that a question with other
numbers or names is found and a chance mixture isn't.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lean, mix64, small, window_hashes
from .textarray import ALPHA, APOS, DIGIT, SEP, STOP, UPPER, classes, parts, points, run_hashes, word_hashes

WIDTH, COVERAGE, ENOUGH = 8, 0.5, 20
_UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t ton tons tonne tonnes lb lbs oz pound pounds ounce ounces ml cl l liter liters litre litres gallon gallons "
    "s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years meter meters metre metres kilometer kilometers kilometre kilometres "
    "gram grams kilogram kilograms degree degrees percent dollar dollars euro euros cent cents usd eur mph kph hz khz mhz ghz w kw mw v kb mb gb tb".split()
)
_NUMBERS = frozenset("two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
_WORD, _TITLE, _NUMBER, _UNIT = range(4)
#: What a window is compared by: names inside sentences as slots, those that begin one too, or every token itself in lower case.
_INNER, _ALL, _PLAIN = range(3)
_KINDS = {_TITLE: "name", _NUMBER: "number", _UNIT: "unit"}


@lru_cache(1)
def _listed() -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.sort(word_hashes([" ".join(sorted(x))])[0]) for x in (_UNITS, _NUMBERS))


def _among(h: np.ndarray, listed: np.ndarray) -> np.ndarray:
    return listed[np.minimum(np.searchsorted(listed, h), len(listed) - 1)] == h


class Tokens:
    """The tokens of a batch of texts: runs of letters (apostrophes between
    letters included) and numbers (with their separators)."""

    def __init__(self, texts: list[str]):
        lengths = np.array([len(t) for t in texts], np.int64)
        self.text = "\0".join(texts) + "\0"
        c = points(self.text)
        stops = np.cumsum(lengths + 1) - 1
        bits = classes().take(c)
        bits[stops] = STOP
        alpha, digit = (bits & ALPHA).astype(bool), (bits & DIGIT).astype(bool)
        inner = np.zeros(len(c), bool)
        inner[1:-1] = (bits[1:-1] & APOS).astype(bool) & alpha[:-2] & alpha[2:]
        alpha |= inner
        inner[1:-1] = (bits[1:-1] & SEP).astype(bool) & digit[:-2] & digit[2:]
        digit |= inner
        kind = alpha + 2 * digit.astype(np.uint8)
        edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
        starts = np.concatenate([[0], edge]) if len(c) else edge
        ends = np.concatenate([edge, [len(c)]]) if len(c) else edge
        real = kind[starts] > 0
        starts, ends = starts[real], ends[real]
        low = np.frombuffer("".join([x if len(x := ch.lower()) == 1 else ch for ch in map(chr, range(0x500))]).encode("utf-32-le"), np.uint32)
        h = run_hashes(np.where(c < 0x500, low.take(np.minimum(c, 0x4FF)), c), starts, ends)
        upper = np.concatenate([[0], np.cumsum((bits & UPPER).astype(bool))])
        broken = np.concatenate([[0], np.cumsum((bits & STOP).astype(bool) & (kind == 0))])
        text_of = np.searchsorted(stops, starts)
        before = np.concatenate([[0], ends[:-1]])
        fresh = broken[starts] > broken[before] if len(starts) else np.zeros(0, bool)
        fresh[:1] = True
        self.title = (upper[ends] - upper[starts] == 1) & (bits[starts] & UPPER).astype(bool) & (ends - starts > 1)
        self.starts, self.ends, self.hash, self.fresh, self.digits, self.text_of, self.texts = starts, ends, h, fresh, kind[starts] == 2, text_of, len(texts)


class Templates:
    """The template places of tokens by a scheme: hash, kind, and where the
    text that fills each begins and ends. at[i]:at[i + 1] are the places of text i.

    A capitalised word is a name, by _INNER only unless it begins a sentence; a unit is
    one only after a number; names in a row are one place. By _PLAIN every token is a word."""

    def __init__(self, t: Tokens, scheme: int = _INNER):
        self.text, self.scheme = t.text, scheme
        starts, ends, h, fresh, text_of = t.starts, t.ends, t.hash, t.fresh, t.text_of
        if scheme == _PLAIN:
            self.kind, self.starts, self.ends, self.hash = np.full(len(starts), _WORD, np.uint8), starts, ends, h
            self.at = np.searchsorted(text_of, np.arange(t.texts + 1))
            self.words = np.concatenate([[0], np.cumsum(~t.digits)])
            return
        units, numbers = _listed()
        out = np.full(len(starts), _WORD, np.uint8)
        out[t.title & ~fresh if scheme == _INNER else t.title] = _TITLE
        out[t.digits | _among(h, numbers)] = _NUMBER
        after = np.concatenate([[False], (out[:-1] == _NUMBER) & ~fresh[1:]]) if len(out) else np.zeros(0, bool)
        out[_among(h, units) & after] = _UNIT
        again = np.concatenate([[False], (out[1:] == _TITLE) & (out[:-1] == _TITLE) & ~fresh[1:]]) if len(out) else np.zeros(0, bool)
        keep = np.flatnonzero(~again)
        last = np.append(keep[1:], len(starts))[: len(keep)] - 1
        self.kind, self.starts, self.ends = out[keep], starts[keep], ends[last]
        self.hash = np.where(self.kind == _WORD, h[keep], self.kind.astype(np.uint64))
        self.at = np.searchsorted(text_of[keep], np.arange(t.texts + 1))
        self.words = np.concatenate([[0], np.cumsum(self.kind == _WORD)])

    def windows(self, width: int, full: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """The first place of each window of `width` places inside one text
        that words fill at least half, and its hash. By _PLAIN any window will do, but one that
        isn't of full width has to hold a word."""
        least = (width + 1) // 2 if self.scheme != _PLAIN else 0 if full else 1
        h = window_hashes(self.hash, width)
        n = np.arange(len(h))
        text = np.searchsorted(self.at, n, "right")
        good = np.flatnonzero((n + width <= self.at[np.minimum(text, len(self.at) - 1)]) & (self.words[n + width] - self.words[n] >= least))
        return good, h[good] + np.uint64(width + (self.scheme << 32))

    def slots(self, at: int, width: int) -> list[str]:
        """What fills the placeholders of a window, each with its place in the window and its kind."""
        return [f"{k - at} {_KINDS[self.kind[k]]}={self.text[self.starts[k] : self.ends[k]].lower()}" for k in range(at, at + width) if self.kind[k] in _KINDS]


_SCHEMA = "id long, pos int, hash long, slots array<string>, total int, scheme int"


def _rows(t: Templates, ids: list[int], at: np.ndarray, h: np.ndarray, width: int, total=None) -> list[tuple]:
    text = np.searchsorted(t.at, at, "right") - 1
    return [(ids[i], p - int(t.at[i]), x, t.slots(p, width), 0 if total is None else total, t.scheme) for i, p, x in zip(text.tolist(), at.tolist(), h.view(np.int64).tolist())]


def _bench_windows(width: int):
    def run(batches):
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = Tokens([text])
                for scheme in (_INNER, _ALL, _PLAIN):
                    t = Templates(tokens, scheme)
                    if n := min(width, len(t.kind)):
                        at, h = t.windows(n, n == width)
                        rows += _rows(t, [i], at, h, n, len(at))
            yield _table(rows)

    return run


def _table(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 6
    types = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], ["id", "pos", "hash", "slots", "total", "scheme"])


def _doc_windows(widths: dict[int, list[int]], width: int, bits: np.ndarray):
    mask = np.uint64(len(bits) * 8 - 1)

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in parts(texts):
                tokens, rows = Tokens(texts[a:b]), []
                for scheme, some in widths.items():
                    t = Templates(tokens, scheme)
                    for w in some:
                        place, h = t.windows(w, w == width)
                        at = mix64(h) & mask
                        hit = np.flatnonzero((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1)
                        rows += _rows(t, ids[a:b], place[hit], h[hit], w)
                yield _table(rows)

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, coverage: float = COVERAGE, enough: int = ENOUGH) -> DataFrame:
    """(doc_id, item_id, windows, coverage, kind) of each document that
    repeats an item, wholly or in part.

    An item's template windows have `width` places, at least half of them
    words; an item with fewer places is one window, and one of placeholders
    alone can't be matched. Templates are made twice, without and with names that begin sentences as slots,
    and windows of tokens as they are, in lower case, are compared too; each of the three is counted for itself. A document is named if its windows, at whatever offsets, cover
    a share `coverage` of the item's windows, or those at one offset `enough` windows. Windows with
    other fillings count as :func:`_counted` says. `kind` is "verbatim" if every covered window is there with
    equal fillings and "reparameterised" if not. Rows with a null id or text take no part; equal rows
    count once; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null and text is not null")
    bench = benchmark.select(F.col("item_id").cast("long"), "text").where("item_id is not null and text is not null")
    items = cut(bench.mapInArrow(_bench_windows(width), _SCHEMA).distinct())
    # A bitmap of the items' hashes spares documents' windows the join; when it fills up only the join gets larger.
    n = items.count()
    size = 1 << min(27, max(16, (16 * n).bit_length()))

    def mark(batches):
        b = np.zeros(size >> 3, np.uint8)
        for batch in batches:
            at = mix64(batch.column(0).to_numpy().view(np.uint64)) & np.uint64(size - 1)
            np.bitwise_or.at(b, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([b.tobytes()], pa.binary())], ["b"])

    marks = items.select("hash").distinct().coalesce(4).mapInArrow(mark, "b binary").collect()
    bits = np.bitwise_or.reduce([np.frombuffer(r["b"], np.uint8) for r in marks] or [np.zeros(size >> 3, np.uint8)])
    short = bench.mapInArrow(_lengths(width), "scheme int, n int").distinct().collect()
    widths = {k: sorted({r["n"] for r in short if r["n"] and r["scheme"] == k}) for k in (_INNER, _ALL, _PLAIN)}
    hits = docs.mapInArrow(lean(_doc_windows(widths, width, bits)), _SCHEMA).select(F.col("id").alias("doc_id"), F.col("pos").alias("doc_pos"), "hash", F.col("slots").alias("doc_slots"))
    keys = items.select(F.col("id").alias("item_id"), F.col("pos").alias("item_pos"), "hash", F.col("slots").alias("item_slots"), "total", "scheme")
    met = cut(hits.join(small(keys, n, 100_000), "hash").withColumn("shift", F.col("doc_pos") - F.col("item_pos")).drop("hash").distinct())
    pair, needed = ["doc_id", "item_id"], F.ceil(F.col("total") * coverage)
    likely = met.groupBy(*pair, "scheme", "total").agg(F.countDistinct("item_pos").alias("windows")).where((F.col("windows") >= needed) | (F.col("windows") >= enough)).select(*pair).distinct()
    return met.join(likely, pair, "left_semi").groupBy(*pair).applyInArrow(_judge(coverage, enough), _FOUND)


def _counted(places: list[tuple[int, list[str], list[str]]]) -> list[tuple[int, bool]]:
    """(item_pos, verbatim) of the windows (item_pos, item_slots, doc_slots) at one offset
    that count. Those whose fillings are all equal do. The others do if at least half of the slots whose
    filling the item repeats are filled by what most of its repetitions are filled by; if fewer
    are, only windows without a slot that departs from that do."""
    slots: dict[int, tuple[str, str]] = {}
    for p, xs, ys in places:
        for x, y in zip(xs, ys):
            (at, x), y = x.split(" ", 1), y.split(" ", 1)[1]
            slots[p + int(at)] = x, y
    votes: dict[str, Counter] = {}
    for x, y in slots.values():
        votes.setdefault(x, Counter())[y] += 1
    usual = {x: min(v, key=lambda y: (-v[y], y)) for x, v in votes.items()}
    repeated = sum(n for v in votes.values() if (n := v.total()) > 1)
    agreed = sum(v[usual[x]] for x, v in votes.items() if v.total() > 1)
    bad = set() if 2 * agreed >= repeated else {p for p, (x, y) in slots.items() if usual[x] != y}
    return [(p, xs == ys) for p, xs, ys in places if xs == ys or not any(p + int(x.split(" ", 1)[0]) in bad for x in xs)]


_FOUND = "doc_id long, item_id long, windows int, coverage double, kind string"


def _judge(coverage: float, enough: int):
    """For all windows that a document and an item share: whether they are a copy."""

    def run(t: pa.Table) -> pa.Table:
        offsets: dict[tuple[tuple[int, int], int], list] = {}
        for scheme, total, shift, p, x, y in zip(*[t.column(c).to_pylist() for c in ("scheme", "total", "shift", "item_pos", "item_slots", "doc_slots")]):
            offsets.setdefault(((scheme, total), shift), []).append((p, x, y))
        covered: dict[tuple[int, int], dict[int, bool]] = {}
        most: Counter = Counter()
        for (of, _), places in offsets.items():
            counted, seen = _counted(places), covered.setdefault(of, {})
            most[of] = max(most[of], len({p for p, _ in counted}))
            for p, same in counted:
                seen[p] = seen.get(p, False) or same
        out = [(len(c), len(c) / of[1], all(c.values())) for of, c in covered.items() if len(c) >= math.ceil(of[1] * coverage) or most[of] >= enough]
        rows = [(t.column("doc_id")[0].as_py(), t.column("item_id")[0].as_py(), max(w for w, _, _ in out), max(c for _, c, _ in out), "verbatim" if all(v for *_, v in out) else "reparameterised")] if out else []
        types = (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.string())
        return pa.table([pa.array([r[k] for r in rows], x) for k, x in enumerate(types)], names=[c.split()[0] for c in _FOUND.split(", ")])

    return run


def _lengths(width: int):
    def run(batches):
        for batch in batches:
            found = [(k, min(width, len(Templates(tokens, k).kind))) for t in batch.column(1).to_pylist() for tokens in (Tokens([t]),) for k in (_INNER, _ALL, _PLAIN)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([n for _, n in found], pa.int32())], ["scheme", "n"])

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The rows of docs, all columns, whose doc_id :func:`contaminated`
    doesn't name; rows that can't be compared are kept."""
    gone = cut(contaminated(docs, benchmark, **settings).select(F.col("doc_id").alias("_gone")).distinct())
    return docs.join(small(gone, gone.count()), docs["doc_id"].cast("long") == gone["_gone"], "left_anti")
