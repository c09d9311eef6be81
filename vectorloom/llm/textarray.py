"""Texts as arrays of code points: words, their hashes and their kinds for a
whole batch at a time, without a Python object for each word."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .common import mix64

WORD, ALPHA, DIGIT, UPPER, LOWER, STOP, SEP, APOS = (1 << k for k in range(8))
#: Characters handled at once; longer batches go in several parts, cut between texts.
PART = 500_000


@lru_cache(1)
def classes() -> np.ndarray:
    """The kinds of every code point, as bits."""
    out = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if c.isalnum():
            out[i] = WORD | (ALPHA if c.isalpha() else DIGIT if c.isdecimal() else 0) | (UPPER if c.isupper() else LOWER if c.islower() else 0)
    out[ord("_")] |= WORD
    for marks, bit in ((".!?\n:;", STOP), (".,:/", SEP), ("'’", APOS)):
        for c in marks:
            out[ord(c)] |= bit
    return out


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64; extended on demand by :func:`powers`."""
    p = np.uint64(0xD6E8FEB86659FD93)
    q = np.uint64(pow(int(p), -1, 1 << 64))
    n = 1 << 20
    out = []
    for x in (p, q):
        a = np.ones(n, np.uint64)
        a[1:] = x
        out.append(np.multiply.accumulate(a))
    return tuple(out)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers()
    while len(up) < n:
        up, down = (np.concatenate([a, a * (a[-1:] * a[1])]) for a in (up, down))
    return up[:n], down[:n]


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def parts(texts: list[str], size: int = PART):
    """Ranges of texts of about `size` characters; a longer text is alone."""
    at, n = 0, 0
    for k, t in enumerate(texts):
        if n and n + len(t) > size:
            yield at, k
            at, n = k, 0
        n += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def run_hashes(c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each run of code points."""
    up, down = powers(len(c) + 1)
    sums = np.zeros(len(c) + 1, np.uint64)
    x = c.astype(np.uint64) + np.uint64(0x51)
    np.cumsum(x * x * x * up[:-1], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words (runs of letters, digits and "_"), and
    where each text's words begin, with the end."""
    joined = "\0".join([t.lower() for t in texts]) + "\0"
    c = points(joined)
    word = (classes().take(c) & WORD).view(bool)
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if len(word) and word[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[::2], edge[1::2]
    stops = np.flatnonzero(c == 0)
    if len(stops) != len(texts):  # a text holds the separator itself
        lengths = np.array([len(t.lower()) for t in texts])
        stops = np.cumsum(lengths + 1) - 1
    return run_hashes(c, starts, ends), np.concatenate([[0], np.searchsorted(starts, stops)])
