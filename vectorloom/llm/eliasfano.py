"""Elias-Fano sequences over memory-mapped words, queried for many keys at once."""

from __future__ import annotations

import json
import os

import numpy as np

_U = np.uint64


def _select(words: np.ndarray, before: np.ndarray, k: np.ndarray, ones: bool) -> np.ndarray:
    """Position of the k-th (from 0) set or unset bit; before[w] counts such
    bits in the words before w."""
    at = np.searchsorted(before, k, "right") - 1
    w = words[at] if ones else ~words[at]
    r = (k - before[at]).astype(np.int64)
    out = at.astype(np.int64) << 6
    for s in (32, 16, 8, 4, 2, 1):
        c = np.bitwise_count(w & _U((1 << s) - 1)).astype(np.int64)
        go = r >= c
        r -= np.where(go, c, 0)
        w = np.where(go, w >> _U(s), w)
        out += s * go
    return out


class EliasFano:
    """A non-decreasing sequence: unary high parts, packed low bits."""

    PARTS = ("shape", "low", "high", "ones", "zeros")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.low, self.high, self.ones, self.zeros = (arrays[k] for k in self.PARTS[1:])
        self.n, self.bits, self.top = (int(x) for x in arrays["shape"])
        self.mask = _U((1 << self.bits) - 1)

    @classmethod
    def encode(cls, values: np.ndarray) -> dict[str, np.ndarray]:
        v = np.asarray(values).astype(np.uint64)
        n = len(v)
        bits = max(0, int(np.floor(np.log2((int(v[-1]) + 1) / n)))) if n else 0
        top = int(v[-1]) >> bits if n else 0
        place = (v >> _U(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((n + top) // 64 + 2, np.uint64)
        np.bitwise_or.at(high, place >> 6, _U(1) << (place & 63).astype(np.uint64))
        low = np.zeros(n * bits // 64 + 2, np.uint64)
        if bits:
            x, start = v & _U((1 << bits) - 1), np.arange(n) * bits
            off = (start & 63).astype(np.uint64)
            np.bitwise_or.at(low, start >> 6, x << off)
            over = off + _U(bits) > _U(64)
            np.bitwise_or.at(low, (start[over] >> 6) + 1, x[over] >> (_U(64) - off[over]))
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high).astype(np.int64))[:-1]])
        return dict(zip(cls.PARTS, (np.array([n, bits, top]), low, high, ones, np.arange(len(high)) * 64 - ones)))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        start = i * self.bits
        w, off = start >> 6, (start & 63).astype(np.uint64)
        upper = np.where(off > 0, self.low[w + 1] << ((_U(64) - off) & _U(63)), _U(0))
        return ((self.low[w] >> off) | upper) & self.mask

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        """The values at positions i."""
        i = np.asarray(i, np.int64)
        high = _select(self.high, self.ones, i, True) - i
        return (high << self.bits) + self._low(i).astype(np.int64)

    def find(self, x: np.ndarray) -> np.ndarray:
        """First position of each value x, or -1."""
        x = np.asarray(x, np.int64)
        h = x >> self.bits
        inside = (x >= 0) & (h <= self.top)
        out = np.full(len(x), -1, np.int64)
        if not self.n or not inside.any():
            return out
        todo = np.flatnonzero(inside)
        h = h[todo]
        bit = np.zeros(len(h), np.int64)
        later = h > 0
        bit[later] = _select(self.high, self.zeros, h[later] - 1, False) + 1
        at = bit - h
        # the bucket ends at the next unset bit, most often in the same word
        w = ~self.high[bit >> 6] >> (bit & 63).astype(np.uint64)
        end = at + np.bitwise_count((w & (~w + _U(1))) - _U(1))
        far = w == 0
        end[far] = _select(self.high, self.zeros, h[far], False) - h[far]
        want = x[todo].astype(np.uint64) & self.mask
        lo, hi, open_ = at, end.copy(), np.flatnonzero(at < end)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < want[open_]
            lo[open_[less]], hi[open_[~less]] = mid[less] + 1, mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        inside = np.flatnonzero(lo < end)
        hit = inside[self._low(lo[inside]) == want[inside]]
        out[todo[hit]] = lo[hit]
        return out


def write_arrays(path: str, arrays: dict[str, np.ndarray]) -> None:
    """Arrays in one file that can be mapped; written whole or not at all."""
    head, at = {}, 0
    for k, a in arrays.items():
        head[k] = (a.dtype.str, len(a), at)
        at += -(-a.nbytes // 64) * 64
    text = json.dumps(head).encode()
    start = -(-(len(text) + 8) // 64) * 64
    part = f"{path}.{os.getpid()}.part"
    with open(part, "wb") as f:
        f.write(len(text).to_bytes(8, "little") + text)
        for k, a in arrays.items():
            f.seek(start + head[k][2])
            f.write(np.ascontiguousarray(a).tobytes())
        f.truncate(max(f.tell(), start))
    os.replace(part, path)


def map_arrays(path: str) -> dict[str, np.ndarray]:
    """The arrays of :func:`write_arrays`, memory-mapped."""
    with open(path, "rb") as f:
        n = int.from_bytes(f.read(8), "little")
        head = json.loads(f.read(n))
    start = -(-(n + 8) // 64) * 64
    # one mapping a file, however many arrays it has
    raw = np.memmap(path, np.uint8, "r").view(np.ndarray)
    out = {}
    for k, (t, size, at) in head.items():
        kind = np.dtype(t)
        out[k] = raw[start + at : start + at + size * kind.itemsize].view(kind)
    return out


def nested(name: str, arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {f"{name}.{k}": a for k, a in arrays.items()}


def unnested(name: str, arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {k[len(name) + 1 :]: a for k, a in arrays.items() if k.startswith(name + ".")}
