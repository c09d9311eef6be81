"""Personal data and secrets: a character-level bidirectional LSTM with CRF
transitions, trained in numpy from labelled spans.

Every character of a text runs through the network, in overlapping windows; where
windows overlap their emissions are averaged, and one Viterbi path is found for the
whole document. Which kinds hold which characters is learned, not built in.
"""

from __future__ import annotations

import string
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import network
from .common import lean
from .textarray import parts

KINDS = ("EMAIL", "PHONE", "IP", "CARD", "SECRET", "SSN", "IBAN")
WINDOW, STEP, HIDDEN, EMBED, STEPS, SEQUENCES, LENGTH = 1024, 960, 24, 16, 720, 10000, 72
#: Characters whose emissions are held at once; a longer text is alone.
PART = 500_000
#: Marks of the end that a window is read with, as texts are in training.
PADDING = 8
#: More than two sums of the same products differ by a character.
ROUNDING = 1e-3
_ASCII = {c: i + 1 for i, c in enumerate(string.printable)}
_OTHER = ("lower", "upper", "digit", "space", "sign")
CHARS = 1 + len(_ASCII) + len(_OTHER)
TAGS = 1 + 2 * len(KINDS)
#: The class of no character, that parts the sequences of a row.
CLOSED = CHARS
#: Columns of the scores of first characters, and of those of later ones.
SIDE = 1 + len(KINDS)


def _code(c: str) -> int:
    if c in _ASCII:
        return _ASCII[c]
    k = "digit" if c.isdigit() else "upper" if c.isupper() else "lower" if c.isalpha() else "space" if c.isspace() else "sign"
    return 1 + len(_ASCII) + _OTHER.index(k)


_TABLE = np.array([_code(chr(i)) for i in range(0x3000)], np.int16)


def encode(text: str) -> np.ndarray:
    """A class for every character; 0 is padding."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(c < len(_TABLE), _TABLE[np.minimum(c, len(_TABLE) - 1)], _code("あ"))


# --- labelled spans for training ---


class Examples:
    """Generator of texts with labelled spans: invented prose in the letters
    of several languages, personal data in many forms, and harmless numbers."""

    def __init__(self, seed: int = 8):
        self.rng = np.random.Generator(np.random.Philox(seed))

    def pick(self, x):
        return x[self.rng.integers(len(x))]

    def digits(self, n: int) -> str:
        return "".join(self.pick(string.digits) for _ in range(n))

    def word(self) -> str:
        parts = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve é è ê ç eau aux ment ción ñ í ó sch ung keit ü ö ä ß lich ein pf".split()
        return "".join(self.pick(parts) for _ in range(self.rng.integers(1, 5)))

    def name(self) -> str:
        return "".join(self.pick(string.ascii_lowercase) for _ in range(self.rng.integers(2, 10)))

    def email(self) -> str:
        r = self.rng.integers
        user = self.name() + self.pick(["", "." + self.name(), "." + self.digits(2), "_" + self.digits(r(1, 4)), self.digits(r(1, 4)), "+" + self.name(), "-" + self.name()])
        host = self.pick([self.name(), self.name() + self.digits(1), self.name() + self.digits(1) + "." + self.name(), "mail" + self.digits(1) + ".example"])
        return f"{user}@{host}.{self.pick(['com', 'org', 'net', 'de', 'fr', 'es', 'io', 'co.uk', 'edu'])}"

    def phone(self) -> str:
        d = self.digits
        return self.pick([
            f"+1 ({d(3)}) {d(3)}-{d(4)}", f"+1 ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"+1-{d(3)}-{d(3)}-{d(4)}", f"+1 {d(3)} {d(3)} {d(4)}",
            f"+{d(2)} {d(3)} {d(3)} {d(3)}", f"+{d(2)} {d(2)} {d(4)} {d(4)}", f"+{d(2)}{d(9)}", f"{d(3)}.{d(3)}.{d(4)}", f"+{d(2)} {d(3)} {d(7)}",
        ])

    def ip(self) -> str:
        if self.rng.random() < 0.3:
            h = lambda: "".join(self.pick("0123456789abcdef") for _ in range(self.rng.integers(1, 5)))
            return self.pick([":".join(h() for _ in range(8)), f"{h()}:{h()}::{h()}", f"{h()}:{h()}:{h()}::{h()}:{h()}", f"fe80::{h()}:{h()}", f"2001:db8::{h()}:{h()}"])
        return ".".join(str(self.rng.integers(1, 256)) for _ in range(4))

    def card(self) -> str:
        a = "45"[self.rng.integers(2)] + self.digits(15)
        return self.pick([a, a, a, " ".join(a[i : i + 4] for i in range(0, 16, 4)), " ".join(a[i : i + 4] for i in range(0, 16, 4)), "-".join(a[i : i + 4] for i in range(0, 16, 4)), self.pick("123678") + a[1:], "3" + a[:14]])

    def letters(self, alphabet: str, least: int, most: int) -> str:
        return "".join(self.pick(alphabet) for _ in range(self.rng.integers(least, most)))

    def secret(self) -> tuple[str, str]:
        """What stands before the secret, and the secret."""
        some, lower, letters = string.ascii_letters + string.digits, string.ascii_lowercase, string.ascii_letters
        hexes, upper = self.letters("0123456789abcdef", 16, 44), self.letters(string.ascii_uppercase + string.digits, 16, 17)
        mixed = self.letters(self.pick([some, some, lower, letters, lower + string.digits]), 20, 40)
        key = self.pick(["token", "api_key", "secret", "password", "passwd", "key", "auth", "apikey", "access_token"])
        word = self.pick([self.word() + self.word() + self.word(), self.letters(lower, 9, 22), self.letters(some, 8, 24), self.word() + self.digits(3) + self.pick("!#$")])[:30].replace(" ", "")
        return self.pick([
            ("", "AKIA" + upper), ("", "AKIA" + upper), (f'{key} = "', hexes), ('token = "', hexes), (f"{key}=", hexes), ("password=", hexes[:18]), (f"{key}: ", hexes), ("", "sk-" + mixed), ("", "ghp_" + mixed),
            (f"{key}=", word), ("password=", word), (f'{key} = "', word), (f"{key}: ", mixed), ("", "sk-" + self.letters(lower, 22, 34)), ("", "xoxb-" + self.digits(11) + "-" + mixed[:20]), ("Bearer ", mixed + "." + mixed[:20]),
        ])

    def ssn(self) -> tuple[str, str]:
        d = self.digits
        return self.pick(["", "", "SSN ", "SSN: ", "ssn "]), f"{d(3)}-{d(2)}-{d(4)}"

    def iban(self) -> tuple[str, str]:
        land = self.pick(["DE", "FR", "ES", "GB", "NL", "IT", "CH", "AT"])
        body = self.digits(2) + ("".join(self.pick(string.ascii_uppercase) for _ in range(4)) if land in ("GB", "NL") else "") + self.digits(int(self.rng.integers(14, 20)))
        x = land + body
        return self.pick(["", "", "IBAN ", "IBAN: "]), self.pick([x, " ".join(x[i : i + 4] for i in range(0, len(x), 4))])

    def harmless(self) -> str:
        d, r = self.digits, self.rng.integers
        return self.pick([
            f"{d(1)}.{d(1)}.", f"Version {d(1)}.{d(1)}.", f"version {d(1)}.", f"{d(1)}.{d(1)}.{d(1)}", str(r(1, 3000)), f"{d(2)}%", f"${d(3)}", f"{r(1, 13)}/{r(1, 29)}/{r(1900, 2030)}", f"{r(1900, 2030)}",
            f"{r(1900, 2030)}-{r(10, 13)}-{r(10, 29)}", f"{r(1, 24)}:{d(2)}", f"({r(1, 99)})", f"{d(1)},{d(3)}", f"{d(1)},{d(3)},{d(3)}", f"No. {d(r(1, 5))}", f"[{d(1)}]", f"{d(2)}-{d(2)}", f"{d(1)}th", "CC BY-NC 4.0.", "License, Version 2.0.", "version 3.", "@", f"@ {self.word()}",
            f"{d(1)}.{d(2)}", f"{d(3)} {self.word()}", f"{self.word()}{d(1)}", f"ISO {d(4)}", f"{d(5)}", f"ISBN 978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", f"ISBN {d(1)}-{d(3)}-{d(5)}-{d(1)}", f"order {r(1990, 2030)}-{r(10, 13)}-{r(10, 29)}-{d(4)}", f"{r(10, 29)}.{r(10, 13)}.{r(1900, 2030)}", f"{r(10, 29)}.0{r(1, 10)}.{r(1900, 2030)}", f"{r(1900, 2030)}-0{r(1, 10)}-{r(10, 29)}", f"v{d(1)}.{d(1)}.{d(1)}", f"{d(2)}:{d(2)}:{d(2)}", f"@{self.name()}", f"{self.name()}@", f"#{d(4)}", f"{d(4)}-{d(4)}",
            "password", "the password is", "token", "secret key", "api", "sk-" + self.name()[:6], f"key: {self.word()}", f"http://{self.name()}.org/{self.name()}", f"{self.name()}-{self.name()}", f"{self.name()}_{self.name()}", self.word() + self.word() + self.word(), self.letters(string.ascii_uppercase, 2, 9), f"{d(1)} {self.word()}", f"{d(10)}", f"pp. {d(3)}-{d(3)}", f"{d(1)}.{d(1)}.{d(1)}.", f"{d(2)} {self.word()} {d(4)}",
        ])

    def text(self) -> tuple[str, np.ndarray]:
        """A text and the tag of each character. Every third has no span."""
        out, tags = [], []

        def add(s: str, kind: int | None = None):
            if s:
                out.append(s)
                tags.extend([0] * len(s) if kind is None else [1 + 2 * kind] + [2 + 2 * kind] * (len(s) - 1))

        style, spans = self.rng.integers(6), 0.25 if self.rng.random() < 0.67 else 0.0
        for _ in range(self.rng.integers(3, 16)):
            roll = self.rng.random()
            if roll < spans:
                kind = int(self.rng.integers(len(KINDS)))
                if kind >= 4:
                    lead, s = (self.secret, self.ssn, self.iban)[kind - 4]()
                    add(lead)
                    add(s, kind)
                    add('"' if lead.endswith('"') else "")
                else:
                    add((self.email, self.phone, self.ip, self.card)[kind](), kind)
            elif roll < 0.42:
                add(self.harmless())
            else:
                w = self.word() + (self.word() if self.rng.random() < 0.2 else "")
                add(w.capitalize() if self.rng.random() < 0.15 else w)
            add(self.pick(["###", "$$$", "%%%", "&&&", "***", ",***", ".###"]) if style == 0 else self.pick(["!!", ".!!", ",!!"]) if style == 1 else self.pick(["", "", "", "", ",", ".", ";", ":", ")"]))
            add(" | " if style == 2 else self.pick([" ", " ", " ", " ", " ", "\n"]))
        s = "".join(out)
        if style == 1:
            s = "".join(c.upper() if len(c.upper()) == 1 else c for c in s)
        return s, np.array(tags, np.int8)

    def batch(self, n: int, length: int) -> tuple[np.ndarray, np.ndarray]:
        x, y = np.zeros((n, length), np.int16), np.zeros((n, length), np.int8)
        for i in range(n):
            s, t = self.text()
            at = int(self.rng.integers(0, max(1, len(s) - length // 2)))
            c = encode(s)[at : at + length]
            x[i, : len(c)], y[i, : len(c)] = c, t[at : at + length]
        for k in range(len(KINDS)):  # a window may begin inside a span
            first = y[:, 0] == 2 + 2 * k
            y[first, 0] = 1 + 2 * k
        return x, y


# --- the network ---


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _lstm(table, u, x, keep: bool):
    """One direction; x: classes (batch, time). With `keep`, what the way back needs too."""
    n, steps = x.shape
    size = u.shape[0]
    h, c = np.zeros((n, size), np.float32), np.zeros((n, size), np.float32)
    out, kept = np.empty((steps, n, size), np.float32), []
    for t in range(steps):
        z = table[x[:, t]] + h @ u
        g = np.tanh(z[:, 3 * size :])
        s = _sigmoid(z[:, : 3 * size])
        i, f, o = s[:, :size], s[:, size : 2 * size], s[:, 2 * size :]
        before, c = c, f * c + i * g
        e = np.tanh(c)
        h = o * e
        out[t] = h
        if keep:
            kept.append((i, f, o, g, before, e))
    return out, kept


def _lstm_back(u, out, kept, grad, x):
    """Gradients of the table of inputs and of u, from those of the outputs."""
    steps, n, size = out.shape
    du, dz_all = np.zeros_like(u), np.empty((steps, n, 4 * size), np.float32)
    dh, dc = np.zeros((n, size), np.float32), np.zeros((n, size), np.float32)
    for t in range(steps - 1, -1, -1):
        i, f, o, g, before, e = kept[t]
        dh = dh + grad[t]
        dc = dc + dh * o * (1 - e * e)
        dz = dz_all[t]
        dz[:, :size] = dc * g * i * (1 - i)
        dz[:, size : 2 * size] = dc * before * f * (1 - f)
        dz[:, 2 * size : 3 * size] = dh * e * o * (1 - o)
        dz[:, 3 * size :] = dc * i * (1 - g * g)
        if t:
            du += out[t - 1].T @ dz
        dh, dc = dz @ u.T, dc * f
    flat, classes = dz_all.reshape(-1, 4 * size), x.T.ravel()
    onehot = np.zeros((len(classes), CHARS), np.float32)
    onehot[np.arange(len(classes)), classes] = 1
    return onehot.T @ flat, du


def _allowed() -> np.ndarray:
    """Transitions of the BIO scheme: I- only after B- or I- of its kind."""
    ok = np.ones((TAGS, TAGS), bool)
    for k in range(len(KINDS)):
        ok[:, 2 + 2 * k] = False
        ok[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True
    return ok


_FORBIDDEN = np.where(_allowed(), 0, -1e4).astype(np.float32)


#: Padding is never part of a span; nothing else is barred.
_BARRED = np.zeros((CHARS, TAGS), np.float32)
_BARRED[0, 1:] = -1e4
_START = np.array([0] + [0, -1e4] * len(KINDS), np.float32)


class Tagger:
    """Weights: e (embedding), w/u/b of both directions, v/d (emissions), a (transitions)."""

    def __init__(self, seed: int = 8, hidden: int = HIDDEN, embed: int = EMBED):
        rng = np.random.Generator(np.random.Philox(seed))

        def normal(*s):
            return (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)

        self.hidden, self._run = hidden, None
        self.p = {"e": normal(CHARS, embed) * 4, "v": normal(2 * hidden, TAGS), "d": np.zeros(TAGS, np.float32), "a": np.zeros((TAGS, TAGS), np.float32)}
        for k in "fb":
            b = np.zeros(4 * hidden, np.float32)
            b[hidden : 2 * hidden] = 1
            self.p |= {f"w{k}": normal(embed, 4 * hidden), f"u{k}": normal(hidden, 4 * hidden), f"b{k}": b}

    def emissions(self, x: np.ndarray, keep: bool = False):
        """(time, batch, tags) for classes (batch, time)."""
        p = self.p
        f, kf = _lstm(p["e"] @ p["wf"] + p["bf"], p["uf"], x, keep)
        b, kb = _lstm(p["e"] @ p["wb"] + p["bb"], p["ub"], x[:, ::-1], keep)
        h = np.concatenate([f, b[::-1]], axis=2)
        return h @ p["v"] + p["d"], h, (f, kf, b, kb)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """(batch, time, 2 * SIDE) for classes (time, batch), by a compiled runtime that takes the trained weights: the emissions of no span, then how far
        those of each kind's B- are above, then a zero, then those of I-. A row can hold several sequences: CLOSED stands between them and after them."""
        if self._run is None:
            v, d = (np.concatenate([w[..., :1], w[..., 1::2] - w[..., :1], 0 * w[..., :1], w[..., 2::2] - w[..., :1]], axis=-1) for w in (self.p["v"], self.p["d"]))
            self._run = network.session(self.p, self.hidden, v, d)
        return self._run(x)

    def fast(self, x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The emissions (time, batch, tags) of sequences of n characters (batch, time), with the rounding of :meth:`scores`,
        and (batch, 2 * kinds, time) what each character adds to a span of each kind as its first, then as a later one, see :func:`stretches`."""
        s = self.scores(np.where(np.arange(x.shape[1])[:, None] < n, x.T, CLOSED))
        gain = s + more(self.p["a"] + _FORBIDDEN)
        return tagged(s).transpose(1, 0, 2), np.concatenate([gain[..., 1:SIDE], gain[..., SIDE + 1 :]], axis=-1).transpose(0, 2, 1)

    def __getstate__(self):
        return self.__dict__ | {"_run": None}

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of the tags under the CRF, and its gradients."""
        p, (n, steps) = self.p, x.shape
        em, h, (f, kf, b, kb) = self.emissions(x, True)
        a = p["a"] + _FORBIDDEN
        # forward and backward sums at the scale of one, so that each step is one product of matrices
        top = em.max(axis=2)
        near, way = np.exp(em - top[:, :, None]), np.exp(a)
        alpha, beta, scale = np.empty_like(em), np.ones_like(em), np.empty((steps, n), em.dtype)
        for t in range(steps):
            alpha[t] = near[t] * (np.exp(_START) if t == 0 else alpha[t - 1] @ way)
            scale[t] = np.maximum(alpha[t].sum(axis=1), 1e-30)
            alpha[t] /= scale[t][:, None]
        ahead = np.empty_like(em)
        for t in range(steps - 1, 0, -1):
            ahead[t] = near[t] * beta[t] / scale[t][:, None]
            beta[t - 1] = ahead[t] @ way.T
        z = (np.log(scale) + top).sum(axis=0)
        rows = np.arange(n)
        gold = sum(em[t][rows, y[:, t]].sum() for t in range(steps)) + a[y[:, :-1], y[:, 1:]].sum()
        d_em = alpha * beta
        d_a = way * np.einsum("tni,tnj->ij", alpha[:-1], ahead[1:], optimize=True)
        np.add.at(d_a, (y[:, :-1].ravel(), y[:, 1:].ravel()), -1)
        d_em[np.arange(steps)[:, None], rows[None], y.T] -= 1
        d_em /= n * steps
        g = {"a": d_a / (n * steps), "d": d_em.sum(axis=(0, 1)), "v": np.einsum("tnh,tnk->hk", h, d_em, optimize=True)}
        d_h = d_em @ p["v"].T
        size, de = self.hidden, 0
        for k, out, kept, grad, seen in (("f", f, kf, d_h[:, :, :size], x), ("b", b, kb, d_h[::-1, :, size:], x[:, ::-1])):
            d_table, g[f"u{k}"] = _lstm_back(p[f"u{k}"], out, kept, grad, seen)
            g[f"b{k}"], g[f"w{k}"] = d_table.sum(axis=0), p["e"].T @ d_table
            de = de + d_table @ p[f"w{k}"].T
        return float((z.sum() - gold) / (n * steps)), g | {"e": de}

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, batch: int = 80, rate: float = 0.018) -> Tagger:
        """Adam with a falling rate and clipped gradients; deterministic."""
        m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        rng = np.random.Generator(np.random.Philox(3))
        for t in range(1, steps + 1):
            at = rng.integers(0, len(x), batch)
            _, g = self.gradients(x[at], y[at])
            scale = min(1.0, 1.0 / (np.sqrt(sum(float((v * v).sum()) for v in g.values())) + 1e-9))
            now = rate * min(1.0, t / 30) * (1 - 0.95 * t / steps)
            for k, v in g.items():
                v = v * scale
                m[k][0][:] = 0.9 * m[k][0] + 0.1 * v
                m[k][1][:] = 0.99 * m[k][1] + 0.01 * v * v
                self.p[k] -= (now * (m[k][0] / (1 - 0.9**t)) / (np.sqrt(m[k][1] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        return self

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best tags (batch, time) by the Viterbi algorithm."""
        em, _, _ = self.emissions(x)
        em = em + _BARRED[x.T]
        steps, n, _ = em.shape
        a = (self.p["a"] + _FORBIDDEN).T[None]
        score, back = em[0] + _START, np.empty((steps, n, TAGS), np.int8)
        for t in range(1, steps):
            s = score[:, None, :] + a
            back[t] = s.argmax(axis=2)
            score = s.max(axis=2) + em[t]
        out = np.empty((n, steps), np.int8)
        out[:, -1] = score.argmax(axis=1)
        for t in range(steps - 1, 0, -1):
            out[:, t - 1] = back[t][np.arange(n), out[:, t]]
        return out


@lru_cache(1)
def trained(sequences: int = SEQUENCES, steps: int = STEPS) -> Tagger:
    """The production model. It is fitted on generated texts with labelled
    spans, always the same, once in a driver process."""
    x, y = Examples().batch(sequences, LENGTH)
    return Tagger().fit(x, y, steps)


# --- documents ---


def window_starts(text: str, window: int = WINDOW, step: int = STEP) -> list[int]:
    """Starts of the overlapping windows that cover the whole text."""
    return [k * step for k in range(max(0, -(-(len(text) - window) // step)) + 1)]


def spans_of(tags: np.ndarray, offset: int) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the runs of tags."""
    out, at = [], 0
    tags = tags.tolist()
    while at < len(tags):
        t = tags[at]
        if not t:
            at += 1
            continue
        kind, end = (t - 1) // 2, at + 1
        while end < len(tags) and tags[end] == 2 + 2 * kind:
            end += 1
        out.append((at + offset, end + offset, kind))
        at = end
    return out


def rows_of(lengths: list[int], room: int = WINDOW + PADDING) -> list[list[tuple[int, int]]]:
    """Rows of (sequence, place) that hold sequences of these lengths with their padding, the longest that still fits next, and one character between two."""
    left = sorted((n + PADDING, i) for i, n in enumerate(lengths))
    out: list[list[tuple[int, int]]] = []
    while left:
        row, at = [], 0
        while k := bisect_right(left, (room - at, len(lengths))):
            n, i = left.pop(k - 1)
            row.append((i, at))
            at += n + 1
        out.append(row)
    return out


def emitted(texts: list[str], model: Tagger, batch: int = 192) -> list[list[np.ndarray]]:
    """For each text and window the scores (characters, 2 * SIDE)."""
    codes = [encode(t) for t in texts]
    windows = [(i, s, min(WINDOW, len(t) - s)) for i, t in enumerate(texts) if t for s in window_starts(t)]
    out: list[list] = [[None] * len(window_starts(t)) if t else [] for t in texts]
    rows = rows_of([n for *_, n in windows])
    each = -(-len(rows) // max(1, -(-len(rows) // batch)))  # batches of like size
    for at in range(0, len(rows), each or 1):
        part = rows[at : at + each]
        x = np.full((len(part), max(p + windows[w][2] for row in part for w, p in row) + PADDING), CLOSED, np.int16)
        for line, row in zip(x, part):
            for w, p in row:
                i, s, n = windows[w]
                line[p : p + n], line[p + n : p + n + PADDING] = codes[i][s : s + n], 0
        scores = model.scores(x.T)
        for k, row in enumerate(part):
            for w, p in row:
                i, s, n = windows[w]
                out[i][s // STEP] = scores[k, p : p + n]
    return out


def averaged(windows: list[np.ndarray], length: int, first: int, last: int) -> np.ndarray:
    """The emissions of the characters from first to last of a text of this length. Where two
    windows overlap their mean counts, a window the less the nearer its border is."""
    out, both = np.zeros((last - first, TAGS), np.float32), WINDOW - STEP
    ramp = (np.arange(1, both + 1) / (both + 1)).astype(np.float32)
    for k in range(max(0, (first - WINDOW) // STEP), min(len(windows), last // STEP + 1)):
        s, n = k * STEP, len(windows[k])
        weight = np.ones(n, np.float32)
        if s:
            weight[:both] = ramp
        if s + n < length:
            weight[n - both :] = ramp[::-1]
        lo, hi = max(s, first), min(s + n, last)
        if lo < hi:
            out[lo - first : hi - first] += windows[k][lo - s : hi - s] * weight[lo - s : hi - s, None]
    return out


def changes(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the best transitions into a span of each kind, out of it, and on within it give over those of no span."""
    return _changes(a.tobytes(), a.dtype.str)


@lru_cache(8)
def _changes(raw: bytes, dtype: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a = np.frombuffer(raw, dtype).reshape(TAGS, TAGS)
    kinds, after = range(1, TAGS, 2), [0, *range(1, TAGS, 2)]
    into = np.array([max(a[p, b] - a[p, 0] for p in range(TAGS)) for b in kinds])
    leave = np.array([max(a[t, n] - a[0, n] for t in (b, b + 1) for n in after) for b in kinds])
    # from a B- to its first I- and on from I- to I-, whichever is better for all
    stay = np.array([max(a[b, b + 1], a[b + 1, b + 1]) - a[0, 0] for b in kinds])
    return into, leave, stay


def tagged(scores: np.ndarray) -> np.ndarray:
    """Emissions (..., tags) of scores."""
    out = np.empty((*scores.shape[:-1], TAGS), np.float32)
    out[..., 0] = scores[..., 0]
    out[..., 1::2], out[..., 2::2] = scores[..., 1:SIDE] + scores[..., :1], scores[..., SIDE + 1 :] + scores[..., :1]
    return out


def more(a: np.ndarray) -> np.ndarray:
    """What is added to scores to have what a character adds to a span: the way on within it, and the rounding."""
    out = np.full(2 * SIDE, ROUNDING, np.float32)
    out[SIDE + 1 :] += changes(a)[2].astype(np.float32)
    return out


def owned(windows: list[np.ndarray]) -> list[np.ndarray]:
    """The parts of a text's windows up to the next one's beginning. Where windows overlap the greater score counts, as no mean is above it."""
    out = [w[:STEP] for w in windows[:-1]] + windows[-1:]
    for k in range(1, len(out)):
        out[k] = np.concatenate([np.maximum(out[k][: WINDOW - STEP], windows[k - 1][STEP:]), out[k][WINDOW - STEP :]])
    return out


def summaries(parts: list[np.ndarray], add: np.ndarray, lanes: int = 256) -> np.ndarray:
    """(parts, 4, kinds) of each part's scores, with `add` to each: the most that a span gains that begins and ends in it, the most that its characters add
    from its beginning on, what all of them add, and the most from a first character in it to its end. Parts of like length are gone through
    side by side, from their ends."""
    order, out = sorted(range(len(parts)), key=lambda k: len(parts[k])), np.empty((len(parts), 4, SIDE), np.float32)
    nothing = np.where(np.arange(2 * SIDE) < SIDE, np.float32(-1e9), 0) - add
    for at in range(0, len(order), lanes):
        some = order[at : at + lanes]
        n, steps = len(some), len(parts[some[-1]])
        scores = np.empty((steps, n, 2 * SIDE), np.float32)
        for lane, k in enumerate(some):
            scores[: len(parts[k]), lane] = parts[k]
            scores[len(parts[k]) :, lane] = nothing
        scores = scores.reshape(steps, -1)
        constant = np.tile(add, n)
        # both sides in one go: what later characters add stands SIDE columns after the first ones it is added to
        on, total = np.zeros(2 * n * SIDE, np.float32), np.zeros(2 * n * SIDE, np.float32)
        best, begun, value = (np.full(len(on) - SIDE, -np.inf, np.float32) for _ in range(3))
        for s in scores[::-1]:
            s += constant
            np.maximum(best, np.add(s[:-SIDE], on[SIDE:], out=value), out=best)
            np.maximum(begun, np.add(s[:-SIDE], total[SIDE:], out=value), out=begun)
            total += s
            on += s
            np.maximum(on, 0, out=on)
        best, begun = (np.append(x, np.zeros(SIDE, np.float32)).reshape(n, 2 * SIDE)[:, :SIDE] for x in (best, begun))
        on, total = (x.reshape(n, 2 * SIDE)[:, SIDE:] for x in (on, total))
        out[some] = np.stack([best, on, total, begun], axis=1)
    return out[:, :, 1:]


def reached(sums: np.ndarray, length: int, a: np.ndarray) -> list[tuple[int, int]]:
    """Parts of a text outside of which no span lies on the best path, in steps of windows, from the :func:`summaries` of those.

    As :func:`plausible` knows, a span must gain over no span. From the last window to the first, `on` is the most that
    later characters can still add to a span of each kind; a part is in if a span that begins there can gain, and with it
    those that follow as far as that span can reach."""
    into, leave, _ = changes(a)
    least = -2e-2 - np.maximum(into, 0) - np.maximum(leave, 0)
    hot = (sums[:, 0] >= least).any(axis=1)
    if len(sums) > 1:
        on, ahead = np.zeros(len(KINDS)), []
        for k in range(len(sums) - 1, -1, -1):
            _, most, whole, begun = sums[k]
            hot[k] |= (begun + on >= least).any()
            on = np.maximum(most, whole + on)
            ahead.append(on)
        if hot.any():
            reach = np.full(len(KINDS), -np.inf)
            for k, most in enumerate(reversed(ahead)):
                inside = (reach + most >= least).any()
                reach = np.maximum(reach + sums[k, 2] if inside else -np.inf, sums[k, 3] if hot[k] else -np.inf)
                hot[k] |= inside
    return [(s * STEP, length if e == len(sums) else e * STEP) for s, e in runs(hot)]


def runs(keep: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], keep, [False]]).astype(np.int8))).tolist()
    return list(zip(edge[::2], edge[1::2]))


def stretches(gains: list[np.ndarray], length: int, a: np.ndarray) -> list[tuple[int, int]]:
    """:func:`reached` for one text, by what each character of its windows adds to spans (2 * kinds, characters)."""
    kinds, windows = len(KINDS), [np.zeros((g.shape[1], 2 * SIDE), np.float32) for g in gains]
    for w, g in zip(windows, gains):
        w[:, 1:SIDE], w[:, SIDE + 1 :] = g[:kinds].T, g[kinds:].T
    return reached(summaries(owned(windows), np.zeros(2 * SIDE, np.float32)), length, a)


def plausible(em: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Which characters can lie in a span on the best path. A span of a kind is on it only if it gains
    over no span: its first character's B-, the others' I-, and the best transitions into and out of it.
    A character is out if no span of any kind that holds it can gain. Nothing on the best path is left out."""
    e, (into, leave, stay) = np.ascontiguousarray(em.T), changes(a)
    total = np.cumsum((e[2::2] - e[0]).astype(float) + stay[:, None], axis=1)
    up_to = total + np.maximum.accumulate(e[1::2] - e[0] - total, axis=1)  # the best span so far that holds this character
    on = np.maximum.accumulate(total[:, ::-1], axis=1)[:, ::-1] - total  # and the best way on
    return (up_to + on >= (-1e-2 - np.maximum(into, 0) - np.maximum(leave, 0))[:, None]).any(axis=0)


def best_spans(em: np.ndarray, a: np.ndarray, offset: int = 0, length: int | None = None) -> list[tuple[int, int, int]]:
    """The spans of the best path through the emissions of a whole text, or of those from `offset` of a text of
    this length that has no span beside them: the Viterbi algorithm, run where spans are plausible; elsewhere the path is known to have none."""
    length = len(em) if length is None else length
    found: list[tuple[int, int, int]] = []
    for s, e in runs(plausible(em, a)):
        score = em[s] + (a[0] if s + offset else _START)
        back = np.empty((e - s, TAGS), np.int8)
        for t in range(s + 1, e):
            m = score[:, None] + a
            back[t - s] = m.argmax(axis=0)
            score = m.max(axis=0) + em[t]
        tag = int((score + (a[:, 0] if e + offset < length else 0)).argmax())
        tags = np.zeros(e - s, np.int8)
        for t in range(e - s - 1, -1, -1):
            tags[t] = tag
            tag = int(back[t, tag]) if t else tag
        found += spans_of(tags, s + offset)
    return found


def find_spans(texts: list[str | None], model: Tagger) -> list[list[tuple[int, int, int]]]:
    a = (model.p["a"] + _FORBIDDEN).astype(np.float32)
    found: list[list[tuple[int, int, int]]] = []
    for i, j in parts([t or "" for t in texts], PART):
        some = [t or "" for t in texts[i:j]]
        windows = emitted(some, model)
        sums, at = summaries([p for w in windows for p in owned(w)], more(a)), 0
        for text, own in zip(some, windows):
            hot = reached(sums[at : at + len(own)], len(text), a)
            at += len(own)
            ems = [tagged(w) for w in own] if hot else []
            found.append([x for s, e in hot for x in best_spans(averaged(ems, len(text), s, e), a, s, len(text))])
    return found


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for s, e, k in spans:
        out += [text[at:s], f"[{KINDS[k]}]"]
        at = e
    return "".join([*out, text[at:]])


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))


def redact(docs: DataFrame, model: Tagger | None = None) -> DataFrame:
    """(doc_id, text, spans) for every row of docs: the text with each span
    replaced by its kind in brackets, and the spans, in characters of the
    text as it was.

    Null texts stay null without spans, empty ones empty; a null doc_id stays;
    equal rows are treated alike; other columns are ignored; an empty table gives no rows.
    """
    model = model or trained()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                texts = part.column(1).to_pylist()
                spans = find_spans(texts, model)
                new = [masked(t, s) if s else t for t, s in zip(texts, spans)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(new, pa.string()), pa.array([[{"start": s, "end": e, "kind": KINDS[k]} for s, e, k in x] for x in spans], _SPANS)], ["doc_id", "text", "spans"]
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, text string, spans array<struct<start:int,end:int,kind:string>>")


def redacted_documents(docs: DataFrame, model: Tagger | None = None) -> DataFrame:
    """docs, all columns and rows, with `text` redacted and, where it is
    there, `n_chars` its new length for texts that changed. Null and empty texts stay as they are, as do
    nulls in other columns; equal rows are treated alike; an empty table gives no rows."""
    model = model or trained()
    schema = docs.schema

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                texts = part.column("text").to_pylist()
                spans = find_spans(texts, model)
                new = [masked(t, s) if s else t for t, s in zip(texts, spans)]
                cols = {f.name: c for f, c in zip(part.schema, part.columns)}
                cols["text"] = pa.array(new, pa.string())
                if "n_chars" in cols:
                    cols["n_chars"] = pa.array([len(t) if s else n for t, s, n in zip(new, spans, cols["n_chars"].to_pylist())], cols["n_chars"].type)
                yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return docs.mapInArrow(lean(run), schema)
