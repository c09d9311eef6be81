"""A trained tagger's network as a graph for a compiled runtime.

The graph is written here, field by field, in the open exchange format; the
weights are those that numpy trained."""

from __future__ import annotations

import numpy as np

_FLOAT, _INT = 1, 6


def _varint(n: int) -> bytes:
    n, out = n & (1 << 64) - 1, bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _f(k: int, v) -> bytes:
    """A field of the format: a number, or bytes with their length."""
    if isinstance(v, int):
        return _varint(k << 3) + _varint(v)
    v = v.encode() if isinstance(v, str) else v
    return _varint(k << 3 | 2) + _varint(len(v)) + v


def _array(name: str, a: np.ndarray) -> bytes:
    return b"".join(_f(1, d) for d in a.shape) + _f(2, _FLOAT) + _f(8, name) + _f(9, a.tobytes())


def _port(name: str, kind: int, *dims) -> bytes:
    return _f(1, name) + _f(2, _f(1, _f(1, kind) + _f(2, b"".join(_f(1, _f(2 if isinstance(d, str) else 1, d)) for d in dims))))


def _step(op: str, ins: str, outs: str, **settings) -> bytes:
    b = b"".join(_f(1, i) for i in ins.split()) + b"".join(_f(2, o) for o in outs.split()) + _f(4, op)
    for k, v in settings.items():
        b += _f(5, _f(1, k) + (_f(3, v) + _f(20, 2) if isinstance(v, int) else _f(6, v) + _f(20, 5) if isinstance(v, bytes) else b"".join(_f(8, i) for i in v) + _f(20, 7)))
    return b


def _graph(name: str, steps: list[bytes], ins: list[bytes], outs: list[bytes], arrays: dict[str, np.ndarray]) -> bytes:
    held = (_array(k, np.ascontiguousarray(v, np.float32)) for k, v in arrays.items())
    return b"".join(_f(1, n) for n in steps) + _f(2, name) + b"".join(_f(5, a) for a in held) + b"".join(_f(11, i) for i in ins) + b"".join(_f(12, o) for o in outs)


def graph(p: dict[str, np.ndarray], hidden: int, v: np.ndarray) -> bytes:
    """Rows of the table of inputs (time, 2, batch), of both directions in the order they read, and states of zero to
    what each direction's state adds to the columns of v (time, 2, batch, columns).

    One scan runs both directions, so that each step is a few operations on the whole batch; no states are kept, only the columns."""
    # the last row of a direction's table closes all gates: the state is zero after it, as at the beginning
    closed = np.repeat(np.array([-50, -50, -50, 0], np.float32), hidden)[None]
    arrays = {"table": np.concatenate([x for k in "fb" for x in (p["e"] @ p[f"w{k}"] + p[f"b{k}"], closed)]), "u": np.stack([p[f"u{k}"] for k in "fb"]), "v": v.reshape(2, hidden, -1)}
    inner = [
        _step("Gather", "table x", "g"), _step("MatMul", "h u", "z"), _step("Add", "g z", "y"), _step("Split", "y", "yi yf yo yq", axis=2),
        _step("Sigmoid", "yi", "i"), _step("Sigmoid", "yf", "f"), _step("Sigmoid", "yo", "o"), _step("Tanh", "yq", "q"),
        _step("Mul", "f c", "fc"), _step("Mul", "i q", "iq"), _step("Add", "fc iq", "cn"), _step("Tanh", "cn", "e"), _step("Mul", "o e", "hn"), _step("MatMul", "hn v", "out"),
    ]
    state = (2, "batch", hidden)
    body = _graph("step", inner, [*(_port(k, _FLOAT, *state) for k in ("h", "c")), _port("x", _INT, 2, "batch")], [*(_port(k, _FLOAT, *state) for k in ("hn", "cn")), _port("out", _FLOAT, 2, "batch", v.shape[1])], {})
    steps = [_step("Scan", "h0 c0 x0", "hl cl halves", body=body, num_scan_inputs=1)]
    ins = [*(_port(k, _FLOAT, *state) for k in ("h0", "c0")), _port("x0", _INT, "time", 2, "batch")]
    return _f(1, 8) + _f(7, _graph("tagger", steps, ins, [_port("halves", _FLOAT, "time", 2, "batch", v.shape[1])], arrays)) + _f(8, _f(1, "") + _f(2, 14))


def session(p: dict[str, np.ndarray], hidden: int, v: np.ndarray, d: np.ndarray):
    """A function from classes (time, batch) to the columns of v and d (batch, time, columns), see :func:`graph`, on one thread, as tasks
    share a machine. The class after the last stands between sequences of a row and after them: neither direction carries anything over it."""
    import onnxruntime

    o = onnxruntime.SessionOptions()
    o.intra_op_num_threads = o.inter_op_num_threads = 1
    s = onnxruntime.InferenceSession(graph(p, hidden, v), o, providers=["CPUExecutionProvider"])
    table = np.int32(len(p["e"]) + 1)

    def run(x: np.ndarray) -> np.ndarray:
        steps, n = x.shape
        zero, both = np.zeros((2, n, hidden), np.float32), np.empty((steps, 2, n), np.int32)
        both[:, 0] = x
        np.add(x[::-1], table, out=both[:, 1], casting="unsafe")
        halves = s.run(["halves"], {"h0": zero, "c0": zero, "x0": both})[0].reshape(steps, 2, n * len(d))
        out, constant = np.empty((n, steps, len(d)), np.float32), np.tile(d, n)
        for t in range(0, steps, 16):  # few steps at once stay in the cache
            both = halves[t : t + 16, 0] + halves[::-1, 1][t : t + 16]
            both += constant
            out[:, t : t + 16] = both.reshape(-1, n, len(d)).transpose(1, 0, 2)
        return out

    return run
