"""Helpers that the training-data operators share: shared storage, hashing of
words, tokenizer loading and size-checked broadcasts."""

from __future__ import annotations

import base64
import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a join side of two or three integers is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END_OF_TEXT = 50256
_PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
_SPACE = "[\\t-\\r \\x85\\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none (a single machine, as in tests) a
    temporary folder is made and set."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told is None:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        told = known.get() if known.isDefined() else "file://" + tempfile.mkdtemp(prefix="vectorloom-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(told)
    return told


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def local(path: str) -> str:
    """The path by which Python opens a file of a mounted shared folder; a scheme
    other than file: has none, and would be a folder of each machine's own, so it is an error."""
    if re.match(r"^(?!file:)[A-Za-z][A-Za-z0-9+.-]+:/", path):
        raise ValueError(f"{path}: these files need a shared folder that is mounted as a file system")
    return re.sub(r"^file:/+", "/", path)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts the lineage and survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a compressed table in the shared folder, read back."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint while the counted rows stay within the limit."""
    return F.broadcast(df) if rows <= limit else df


def _libc():
    """The C library where it is one whose allocator can be tuned, else None."""
    try:
        lib = ctypes.CDLL(None)
        return lib if hasattr(lib, "malloc_trim") and hasattr(lib, "mallopt") else None
    except OSError:
        return None


def lean(f, over: int = 4 << 20):
    """f for mapInArrow, giving freed memory back after every batch, so that
    Python workers that Spark keeps for later stages stay small. Arrays of
    more than `over` bytes are given back at once, which costs some time."""

    def run(batches):
        lib = _libc()
        if lib:
            lib.mallopt(-3, over)  # larger arrays come from the system and go back to it
        for out in f(batches):
            yield out
            del out
            if lib:
                lib.malloc_trim(0)
        pa.default_memory_pool().release_unused()
        if lib:
            lib.malloc_trim(0)

    return run


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over unsigned integers."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """One 64-bit hash for each run of `width` neighbouring word hashes."""
    n = len(h) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(width):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n] + np.uint64(k + 1)) if n > 0 else out
    return out


class Bpe:
    """Byte-pair tokens of a public vocabulary.

    The pattern that cuts texts into pieces backtracks over white space, for
    which long runs leave it no stack. Such a run is one piece, but for its last
    character if text follows, so it is cut out beforehand; the tokens are the same."""

    def __init__(self, path: str = TOKENIZER, long_run: int = 10_000):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=_PIECES, mergeable_ranks=ranks, special_tokens={})
        self.runs = re.compile(_SPACE + "{%d,}" % long_run)

    def ids(self, text: str) -> np.ndarray:
        """Tokens of the whole text as uint16 (the vocabulary has 50,256)."""
        out, at, encode = [], 0, self.encoding.encode_ordinary
        for m in self.runs.finditer(text):
            end = m.end() - (m.end() < len(text))
            out += encode(text[at : m.start()]) + self.encoding._encode_single_piece(text[m.start() : end])
            at = end
        return np.array(out + encode(text[at:]) if out else encode(text), np.uint16)


_bpe: dict[str, Bpe] = {}


def bpe(path: str = TOKENIZER) -> Bpe:
    """The tokenizer, loaded once in a Python process."""
    if path not in _bpe:
        _bpe[path] = Bpe(path)
    return _bpe[path]
