"""Readers and writers of embedding files.

Tables of vectors are (word_id, word, vec) or (word, vec). Text formats are read as
distributed text; binary ones file by file, as they can't be split. Single-file formats are written on the
driver from batches in the order of word_id, so memory doesn't grow with the table.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import TextProcessor
from ..functions.vector import matrix_of

MAGIC, VERSION = b"EMBD", 1
_WORDS = "word string, vec array<float>"


def plain(path: str) -> str:
    """A file:/ path as Python opens it; other schemes have no such path and are an error."""
    if re.match(r"^(?!file:)[A-Za-z][A-Za-z0-9+.-]+:/", str(path)):
        raise ValueError(f"{path}: a single file is written and read through a mounted file system")
    return re.sub(r"^file:/+", "/", str(path))


# --- text and sentences ---


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): one row a file, numbered in the order of paths."""
    files = spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("text"))
    from ..operators.vocab import numbered

    return numbered(files, F.substring("path", 1, 1), ["path"], "doc_id").select("doc_id", "text")


def line_sentences(lines: DataFrame, processor: TextProcessor | None = None, line: str = "value") -> DataFrame:
    """(words) of each line that has any; a line is one sentence, whatever
    marks it holds. For tables and streams alike."""
    words = F.flatten((processor or TextProcessor()).sentences(F.col(line)))
    return lines.select(words.alias("words")).where(F.size("words") > 0)


# --- readers ---


def read_word2vec_text(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """(word, vec) of "word v1 v2 ..." lines after a line "<words> <dim>".
    A line of another width or with something that isn't a number is an error; of
    repeated words the last counts. `header=False` reads files without the first line."""
    lines = spark.read.text(path).withColumn("_at", F.monotonically_increasing_id())
    first = lines.first()
    head = re.fullmatch(r"\s*(\d+)\s+(\d+)\s*", first["value"]) if first else None
    if header and not head:
        raise ValueError(f"{path} doesn't begin with a line of two numbers")
    dim = int(head[2]) if header else len(first["value"].split()) - 1 if first else 0
    if header:
        lines = lines.where(F.col("_at") != first["_at"])
    parts = F.split(F.trim("value"), r"\s+")
    vec = F.when(F.size(parts) == dim + 1, F.transform(F.slice(parts, 2, max(1, dim)), lambda x: x.cast("float"))).otherwise(F.raise_error(F.concat(F.lit("bad line: "), F.substring("value", 1, 80))).cast("array<float>"))
    return lines.select(F.element_at(parts, 1).alias("word"), vec.alias("vec"), "_at").groupBy("word").agg(F.max_by("vec", "_at").alias("vec"))


def parse_word2vec_binary(data: bytes) -> Iterator[tuple[str, np.ndarray]]:
    head, _, _ = data.partition(b"\n")
    n, dim = map(int, head.split())
    at = len(head) + 1
    for _ in range(n):
        end = data.index(b" ", at)
        word = data[at:end].decode("utf-8", "replace").lstrip("\n")
        if end + 1 + 4 * dim > len(data):
            raise ValueError("the file ends inside a vector")
        yield word, np.frombuffer(data, "<f4", dim, end + 1)
        at = end + 1 + 4 * dim
        at += data[at : at + 1] == b"\n"


def parse_embd(data: bytes) -> Iterator[tuple[str, np.ndarray]]:
    if len(data) < 24 or data[:4] != MAGIC:
        raise ValueError("not an EMBD file")
    version, n, dim = struct.unpack_from("<IQQ", data, 4)
    if version != VERSION:
        raise ValueError(f"unknown version {version}")
    at, index = 24, []
    for _ in range(n):
        (size,) = struct.unpack_from("<Q", data, at)
        word = data[at + 8 : at + 8 + size].decode("utf-8", "replace")
        index.append((word, *struct.unpack_from("<QQ", data, at + 8 + size)))
        at += 24 + size
    for word, offset, _ in index:
        yield word, np.frombuffer(data, "<f4", dim, at + offset)


def _binary(spark: SparkSession, path: str, parse) -> DataFrame:
    def run(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                words, rows = [], []
                for word, v in parse(data):
                    words.append(word)
                    rows.append(v)
                    if len(words) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(rows, pa.list_(pa.float32()))], ["word", "vec"])
                        words, rows = [], []
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(rows, pa.list_(pa.float32()))], ["word", "vec"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, _WORDS)


def read_word2vec_binary(spark: SparkSession, path: str) -> DataFrame:
    return _binary(spark, path, parse_word2vec_binary)


def read_embd(spark: SparkSession, path: str) -> DataFrame:
    return _binary(spark, path, parse_embd)


def detect_format(path: str) -> str:
    """"embd", "binary" or "text", from the name and the first bytes."""
    kind = Path(plain(path)).suffix
    if kind in (".bin", ".vec"):
        with open(plain(path), "rb") as f:
            start = f.read(4)
        if kind == ".bin":
            return "embd" if start == MAGIC else "binary"
        return "text" if start[:1].isdigit() or start[:1] == b"-" else "binary"
    return "text"


def read_pretrained(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """(word, vec) of a file of any of the formats."""
    return {"embd": read_embd, "binary": read_word2vec_binary, "text": read_word2vec_text}[kind or detect_format(path)](spark, path)


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """(word1, word2, score) of tab-separated lines; words in lower case.
    Comments ("#"), blank lines, lines of under three fields and scores that aren't numbers are left out."""
    line = F.trim("value")
    parts = F.split(line, "\t")
    rows = spark.read.text(path).where((line != "") & ~line.startswith("#") & (F.size(parts) >= 3))
    return rows.select(*[F.lower(F.trim(parts[i])).alias(f"word{i + 1}") for i in (0, 1)], F.trim(parts[2]).try_cast("float").alias("score")).where("score is not null")


#: Names of well-known word-pair benchmarks and what else they are called.
BENCHMARKS = {"wordsim353": ("wordsim-353", "ws353"), "simlex999": ("simlex-999", "simlex"), "men": ("men-tr-3k",), "rw": ("rw-stanford", "rare-words"), "scws": ()}
_FOLDER = "spark.vectorloom.benchmarks"


def benchmark_name(name: str) -> str:
    """The name of a benchmark from it or an alias, in any case."""
    found = next((k for k, others in BENCHMARKS.items() if name.lower() in (k, *others)), None)
    if found is None:
        raise ValueError(f"unknown benchmark {name}; known: {', '.join(BENCHMARKS)}")
    return found


def load_builtin(spark: SparkSession, name: str, folder: str | None = None) -> DataFrame:
    """The pairs of a benchmark by its name, from <name>.tsv in the folder or
    the one that the session's ``spark.vectorloom.benchmarks`` names; none of the files comes with this library."""
    known = benchmark_name(name)
    folder = folder or spark.conf.get(_FOLDER, None)
    if not folder:
        raise FileNotFoundError(f"{known}: no folder is given and {_FOLDER} isn't set")
    path = f"{folder.rstrip('/')}/{known}.tsv"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        raise FileNotFoundError(f"{known}: there is no {path}")
    return read_benchmark(spark, path)


# --- writers ---


def _batches(vectors: DataFrame, size: int = 8192) -> Iterator[tuple[list[str], np.ndarray]]:
    ordered = vectors.select("word", F.col("vec").cast("array<float>").alias("vec"), *([F.col("word_id")] if "word_id" in vectors.columns else [])).orderBy("word_id" if "word_id" in vectors.columns else "word")
    words, rows = [], []
    for r in ordered.toLocalIterator(prefetchPartitions=True):
        words.append(r["word"])
        rows.append(r["vec"])
        if len(words) == size:
            yield words, np.array(rows, np.float32)
            words, rows = [], []
    if words:
        yield words, np.array(rows, np.float32)


def text_lines(vectors: DataFrame) -> DataFrame:
    """(value): "word<TAB>v1,v2,..." lines, for a distributed ``write.text``."""
    return vectors.select(F.concat_ws("\t", "word", F.concat_ws(",", F.col("vec").cast("array<float>").cast("array<string>"))).alias("value"))


def word2vec_lines(vectors: DataFrame) -> DataFrame:
    """(value): "word v1 v2 ..." lines with six decimals, without the header."""
    cells: Column = F.transform("vec", lambda x: F.printf(F.lit("%.6f"), x.cast("double")))
    return vectors.select(F.concat_ws(" ", "word", F.array_join(cells, " ")).alias("value"))


def json_lines(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.to_json(F.struct("word", F.col("vec").cast("array<float>").alias("vec"))).alias("value"))


def save_text(vectors: DataFrame, path: str) -> None:
    with open(plain(path), "w", encoding="utf-8") as f:
        for words, x in _batches(vectors):
            f.writelines(f"{w}\t{','.join(map(str, v))}\n" for w, v in zip(words, x))


def save_word2vec(vectors: DataFrame, path: str) -> None:
    n, first = vectors.count(), vectors.first()
    with open(plain(path), "w", encoding="utf-8") as f:
        f.write(f"{n} {len(first['vec']) if first else 0}\n")
        for words, x in _batches(vectors):
            f.writelines(f"{w} {' '.join(f'{c:.6f}' for c in v)}\n" for w, v in zip(words, x))


def save_word2vec_binary(vectors: DataFrame, path: str) -> None:
    n, first = vectors.count(), vectors.first()
    with open(plain(path), "wb") as f:
        f.write(f"{n} {len(first['vec']) if first else 0}\n".encode())
        for words, x in _batches(vectors):
            for w, v in zip(words, x.astype("<f4")):
                f.write(w.encode() + b" " + v.tobytes() + b"\n")


def save_json(vectors: DataFrame, path: str) -> None:
    """A list of [word, vector] pairs."""
    with open(plain(path), "w", encoding="utf-8") as f:
        f.write("[")
        between = "\n"
        for words, x in _batches(vectors):
            for w, v in zip(words, x):
                f.write(f"{between}  {json.dumps([w, [float(str(c)) for c in v]])}")
                between = ",\n"
        f.write("\n]\n")


def save_numpy(vectors: DataFrame, path: str) -> None:
    """A .npy file of the matrix, rows in the order of word_id, written through a memory map."""
    n, first = vectors.count(), vectors.first()
    out = np.lib.format.open_memmap(plain(path), "w+", np.dtype("<f4"), (n, len(first["vec"]) if first else 0)) if n else None
    if out is None:
        np.save(plain(path), np.zeros((0, 0), np.float32))
        return
    at = 0
    for words, x in _batches(vectors):
        out[at : at + len(words)] = x
        at += len(words)
    out.flush()


def save_embd(vectors: DataFrame, path: str) -> None:
    """Magic, version, sizes, an index of words, then the numbers. The body is
    made first, beside the file, so that one pass over the table is enough."""
    path, words, dim = plain(path), [], 0
    with open(f"{path}.body", "wb") as body:
        for some, x in _batches(vectors):
            words += some
            dim = x.shape[1]
            body.write(x.astype("<f4").tobytes())
    with open(path, "wb") as f:
        f.write(MAGIC + struct.pack("<IQQ", VERSION, len(words), dim))
        for i, w in enumerate(words):
            b = w.encode()
            f.write(struct.pack("<Q", len(b)) + b + struct.pack("<QQ", 4 * dim * i, 4 * dim))
        with open(f"{path}.body", "rb") as body:
            while part := body.read(1 << 24):
                f.write(part)
    os.remove(f"{path}.body")


# --- graph files with one lookup node ---


def _varint(n: int) -> bytes:
    n &= 2**64 - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(k: int, v) -> bytes:
    if isinstance(v, int):
        return _varint(k << 3) + _varint(v)
    b = v.encode() if isinstance(v, str) else v
    return _varint(k << 3 | 2) + _varint(len(b)) + b


_FLOAT, _INT8, _INT64, _FLOAT16 = 1, 3, 7, 10


def _tensor(name: str, kind: int, dims: list[int], raw: bytes) -> bytes:
    return b"".join(_field(1, d) for d in dims) + _field(2, kind) + _field(8, name) + _field(9, raw)


def _value(name: str, kind: int, dims: list) -> bytes:
    shape = b"".join(_field(1, _field(2, d) if isinstance(d, str) else _field(1, d)) for d in dims)
    return _field(1, name) + _field(2, _field(1, _field(1, kind) + _field(2, shape)))


def _gather(table: str, out: str) -> bytes:
    return _field(1, table) + _field(1, "input_indices") + _field(2, out) + _field(3, f"gather_{table}") + _field(4, "Gather")


def save_onnx(vectors: DataFrame, path: str, mode: str = "fp32") -> None:
    """A graph that looks rows up by index, with the field numbers of the
    official schema, so that standard runtimes load it. "int8" has the rows'
    scales as a second output. The matrix has to fit the driver, as the format wants it in one message."""
    from ..operators.quantize import int8, int8_scale

    ordered = vectors.orderBy("word_id" if "word_id" in vectors.columns else "word")
    if mode == "int8":
        scaled = ordered.withColumn("scale", int8_scale("vec"))
        got = scaled.select(int8("vec", F.col("scale")).alias("q"), F.col("scale").cast("float")).toArrow()
        x, scales = matrix_of(got.column("q")).astype(np.int8), got.column("scale").to_numpy().astype("<f4")
    else:
        x, scales = matrix_of(ordered.select(F.col("vec").cast("array<float>")).toArrow().column(0)).astype("<f2" if mode == "fp16" else "<f4"), None
    kind, dims = {"int8": _INT8, "fp16": _FLOAT16, "fp32": _FLOAT}[mode], list(x.shape)
    graph = _field(1, _gather("embeddings", "output")) + (_field(1, _gather("scales", "scale")) if scales is not None else b"") + _field(2, "embedding_lookup")
    graph += _field(5, _tensor("embeddings", kind, dims, x.tobytes())) + (_field(5, _tensor("scales", _FLOAT, dims[:1], scales.tobytes())) if scales is not None else b"")
    graph += _field(11, _value("input_indices", _INT64, ["n"])) + _field(12, _value("output", kind, ["n", dims[1]])) + (_field(12, _value("scale", _FLOAT, ["n"])) if scales is not None else b"")
    Path(plain(path)).write_bytes(_field(1, 8) + _field(2, "vectorloom") + _field(7, graph) + _field(8, _field(1, "") + _field(2, 13)))


EXPORTS = {
    "text": save_text, "json": save_json, "word2vec": save_word2vec, "bin": save_word2vec_binary, "embd": save_embd, "npy": save_numpy,
    "onnx": save_onnx, "onnx-int8": lambda v, p: save_onnx(v, p, "int8"), "onnx-fp16": lambda v, p: save_onnx(v, p, "fp16"),
}


def export(vectors: DataFrame, path: str, kind: str = "text") -> None:
    if kind not in EXPORTS:
        raise ValueError(f"unknown format {kind}; there are {', '.join(EXPORTS)}")
    EXPORTS[kind](vectors, path)
