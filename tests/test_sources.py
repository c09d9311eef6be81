"""File formats, the command line, and the driver's contract."""

import json
import subprocess
import sys

import duckdb
import numpy as np
import onnxruntime
import pytest

import __spark_entry__
from vectorloom import cli, queries
from vectorloom.sources import formats

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    return spark.createDataFrame([(i, w, rng.normal(size=4).astype(np.float32).tolist()) for i, w in enumerate(["cat", "dog", "münchen", "a_b", "zebra"])], "word_id long, word string, vec array<float>")


def rows(df):
    return {r["word"]: r["vec"] for r in df.collect()}


@pytest.mark.parametrize("kind, name", [("embd", "x.bin"), ("bin", "y.bin"), ("word2vec", "z.txt"), ("word2vec", "z.vec"), ("bin", "q.vec")])
def test_round_trips(spark, table, tmp_path, kind, name):
    path = f"{tmp_path}/{name}"
    formats.export(table, path, kind)
    if name == "q.vec":  # begins with a digit, so the kind has to be named
        got = rows(formats.read_pretrained(spark, path, "binary"))
    else:
        got = rows(formats.read_pretrained(spark, path))
    want = rows(table)
    assert set(got) == set(want) and all(np.allclose(got[w], want[w], atol=1e-6) for w in want)


def test_other_exports(spark, table, tmp_path):
    want = rows(table)
    formats.export(table, f"{tmp_path}/t", "text")
    lines = dict(x.split("\t") for x in (tmp_path / "t").read_text().splitlines())
    assert list(lines) == list(want) and all(np.array_equal(np.float32(lines[w].split(",")), np.float32(want[w])) for w in want)
    formats.export(table, f"{tmp_path}/j", "json")
    assert [w for w, _ in json.loads((tmp_path / "j").read_text())] == list(want)
    formats.export(table, f"{tmp_path}/n.npy", "npy")
    assert np.array_equal(np.load(f"{tmp_path}/n.npy"), np.float32(list(want.values())))
    assert {r[0].split("\t")[0] for r in formats.text_lines(table).collect()} == set(want) == {r[0].split(" ")[0] for r in formats.word2vec_lines(table).collect()}
    assert {json.loads(r[0])["word"] for r in formats.json_lines(table).collect()} == set(want)
    formats.export(table.limit(0), f"{tmp_path}/e", "json")
    assert json.loads((tmp_path / "e").read_text()) == []
    with pytest.raises(ValueError):
        formats.export(table, f"{tmp_path}/x", "csv")


@pytest.mark.parametrize("kind", ["onnx", "onnx-int8", "onnx-fp16"])
def test_graphs_run(table, tmp_path, kind):
    formats.export(table, f"{tmp_path}/m.onnx", kind)
    out = onnxruntime.InferenceSession(f"{tmp_path}/m.onnx").run(None, {"input_indices": np.array([2, 0])})
    x = out[0].astype(float) * out[1][:, None] if kind == "onnx-int8" else out[0]
    want = list(rows(table).values())
    assert np.allclose(x, [want[2], want[0]], atol=0.02)


def test_text_reader_rules(spark, tmp_path):
    p = tmp_path / "v.txt"
    p.write_text("3 4\ncat .1 .2 3 4\ndog 5 -.6 .7 8e-1\nfish .9 0 1 2\n")
    got = rows(formats.read_word2vec_text(spark, str(p)))
    assert len(got) == 3 and "elephant" not in got and got["dog"] == pytest.approx([5, -0.6, 0.7, 0.8])
    p.write_text("9 2\ncat 1 2\ncat 3 4\n")
    assert rows(formats.read_word2vec_text(spark, str(p))) == {"cat": [3.0, 4.0]}
    for bad in ("cat 1 2\n", "1 2\ncat 1\n", "1 2\ncat 1 x\n", "1 2\n\ncat 1 2\n"):
        p.write_text(bad)
        with pytest.raises(Exception):
            formats.read_word2vec_text(spark, str(p)).collect()
    p.write_text("cat 1 2\ndog 3 4\n")
    assert len(rows(formats.read_word2vec_text(spark, str(p), header=False))) == 2
    for data in (b"", b"EMBX" + bytes(40), b"EMBD" + bytes(40)):
        with pytest.raises(ValueError):
            list(formats.parse_embd(data))


def test_benchmark_reader(spark, tmp_path):
    p = tmp_path / "b.tsv"
    p.write_text("# comment\n\nCat\tDog \t7.5\nbad\tscore\tx\nshort\tline\n tiger\tcat\t7\textra\n")
    assert sorted(map(tuple, formats.read_benchmark(spark, str(p)).collect())) == [("cat", "dog", 7.5), ("tiger", "cat", 7.0)]


def test_files_of_text(spark, tmp_path):
    (tmp_path / "a.txt").write_text("One. Two\nthree")
    (tmp_path / "b.txt").write_text("four")
    assert [tuple(r) for r in formats.whole_text(spark, f"{tmp_path}/*.txt").orderBy("doc_id").collect()] == [(0, "One. Two\nthree"), (1, "four")]
    assert [r[0] for r in formats.line_sentences(spark.read.text(f"{tmp_path}/a.txt")).collect()] == [["one", "two"], ["three"]]


def test_command_line(spark, tmp_path, capsys):
    src = tmp_path / "in.txt"
    src.write_text("the cat slept by the mat. the dog slept by the log. the cat fled the dog. " * 3)
    m, e = f"{tmp_path}/model", f"{tmp_path}/e.tsv"
    cli.main(["train", "-i", str(src), "-o", m, "-e", e, "-d", "8", "--epochs", "2", "--validation-ratio", "0.2", "--validation-output", f"{tmp_path}/v.json"])
    assert set(json.loads((tmp_path / "v.json").read_text())) >= {"accuracy", "f1_score"} and len(open(e).readlines()) == 8
    cli.main(["similarity", "cat", "dog", "-m", m])
    cli.main(["info", "-m", m])
    cli.main(["export", "-m", m, "-o", f"{tmp_path}/x.txt", "-f", "word2vec"])
    cli.main(["validate", "-m", m, "-i", str(src), "-o", f"{tmp_path}/w.json"])
    assert open(f"{tmp_path}/x.txt").readline() == "8 8\n" and "accuracy" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["similarity", "cat", "elephant", "-m", m])
    model = cli.load_model(spark, m)
    assert len(cli.answer(model, "search cat").splitlines()) == 7 and len(cli.answer(model, "analogy cat dog mat").splitlines()) == 5
    assert cli.answer(model, "sim cat xyz") == "unknown word" and "quit" in cli.answer(model, "what")
    code = tmp_path / "c.rs"
    code.write_text("fn computeSum(a: i32) { let totalSum = a; }\nlet x = computeSum(1);\n")
    cli.main(["train", "-i", str(code), "-o", m, "-e", e, "-d", "4", "--epochs", "1", "--code", "-m", "cbow"])
    assert "compute" in open(e).read()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a == pytest.approx(b, abs=2e-6)
    return a == b


@pytest.mark.parametrize("name", list(queries.SQL))
def test_queries_give_the_rows_of_their_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    rel = duck.execute(queries.SQL[name])
    names = [d[0] for d in rel.description]
    theirs = sorted((tuple(r[names.index(c)] for c in columns) for r in rel.fetchall()), key=str)
    assert sorted(names) == columns and len(mine) == len(theirs)
    assert all(same(x, y) for a, b in zip(mine, theirs) for x, y in zip(a, b))


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.SQL and not n.startswith("train")])
def test_the_other_queries_run(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_contract(spark):
    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries()) and set(queries.QUERIES) <= set(__spark_entry__.queries())


def test_the_rest_works_without_the_training_data_part():
    hide = "import sys\nclass F:\n  def find_spec(self, n, p=None, t=None):\n    if n == 'corpus_pipeline' or n.startswith('vectorloom.llm'): raise ModuleNotFoundError(n, name=n)\nsys.meta_path.insert(0, F())\nimport __spark_entry__ as e\nassert e.queries() and not any(q.startswith('op') or q == 'pipeline' for q in e.queries())"
    subprocess.run([sys.executable, "-c", hide], check=True, cwd=str(__import__("pathlib").Path(__spark_entry__.__file__).parent))
