"""The corpus pipeline: each stage against what it should do to the same rows by brute force."""

import numpy as np
import pytest

import corpus_pipeline
from vectorloom.llm import langid, mixing, pii
from vectorloom.llm.common import bpe

from .test_text_operators import DOCS, ITEM, corrupted, groups, prose, tongue


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, prose(i, 60), "en", "ab"[i % 2], 0) for i in range(60)]
    rows += [(100 + i, corrupted(i, prose(i, 60), 2), "en", "a", 0) for i in range(10)]
    rows += [(200, "これは日本語の文章です。犬と猫がいます。", None, "a", 0), (201, "", None, "b", 0), (202, None, None, None, 0)]
    rows += [(300, f"{prose(900, 40)}. {ITEM}", "en", "a", 0), (301, f"{prose(901, 60)} call +1 (555) 555-0100 or mail jane.doe@example.org today {prose(902, 9)}", "en", "b", 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows


def test_stages_one_by_one(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        if name != "mixture":
            assert docs.columns == [c.split()[0] for c in DOCS.split(", ")]
            docs = spark.createDataFrame(docs.collect(), DOCS)
        seen[name] = docs
    ids = {k: {r["doc_id"] for r in v.collect()} for k, v in seen.items() if k != "mixture"}
    everything = {r[0] for r in rows}
    assert ids["language"] == everything - {200, 201, 202}
    gone = {a for a, _ in groups([(r[0], r[1]) for r in rows if r[0] in ids["language"]])}
    assert gone == set(range(100, 110)) and ids["near_dedup"] == ids["language"] - gone
    assert ids["decontaminate"] == ids["near_dedup"] - {300}
    assert ids["private"] == ids["decontaminate"]
    kept = {r["doc_id"]: r["text"] for r in seen["private"].collect()}
    assert "[PHONE]" in kept[301] and "[EMAIL]" in kept[301] and all(kept[i] == t for i, t, *_ in rows if i in kept and i != 301)
    packed = mixing.packed(seen["private"])
    assert sum(packed.toPandas().n_tokens) == sum(len(bpe().ids(t)) + 1 for t in kept.values())
    assert seen["mixture"].count() == packed.count()


def test_run_is_the_stages_in_a_row(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
    one, two = (sorted(map(str, d.collect())) for d in (corpus_pipeline.run(spark, path), docs))
    assert one == two and one


def test_stages_with_nulls_and_clashing_names(spark, folder):
    path, _ = folder
    rows = [(None, prose(1, 30), None, None, None, 1, "x"), (1, None, "en", "a", 1, 1, "x"), (2, "", "en", "a", 1, 1, "x"), (3, prose(2, 30), "en", None, None, 1, "x"), (3, prose(2, 30), "en", None, None, 1, "x"), (4, tongue("xx", 1), "en", "b", 1, 1, "x")]
    docs = spark.createDataFrame(rows, DOCS + ", _gone int, words string")
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), path).count() == 0
        assert out.count() == {"language": 4}.get(name, 6)
    assert corpus_pipeline.STAGES[4][1](spark, docs, path).count() > 0
    assert corpus_pipeline.STAGES[4][1](spark, docs.limit(0), path).count() == 0


def test_five_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "decontaminate", "private", "mixture"] and corpus_pipeline.ORACLE_SQL is None
    assert langid.FARTHEST < 1 and np.isfinite(pii._BARRED).all()
