"""Exact kNN, chat windows, WARC, language model, quality model: brute force and edge cases."""

import glob
import gzip
import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from vectorloom.llm import chat_windows, eliasfano, gam, knn_join, ngram_lm, warc
from vectorloom.llm import queries as llm
from vectorloom.llm.common import bpe, local, shared_path

from .test_text_operators import prose

# --- kNN join ---


def nearest(x: dict, k: int) -> set:
    out = set()
    for i, a in x.items():
        far = sorted((float(np.sqrt(((np.asarray(a, float) - np.asarray(b, float)) ** 2).sum())), j) for j, b in x.items() if j != i)[:k]
        out |= {(i, j, r + 1) for r, (_, j) in enumerate(far)}
    return out


@pytest.mark.parametrize("settings", [{}, {"pivots": 7, "group_queries": 40, "group_data": 30}, {"pivots": 1}, {"pivots": 40, "group_queries": 5, "group_data": 11}])
def test_knn_join_is_exact(spark, settings):
    rng = np.random.default_rng(4)
    x = {i: np.round(rng.normal(size=6) + 8 * (i % 5), 3).tolist() for i in range(300)}
    for i in range(20):  # ties and equal vectors
        x[1000 + i] = x[i % 3]
    df = spark.createDataFrame(list(x.items()), "vec_id long, embedding array<double>")
    got = {(r["vec_id"], r["neighbor_id"], r["rank"]) for r in knn_join.knn_join(df, 5, **settings).collect()}
    assert got == nearest(x, 5)


def test_knn_join_edges(spark):
    rows = [(1, [0.0, 0.0], 9), (2, [1.0, 0.0], 9), (2, [1.0, 0.0], 9), (2, [5.0, 5.0], 9), (3, None, 9), (None, [1.0, 1.0], 9), (4, [1.0], 9), (5, [float("nan"), 1.0], 9), (6, [], 9), (7, [1.0, None], 9), (8, [float("inf"), 0.0], 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cell int")
    got = [(r["vec_id"], r["neighbor_id"], r["rank"], r["distance"]) for r in knn_join.knn_join(df).collect()]
    assert sorted(got) == [(1, 2, 1, 1.0), (2, 1, 1, 1.0)]
    assert knn_join.knn_join(df.limit(0)).count() == 0
    assert knn_join.knn_join(df.where("vec_id = 1")).count() == 0


# --- chat ---

CHAT = "conv_id long, turn long, role string, text string"


def brute_windows(turns, budget, history):
    """Windows by trying every start and end, without prefix sums."""
    coder = bpe()
    coded = [(t, role, sum(len(coder.ids(p)) for p in chat_windows.rendered(role, text))) for t, role, text in turns]
    fixed = sum(n for _, role, n in coded if role == "system")
    rest = [(t, n) for t, role, n in coded if role != "system"]
    out, at = [], 0
    while at < len(rest):
        room = min(history, budget - fixed - rest[at][1])
        first = at
        while room >= 0 and first > 0 and sum(n for _, n in rest[first - 1 : at]) <= room:
            first -= 1
        end = at + 1
        while end < len(rest) and fixed + sum(n for _, n in rest[first : end + 1]) <= budget:
            end += 1
        out.append((rest[first][0], rest[at][0], rest[end - 1][0], fixed + sum(n for _, n in rest[first:end])))
        at = end
    return out


def test_chat_windows_against_brute_force(spark):
    rng = np.random.default_rng(2)
    talks = {}
    for c in range(30):
        talks[c] = [(0, "system", "be brief")] * (c % 2) + [(t + 1, ("user", "assistant")[t % 2], prose(c * 50 + t, int(rng.integers(1, 40)))) for t in range(int(rng.integers(1, 25)))]
    df = spark.createDataFrame([(c, *t) for c, turns in talks.items() for t in turns], CHAT)
    got: dict = {}
    for r in chat_windows.chat_windows(df, 256, 80).orderBy("conv_id", "window").collect():
        got.setdefault(r["conv_id"], []).append(r)
    for c, turns in talks.items():
        assert [(r["first_turn"], r["first_new_turn"], r["last_turn"], r["n_tokens"]) for r in got[c]] == brute_windows(turns, 256, 80)
        coder, taught = bpe().encoding, []
        for r in got[c]:
            assert len(r["input_ids"]) == r["n_tokens"] and (r["over_budget"] == (r["n_tokens"] > 256))
            shown = coder.decode(r["input_ids"])
            assert shown.count("<|system|>") == c % 2
            taught += [coder.decode(r["input_ids"][s["start"] : s["end"]]) for s in r["target_spans"]]
        # every answer is learned exactly once
        assert Counter(taught) == Counter(f"{t}<|end|>\n" for _, role, t in turns if role == "assistant")


def test_chat_edges(spark):
    long = prose(9, 30_000)
    rows = [(None, 0, "user", "x", 1), (1, None, "user", "first", 1), (1, 1, None, "a", 1), (1, 2, "assistant", None, 1), (1, 2, "assistant", None, 1), (2, 0, "system", "only", 1), (3, 0, "user", long, 1), (3, 1, "assistant", "", 1), (4, 5, "assistant", "b", 1), (4, 5, "assistant", "a", 1)]
    df = spark.createDataFrame(rows, CHAT + ", window int")
    got: dict = {}
    for r in chat_windows.chat_windows(df).orderBy("conv_id", "window").collect():
        got.setdefault(r["conv_id"], []).append(r)
    text = lambda r: bpe().encoding.decode(r["input_ids"])
    assert set(got) == {1, 2, 3, 4}
    assert text(got[1][0]) == "<|user|>\nfirst<|end|>\n<|unknown|>\na<|end|>\n<|assistant|>\n<|end|>\n" and got[1][0]["first_turn"] is None
    assert len(got[2]) == 1 and got[2][0]["target_spans"] == []
    assert [r["over_budget"] for r in got[3]] == [True, False] and long in text(got[3][0])
    assert text(got[4][0]).index("a<|end|>") < text(got[4][0]).index("b<|end|>")
    assert chat_windows.chat_windows(df.limit(0)).count() == 0


# --- WARC ---

RECORDS = "record string, warc_type string, target_uri string, warc_date string, digest string, payload string"


def test_archives_round_trip(spark):
    rows = [
        ("r1", "response", "http://a", "2024-01-02", "aa" * 20, "one"), ("r2", "response", "http://b", "2024-01-01", "aa" * 20, "one"), ("r3", "revisit", "http://a", "2024-02-01", "aa" * 20, None), ("r4", "revisit", "http://c", "2024-02-01", "bb" * 20, None),
        ("r5", "response", "http://d", "2024-01-01", "cc" * 20, ""), ("r6", "response", "http://e", "2024-01-01", None, "no digest"), ("r7", "response", None, None, "dd" * 20, "é" * 100_000), ("r2", "response", "http://b", "2024-01-01", "aa" * 20, "one"), (None, "response", "http://x", "2024-01-01", "ee" * 20, "x"),
    ]
    df = spark.createDataFrame([(*r, "extra") for r in rows], RECORDS + ", original string")
    folder = shared_path(spark, "warc")
    manifest = warc.deduplicated(df.drop("original"), folder).collect()
    kinds = Counter((m["record"], m["new_type"], m["original"]) for m in manifest)
    assert kinds == {("r1", "revisit", "r2"): 1, ("r2", "response", "r2"): 2, ("r3", "revisit", "r2"): 1, ("r4", "unresolved", None): 1, ("r5", "response", "r5"): 1, ("r6", "response", "r6"): 1, ("r7", "response", "r7"): 1}
    back = {r["record"]: r for r in warc.read_archives(spark, folder).collect()}
    assert back["r2"]["payload"] == b"one" and back["r7"]["payload"] == ("é" * 100_000).encode() and back["r5"]["payload"] == b""
    assert back["r1"]["warc_type"] == "revisit" and back["r1"]["refers_to"] == "r2" and back["r1"]["digest"] == "aa" * 20
    for m in manifest:  # every record can be read alone from its place
        with open(f"{local(folder)}/{m['archive']}", "rb") as f:
            f.seek(m["offset"])
            one = gzip.decompress(f.read(m["length"]))
        assert f"<{m['record']}>".encode() in one and len(one.split(b"\r\n\r\n", 1)[1]) == m["block_length"] + 4
    plain = b"".join(gzip.decompress(open(p, "rb").read()) for p in glob.glob(f"{local(folder)}/*.gz"))
    assert len(list(warc.parse(plain))) == len(manifest)


def test_resolve_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(f"r{i:03}", "response" if rng.random() < 0.5 else "revisit", f"u{i}", f"2024-01-{rng.integers(1, 29):02}", f"{rng.integers(0, 60):040x}", None) for i in range(300)]
    got = {r["record"]: r for r in warc.resolve(spark.createDataFrame(rows, RECORDS).drop("payload")).collect()}
    for record, kind, _, _, digest, _ in rows:
        first = min(((d, r, u) for r, k, u, d, g, _ in rows if k == "response" and g == digest), default=None)
        r = got[record]
        assert r["original"] == (first[1] if first else None) and r["original_uri"] == (first[2] if first else None)
        assert r["new_type"] == ("unresolved" if not first else "response" if first[1] == record and kind == "response" else "revisit")


def test_pages_edges(spark):
    pages = spark.createDataFrame([(1, "http://a", "x", 1), (2, "http://b", "x", 1), (None, None, None, 1), (3, "http://c\r\nX-Evil: 1", "", 1), (1, "http://a", "x", 1)], "page_id long, url string, html string, record int")
    m = warc.resolve_pages(pages).collect()
    assert len(m) == 2 + 2 + 2 + 2 + 1 and Counter(r["new_type"] for r in m) == {"response": 3, "revisit": 6}
    assert warc.resolve_pages(pages.limit(0)).count() == 0


def test_pages_that_share_an_id_against_the_sql(spark, tmp_path):
    rows = [(1, "http://a", "x"), (2, "http://b", "y"), (2, "http://b", "z"), (3, "http://c", "y"), (3, "http://c", "w"), (None, None, "x"), (None, None, "v"), (None, None, None), (4, None, "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages.coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    names = ["record", "new_type", "target_uri", "warc_date", "digest", "original", "block_length"]
    folder = shared_path(spark, "warc")
    got = warc.resolve_pages(pages, folder).select(*names).collect()
    want = duckdb.sql(f"WITH pages AS (SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')), q AS ({llm.SQL['op4_warc_revisits']}) SELECT {', '.join(names)} FROM q").fetchall()
    assert Counter(map(tuple, got)) == Counter(want) and len(want) == 18
    back = warc.read_archives(spark, folder).collect()
    assert Counter(r["payload"] for r in back if r["warc_type"] == "response") == Counter({b"x": 1, b"y": 1, b"z": 1, b"w": 1, b"v": 1, b"": 1})


def mixed_archive() -> tuple[list[tuple[list, bytes]], list[bytes]]:
    """Records of many types, and each as a gzip member."""
    png = bytes(range(256)) * 40
    sha = lambda b: warc.base32_sha1(hashlib.sha1(b).hexdigest())
    page = "caf\u00e9".encode("latin-1")
    http = [b"HTTP/1.1 404 Not Found\r\nContent-Type: image/png\r\nX-A: 1\r\n\r\n", b"HTTP/1.0 200 OK\r\nServer: s\r\n\r\n"]

    def fields(kind, name, *more):
        return [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", "2024-01-01T00:00:00Z"), *more]

    found = [
        (fields("warcinfo", "i", ("Content-Type", "application/warc-fields"), ("WARC-Filename", "x.warc.gz")), b"software: none\r\n"),
        (fields("request", "q", ("WARC-Target-URI", "http://a/"), ("Content-Type", "application/http;msgtype=request")), b"GET / HTTP/1.1\r\nHost: a\r\n\r\n"),
        (fields("response", "1", ("WARC-Target-URI", "http://a/"), ("WARC-Payload-Digest", sha(png))), http[0] + png),
        (fields("response", "2", ("WARC-Target-URI", "http://b/"), ("WARC-Payload-Digest", sha(page))), http[1] + page),
        (fields("response", "3", ("WARC-Target-URI", "http://c/"), ("WARC-Payload-Digest", sha(page))), http[1] + page),
        (fields("revisit", "4", ("WARC-Target-URI", "http://a/"), ("WARC-Payload-Digest", sha(png))), http[0]),
        (fields("metadata", "m", ("WARC-Concurrent-To", "<urn:uuid:1>")), b"via: \xff\x00\r\n\r\nrest"),
        (fields("response", "5", ("WARC-Target-URI", "dns:a"), ("Content-Type", "text/dns"), ("WARC-IP-Address", "10.0.0.1"), ("WARC-Payload-Digest", sha(b"1.2.3.4"))), b"1.2.3.4"),
    ]
    return found, [warc.member(f, b) for f, b in found]


@pytest.mark.parametrize("plain", [False, True])
def test_mixed_archives_lose_nothing(spark, tmp_path, plain):
    found, members = mixed_archive()
    if plain:
        members = [gzip.decompress(m) for m in members]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.warc").write_bytes(b"".join(members))
    read = warc.read_archives(spark, str(tmp_path / "in"))
    rows = {r["record"][-1]: r for r in read.collect()}
    assert len(rows) == 8 and rows["1"]["http"].startswith(b"HTTP/1.1 404") and rows["1"]["payload"] == bytes(range(256)) * 40 and rows["2"]["payload"] == b"caf\xe9" and rows["5"]["http"] == b""
    folder = shared_path(spark, "warc")
    kinds = {m["record"][-1]: m["new_type"] for m in warc.deduplicated(read, folder).collect()}
    assert kinds == {"i": "warcinfo", "q": "request", "1": "response", "2": "response", "3": "revisit", "4": "revisit", "m": "metadata", "5": "response"}
    back = {r["record"][-1]: r for r in warc.read_archives(spark, folder).collect()}
    for fields, block in found:
        r = back[fields[1][1].strip("<>")[-1]]
        got = (r["http"] or b"") + (r["payload"] or b"")
        name = r["record"][-1]
        assert got == (block.partition(b"\r\n\r\n")[0] + b"\r\n\r\n" if name == "3" else block)
        if name in "iqm":  # as they were, every field
            assert [(f["name"], f["value"]) for f in r["fields"]] == [*fields, ("Content-Length", str(len(block)))]
    assert {("Content-Type", "text/dns"), ("WARC-IP-Address", "10.0.0.1")} <= {(f["name"], f["value"]) for f in back["5"]["fields"]}
    assert back["3"]["refers_to"] == "urn:uuid:2" and back["4"]["refers_to"] == "urn:uuid:1"


@pytest.mark.parametrize("plain", [False, True])
def test_damaged_members_are_passed_over_and_told(spark, tmp_path, plain):
    _, members = mixed_archive()
    if plain:
        members = [gzip.decompress(m) for m in members]
        members[3] = members[3].replace(b"Content-Length", b"Content-Lost")
    else:
        members[3] = members[3][:40] + b"\0" * 30 + members[3][70:]
    (tmp_path / "a.warc").write_bytes(b"junk" + b"".join(members)[: -20 if not plain else -12])
    rows = warc.read_archives(spark, str(tmp_path), damaged=True).collect()
    good = [r["record"][-1] for r in rows if r["damage"] is None]
    assert [x for x in good if x != "2"] == ["i", "q", "1", "3", "4", "m"] and sum(r["damage"] is not None for r in rows) >= 3
    assert warc.read_archives(spark, str(tmp_path)).count() == len(good)
    (tmp_path / "a.warc").write_bytes(b"")
    assert warc.read_archives(spark, str(tmp_path), damaged=True).count() == 0


def test_reading_takes_time_in_proportion():
    import io
    import time

    one = b"".join(warc.member([("WARC-Type", "resource"), ("WARC-Record-ID", f"<r{i}>")], np.random.default_rng(i).bytes(20_000)) for i in range(50))

    def seconds(n):
        began = time.process_time()
        assert sum(1 for _ in warc.records(io.BytesIO(one * n))) == 50 * n
        return time.process_time() - began

    seconds(2)
    assert seconds(80) < 10 * 4 * max(seconds(8), 0.01)
    big = warc.member([("WARC-Type", "resource"), ("WARC-Record-ID", "<b>")], np.random.default_rng(1).bytes(30_000_000))
    assert [len(b) for _, _, b in warc.records(io.BytesIO(big + one))][:2] == [30_000_000, 20_000]


def test_records_with_nulls(spark):
    rows = [("a", None, "u", "d", None, "x"), ("b", "response", None, None, None, None), ("c", "revisit", None, None, None, None), (None, "response", None, None, None, "y"), ("d", "request", None, None, "zz", "z")]
    got = {m["record"]: m["new_type"] for m in warc.deduplicated(spark.createDataFrame(rows, RECORDS), shared_path(spark, "warc")).collect()}
    assert got == {"a": "unknown", "b": "response", "c": "unresolved", "d": "request"}
    with pytest.raises(ValueError):
        local("hdfs://cluster/folder")


# --- language model ---


def test_elias_fano_is_the_sequence():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 0), (1, 10**12), (1000, 50), (5000, 10**9), (300, 300)):
        v = np.sort(rng.integers(0, top + 1, n))
        e = eliasfano.EliasFano(eliasfano.EliasFano.encode(v))
        assert e[np.arange(n)].tolist() == v.tolist()
        asked = np.unique(np.concatenate([v, v + 1, rng.integers(0, top + 2, 50)]))
        first = {int(x): i for i, x in reversed(list(enumerate(v)))}
        assert e.find(asked).tolist() == [first.get(int(x), -1) for x in asked]


def brute_lm(texts, least=2, discount=0.75):
    """Interpolated absolute discounting with pruning, in dictionaries."""
    words = [re.findall(r"\w+", t.lower()) for t in texts]
    n = Counter(w for s in words for w in s)
    known = {w for w, c in n.items() if c >= least}
    sents = [["<s>"] + [w if w in known else "<unk>" for w in s] for s in words]
    c1 = Counter({"<unk>": sum(c for w, c in n.items() if w not in known)} | {w: n[w] for w in known})
    total = sum(c + 1 for c in c1.values())
    two = Counter(g for s in sents for g in zip(s, s[1:]))
    three = Counter(g for s in sents for g in zip(s, s[1:], s[2:]))
    all2, kept2, types2 = Counter(), Counter(), Counter()
    for (u, _), c in two.items():
        all2[u] += c
        if c >= least:
            kept2[u] += c
            types2[u] += 1
    all3, kept3, types3 = Counter(), Counter(), Counter()
    for (t, u, _), c in three.items():
        all3[t, u] += c
        if c >= least:
            kept3[t, u] += c
            types3[t, u] += 1

    def p1(w):
        return (c1[w] + 1) / total

    def p2(u, w):
        back = 1 - (kept2[u] - discount * types2[u]) / all2[u] if all2[u] else 1
        return (two[u, w] - discount) / all2[u] + back * p1(w) if two[u, w] >= least else back * p1(w)

    def p3(t, u, w):
        if two[t, u] < least:
            return p2(u, w)
        back = 1 - (kept3[t, u] - discount * types3[t, u]) / max(1, all3[t, u])
        return (three[t, u, w] - discount) / all3[t, u] + back * p2(u, w) if three[t, u, w] >= least else back * p2(u, w)

    def score(s):
        return sum(np.log10(p2(s[0], s[1]) if i == 1 else p3(*s[i - 2 : i + 1])) for i in range(1, len(s)))

    return [score(s) for s in sents], (p2, p3, set(c1))


@pytest.mark.parametrize("shard_tokens", [4_000_000, 300])
def test_language_model_against_dictionaries(spark, shard_tokens):
    rng = np.random.default_rng(8)
    vocabulary = [prose(k, 1) for k in range(40)]
    texts = [" ".join(vocabulary[int(min(39, rng.exponential(6)))] for _ in range(rng.integers(1, 60))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in ngram_lm.score(df, shard_tokens=shard_tokens).collect()}
    want, (p2, p3, words) = brute_lm(texts)
    for i, w in enumerate(want):
        n = len(texts[i].split())
        assert got[i]["n_words"] == n and got[i]["log10_prob"] == pytest.approx(w, abs=0.02 * n + 0.02)
        assert got[i]["perplexity"] == pytest.approx(10 ** (-got[i]["log10_prob"] / n))
    # the distributions sum to one
    assert sum(p2(vocabulary[0], w) for w in words) == pytest.approx(1)
    assert sum(p3(vocabulary[0], vocabulary[1], w) for w in words) == pytest.approx(1)


def test_language_model_edges(spark):
    schema = "doc_id long, text string, n long, shard int, h long"
    long = prose(3, 150_000)
    rows = [(None, "a b a b", 1, 1, 1), (1, None, 1, 1, 1), (2, "", 1, 1, 1), (3, "...", 1, 1, 1), (4, long, 1, 1, 1), (5, "a b", 1, 1, 1), (5, "a b", 1, 1, 1)]
    df = spark.createDataFrame(rows, schema)
    got = ngram_lm.score(df).collect()
    assert len(got) == 7 and all(r["perplexity"] is None and r["log10_prob"] == 0 for r in got if r["doc_id"] in (1, 2, 3))
    assert next(r["n_words"] for r in got if r["doc_id"] == 4) == 150_000
    assert len({r["log10_prob"] for r in got if r["doc_id"] == 5}) == 1
    assert ngram_lm.score(df.limit(0)).count() == 0
    assert ngram_lm.score(df.where("doc_id in (1, 2)")).count() == 2


# --- quality ---


def labelled(spark, n=600):
    rng = np.random.default_rng(6)
    docs, labels = [], []
    for i in range(n):
        good = i % 2
        docs.append((i, prose(i, int(rng.integers(20, 90))) + "." if good else " | ".join(["BUY NOW!!"] * int(rng.integers(3, 12))) + " " + prose(i, 5)))
        labels.append((i, good))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_quality_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    model = gam.fit_quality(docs.where("doc_id < 400"), labels)
    got = gam.classify(docs.where("doc_id >= 400"), model=model).join(labels, "doc_id").select("good", labels["quality"].alias("label")).collect()
    assert np.mean([r["good"] == bool(r["label"]) for r in got]) > 0.97


def test_tables_and_pairs_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = gam.Gam.fit(x[:3000], y[:3000], rounds=30, pair_rounds=60, pairs=2)
    assert (0, 1) in model.pairs
    assert ((model.predict(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9
    plain = gam.Gam.fit(x[:3000], y[:3000], rounds=30, pairs=0)
    assert ((plain.predict(x[3000:]) > 0.5) == y[3000:]).mean() < 0.65


def test_features_are_those_of_the_text():
    texts = ["One two two.\nOne two two.\n\nthree | four!!", "", "ABC 123", "x" * 50_000, "\0 a \0 b"]
    f = gam.features(texts)
    again = np.concatenate([gam.features([t]) for t in texts])
    assert np.allclose(f, again)
    col = {n: k for k, n in enumerate(gam.FEATURES)}
    words = re.findall(r"\w+", texts[0].lower())
    assert f[0, col["log_words"]] == pytest.approx(np.log1p(len(words)))
    assert f[0, col["distinct"]] == pytest.approx(len(set(words)) / len(words))
    assert f[0, col["top_word"]] == pytest.approx(max(Counter(words).values()) / len(words))
    assert f[0, col["exclamations"]] == pytest.approx(2 / len(words)) and f[0, col["repeated_lines"]] > 0
    assert f[2, col["digits"]] == pytest.approx(3 / 7) and f[2, col["upper"]] == 1 and not f[1].any()


def test_quality_edges(spark):
    docs, labels = labelled(spark, 60)
    schema = "doc_id long, text string, quality int, x double, good string"
    rows = [(None, prose(1, 20) + ".", 1, 1.0, "a"), (1, None, 1, 1.0, "a"), (2, "", 1, 1.0, "a"), (3, "!!!", 1, 1.0, "a"), (4, prose(2, 200_000), 1, 1.0, "a"), (4, prose(2, 30), 1, 1.0, "a")]
    df = spark.createDataFrame(rows, schema)
    got = gam.classify(df, model=gam.fit_quality(docs, labels)).collect()
    assert len(got) == 6 and all(r["quality"] == 0 and not r["good"] for r in got if r["doc_id"] in (1, 2, 3))
    odd = spark.createDataFrame([(None, 1), (1, None), (4, 1), (4, 1)], "doc_id long, quality int")
    assert len({round(r["quality"], 9) for r in gam.classify(df, odd).where("doc_id = 4 or doc_id is null").collect()}) == 1
    assert gam.classify(df.limit(0), labels.limit(0)).count() == 0 and gam.classify(df, labels.limit(0)).count() == 6
