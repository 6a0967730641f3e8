import collections
import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.operators import aggregates, catalog, chunking, dense, evaluate, filters, fusion, lexical, lifecycle


@pytest.mark.parametrize("text", ["", "short", "x" * 40, "x" * 1200, "x" * 2200, "x" * 2201, "a\r\nb" * 700, "word " * 900])
def test_windows_agree(spark, text):
    got = chunking.char_windows(spark.createDataFrame([(1, text)], "id int, t string"), "t").orderBy("chunk_index").collect()
    assert [(r.chunk, r.char_start, r.char_end) for r in got] == list(chunking.windows(text, 1200, 200, 40))
    assert [r.chunk_index for r in got] == list(range(len(got)))


@given(st.text(alphabet="ab\n ", max_size=400), st.integers(2, 60), st.integers(0, 30))
@settings(max_examples=100, deadline=None)
def test_windows_cover_the_text(text, size, overlap):
    if overlap >= size:
        with pytest.raises(ValueError):
            list(chunking.windows(text, size, overlap, 1))
        return
    clean, at = text.strip(), 0
    for piece, start, end in chunking.windows(text, size, overlap, 1):
        assert clean[start:end] == piece and start <= at
        at = end
    assert at == len(clean)


def test_sections():
    text = "intro\n# A\none\n```\n# not\n```\n## A1\ntwo\n# B\nthree"
    assert [(p, text[a:b].split("\n")[0]) for p, a, b in chunking.markdown_sections(text)] == [([], "intro"), (["A"], "# A"), (["A", "A1"], "## A1"), (["B"], "# B")]


def test_structure():
    out = chunking.structure_windows("# A\n" + "x " * 700 + "\n# B\nsmall but long enough to be a chunk of its own", title="T", url="u")
    assert all(t.startswith("T — A (u)\n\n") for t, _, _ in out[:2]) and out[-1][0].startswith("T — B (u)")
    packed = chunking.structure_windows("# A\none one one one one\n# B\ntwo two two two two\n# C\nthree", min_chars=10)
    assert len(packed) == 1 and packed[0][0].startswith("A\n\n# A")
    assert chunking.structure_windows(None) == [] and len(chunking.structure_windows("y" * 60, title="t" * 300)[0][0]) == 162 + 60


def test_heading_windows():
    out = chunking.heading_windows("before\n# A\n\n" + "\n\n".join(["p" * 600] * 3) + "\n# B\n\nend")
    assert [h for h, *_ in out] == ["Loose", "A", "A", "A", "B"]
    assert out[0][1] == "# Loose\n\nbefore" and all(b - a > 0 for *_, a, b in out)


ROWS = [("k1", "c1", None, {"companyId": "c9"}), ("k2", None, "u1", {"companyId": "c1"}), ("k3", "c2", "u2", {}), ("k4", None, None, None)]
KINDS = "k string, company_id string, user_id string, metadata map<string,string>"


@pytest.mark.parametrize(
    ("given_", "want"),
    [({"company_id": "c1"}, ["k1", "k2"]), ({"user_id": {"$in": ["u1", None]}}, ["k1", "k2", "k4"]), ({"metadata.companyId": "c1"}, ["k2"]), ({"company_id": {"$in": ["c1", "c2"]}}, ["k1", "k2", "k3"]), ({"user_id": None}, ["k1", "k4"]), ({}, ["k1", "k2", "k3", "k4"]), ({"user_id": {"$in": []}}, [])],
)
def test_chunk_filters(spark, given_, want):
    from lodestar.schema import company_of_chunk

    assert [r.k for r in spark.createDataFrame(ROWS, KINDS).where(filters.chunk_filter(given_, company_of_chunk())).orderBy("k").collect()] == want


def test_entry_filters_and_routes(spark):
    rows = spark.createDataFrame([("a", "1", {"parentId": "p"}), ("b", None, {}), ("c", None, {"companyId": "1"})], "id string, companyId string, metadata map<string,string>")
    keys = lambda f: [r.id for r in rows.where(filters.entry_filter(f)).orderBy("id").collect()]
    assert keys({"companyId": 1}) == ["a", "c"] and keys({"parent_id": "p"}) == ["a"] and keys({"companyId": None}) == []
    assert filters.route_company({"metadata.companyId": "x"}) == "x" and filters.route_company({"company_id": {"$in": ["a", "b"]}}) is None
    assert filters.route_company({"company_id": {"$in": ["a"]}}) == "a" and filters.parse_filter('{"a": 1}') == {"a": 1} and filters.parse_filter("") is None
    with pytest.raises(ValueError):
        filters.parse_filter("[1]")


def test_dense_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(-3, 4, (200, 8)).astype(float)
    v = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)] + [(900, None), (901, [1.0])], "faiss_id long, embedding array<float>")
    q = spark.createDataFrame([(i, [float(a) for a in x[i]]) for i in range(0, 200, 20)], "qid long, embedding array<float>")
    got = {(r.qid, r.rank): (r.faiss_id, r.score) for r in dense.top_k(v, q, 7, strict=False).collect()}
    with pytest.raises(Exception, match="dimensions"):
        dense.top_k(v, q, 7).collect()
    for i in range(0, 200, 20):
        order = sorted(range(200), key=lambda j: (-(x[i] @ x[j]), j))[:7]
        assert [got[i, n + 1] for n in range(7)] == [(j, float(x[i] @ x[j])) for j in order]
    dense.QUERY_BLOCK, old = 3, dense.QUERY_BLOCK
    try:
        assert {(r.qid, r.rank): (r.faiss_id, r.score) for r in dense.top_k(v, q, 7, strict=False).collect()} == got
    finally:
        dense.QUERY_BLOCK = old
    with pytest.raises(ValueError):
        dense.checked_dimension(v.where("embedding is not null"))
    assert dense.over_fetch(10, hybrid=True) == 40 and dense.over_fetch(10, filtered=True) == 5000


def test_rrf(spark):
    side = lambda rows: spark.createDataFrame(rows, "qid long, chunk_id string, score double, rank int")
    got = fusion.rrf(side([(1, "a", 0.9, 1), (1, "b", 0.8, 2)]), side([(1, "a", 0.1, 1), (1, "c", 0.2, 2)])).orderBy("position").collect()
    assert [(r.chunk_id, r.score, r.rrf) for r in got] == [("a", 0.9, round(2 / 60, 6)), ("b", 0.8, round(1 / 61, 6)), ("c", 0.2, round(1 / 61, 6))]


def test_rrf_without_chunk_ids(spark):
    """Hits without a chunk are fused by vector and document."""
    side = lambda rows: spark.createDataFrame(rows, "qid long, chunk_id string, faiss_id long, doc_id string, score double, rank int")
    got = fusion.rrf(side([(1, None, 5, "d", 0.9, 1), (1, None, 6, "d", 0.8, 2)]), side([(1, None, 6, "d", 0.1, 1)]), ("chunk_id", "faiss_id", "doc_id"), fusion.chunk_key()).orderBy("position").collect()
    assert [(r.faiss_id, r.score, r.rrf) for r in got] == [(6, 0.8, round(1 / 61 + 1 / 60, 6)), (5, 0.9, round(1 / 60, 6))]


def test_promotion(spark):
    rows = spark.createDataFrame([(1, "inline", "d1", 0.91, 0, "x", "we sell red shoes here"), (1, "head", "d2", 0.64, 1, "y", "# Red Shoes\nbody"), (1, "none", "d2", 0.99, 2, "z", "blue")], "qid long, k string, doc_id string, score double, position int, title string, text string")
    got = fusion.promote(rows, fusion.title_match(F.lit("Red shoes"), F.col("title"), F.col("text"))).orderBy("position").collect()
    assert [(r.k, r.title_match) for r in got] == [("head", 2), ("inline", 1), ("none", 0)]
    kept = fusion.one_per_document(spark.createDataFrame(got), F.col("doc_id")).orderBy("position").collect()
    assert [r.k for r in kept] == ["head", "inline"]
    short = fusion.promote(rows, F.lit(0).alias("m"), F.lit(True)).orderBy("position").collect()
    assert [r.k for r in short] == ["inline", "head", "none"] and fusion.one_per_document(spark.createDataFrame(short), F.col("doc_id"), F.lit(True)).count() == 3
    ranked = fusion.rerank(spark.createDataFrame([(1, "a", 0, 0.1), (1, "b", 1, 0.9), (1, "c", 2, 0.5), (1, "d", 3, 9.0)], "qid long, k string, position int, s double"), F.col("s"), 3).orderBy("position").collect()
    assert [r.k for r in ranked] == ["b", "c", "a", "d"]
    assert rows.select(fusion.title_match(F.lit("ab"), F.col("title"), F.col("text"))).first()[0] == 0


def bm25_by_hand(rows, queries, k):
    cut = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    words = {key: cut(t) for key, t in rows}
    mean = sum(map(len, words.values())) / len(words)
    df = collections.Counter(w for ws in words.values() for w in set(ws))
    out = {}
    for qid, text in queries:
        scores = {}
        for key, ws in words.items():
            shared = set(cut(text)) & set(ws)
            if shared:
                scores[key] = round(sum(math.log(1 + (len(words) - df[w] + 0.5) / (df[w] + 0.5)) * ws.count(w) * 2.2 / (ws.count(w) + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w in shared), 6)
        for i, key in enumerate(sorted(scores, key=lambda x: (-scores[x], x))[:k]):
            out[qid, i + 1] = (key, pytest.approx(scores[key], abs=2e-6))
    return out


def test_lexical(spark):
    rows = spark.createDataFrame([("1", "Red red shoe"), ("2", "blue shoe"), ("3", None)], "k string, text string")
    got = {(r.qid, r.k): r.score for r in lexical.top_k(rows, "k", spark.createDataFrame([(1, "RED"), (2, " "), (3, "shoe!"), (4, None)], "qid long, text string"), 9).collect()}
    assert set(got) == {(1, "1"), (3, "1"), (3, "2")} and got[3, "2"] > got[3, "1"]
    assert lexical.top_k(rows.limit(0), "k", spark.createDataFrame([(1, "red")], "qid long, text string"), 9).collect() == []
    assert lexical.top_k(rows, "k", spark.createDataFrame([], "qid long, text string"), 9).collect() == []


def test_lexical_against_brute_force(spark, monkeypatch):
    """Common and rare words, ties, several blocks of queries, several batches and several blocks of cells."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(vocabulary[min(59, int(rng.paretovariate(0.8)) - 1)] for _ in range(n))
    rows = [(f"k{i}", text(rng.randint(0, 30))) for i in range(300)]
    rows += [(f"copy{i}", rows[0][1]) for i in range(20)]
    queries = [(i, text(rng.randint(1, 6))) for i in range(40)]
    df, q = spark.createDataFrame(rows, "k string, text string").repartition(3), spark.createDataFrame(queries, "qid long, text string")
    want = bm25_by_hand(rows, queries, 7)
    found = lambda: {(r.qid, r.rank): (r.k, r.score) for r in lexical.top_k(df, "k", q, 7).collect()}
    assert found() == want
    monkeypatch.setattr(lexical, "QUERY_BLOCK", 9)
    monkeypatch.setattr(lexical, "CELLS", 500)
    assert found() == want


@given(st.lists(st.tuples(st.integers(0, 30), st.text(alphabet="abc", min_size=1, max_size=6)), max_size=5))
@settings(max_examples=15, deadline=None)
def test_reconstruct(spark, pieces):
    out = ""
    for i, (start, text) in sorted(enumerate(pieces), key=lambda p: (p[1][0] or p[0], p[0])):
        begin = start or len(out)
        out = out.ljust(begin)
        out += text[len(out) - begin :] if len(out) - begin < len(text) else ""
    df = spark.createDataFrame([([(s, i, t) for i, (s, t) in enumerate(pieces)],)], "c array<struct<char_start:int,chunk_index:int,text:string>>")
    assert df.select(aggregates.reconstruct(F.col("c"))).first()[0] == out


def test_budget(spark):
    df = spark.createDataFrame([(1, i, "x" * n) for i, n in enumerate((30, 50, 40, 5))] + [(2, 0, "y" * 300)], "k int, o int, t string")
    got = aggregates.within_budget(df, ["k"], [F.col("o")], "t", 100).collect()
    assert sorted((r.k, r.o, len(r.t)) for r in got) == [(1, 0, 30), (1, 1, 50), (2, 0, 100)]


def test_versions(spark):
    kinds = "doc_id string, faiss_id long, ingest_version string, chunk_index int, text string"
    chunks = spark.createDataFrame([("d1", 1, None, 0, "a"), ("d1", 2, "old", 0, "b"), ("d2", 3, "old", 0, "c")], kinds)
    docs = spark.createDataFrame([("d2", "ready", "old")], "doc_id string, status string, active_ingest_version string")
    kept, pointed = lifecycle.swap_versions(chunks, docs, spark.createDataFrame([("d1", 4, "new", 0, "d"), ("d1", 5, "new", 1, "e")], kinds))
    assert sorted(r.faiss_id for r in kept.collect()) == [3, 4, 5]
    assert {r.doc_id: (r.status, r.active_ingest_version) for r in pointed.collect()} == {"d1": ("ready", "new"), "d2": ("ready", "old")}
    assert sorted(r.faiss_id for r in lifecycle.keep_version(chunks, "d1", "old").collect()) == [2, 3]
    with pytest.raises(ValueError):
        lifecycle.removal_plan(chunks, docs, F.lit(True), "other")


def test_rebuild_and_removal(spark):
    vectors = spark.createDataFrame([(i,) for i in range(1, 6)], "faiss_id long")
    kept, report = lifecycle.rebuilt(vectors, spark.createDataFrame([(1,), (3,), (5,), (404,)], "faiss_id long"))
    assert sorted(r.faiss_id for r in kept.collect()) == [1, 3, 5]
    assert report.first().asDict() == {"source": 5, "live": 4, "kept": 3, "missing": 1, "reclaimed": 2}
    ids = spark.createDataFrame([("c", 1), ("c", 8), ("c", 9)], "company string, faiss_id long")
    assert tuple(lifecycle.removal_report(ids, vectors, ["company"]).first()) == ("c", 3, 1, 2)


def test_merges(spark):
    old = spark.createDataFrame([(1, "a", "t0"), (2, "b", "t0")], "k int, v string, created string")
    new = spark.createDataFrame([(2, "B", "t1"), (3, "C", "t1")], "k int, v string, created string")
    assert sorted(tuple(r) for r in lifecycle.upsert(old, new, ["k"], keep=("created",)).collect()) == [(1, "a", "t0"), (2, "B", "t0"), (3, "C", "t1")]
    assert sorted(tuple(r) for r in lifecycle.update(old, spark.createDataFrame([(2, "x"), (9, "y")], "k int, v string"), ["k"]).collect()) == [(1, "a", "t0"), (2, "x", "t0")]
    ids = [r.id for r in lifecycle.reserve_ids(spark.range(50).repartition(5).withColumnRenamed("id", "n"), [F.col("n")], 100).orderBy("n").collect()]
    assert ids == list(range(101, 151))


def test_leases():
    ok, lock = lifecycle.acquire(None, "j1", 0)
    assert ok and lock["leaseUntil"] == 900
    assert not lifecycle.acquire(lock, "j2", 10)[0] and lifecycle.acquire(lock, "j1", 10)[0] and lifecycle.acquire(lock, "j2", 901)[0]
    assert lifecycle.release(lock, "j2") == (False, lock) and lifecycle.release(lock, "j1") == (True, None)
    assert lifecycle.renew(lock, "j1", 100)[1]["leaseUntil"] == 1000 and not lifecycle.renew(None, "j1", 0)[0]


def test_paths_with_cycles(spark):
    e = spark.createDataFrame([("a", None, "A"), ("b", "a", "B"), ("c", "b", "C"), ("x", "y", "X"), ("y", "x", "Y"), ("o", "gone", "O")], "id string, parent_id string, text string")
    got = {r.id: r.ids for r in catalog.paths(e).collect()}
    assert got == {"a": ["a"], "b": ["a", "b"], "c": ["a", "b", "c"], "x": ["y", "x"], "y": ["x", "y"], "o": ["o"]}


def test_measures(spark):
    hits = spark.createDataFrame([(1, 1, "n"), (1, 2, "t1"), (1, 3, "n2"), (2, 3, "t3")], "query long, rank int, key string")
    targets = spark.createDataFrame([(1, "t1"), (1, "t2"), (2, "t3"), (3, "t4")], "query long, key string")
    got = {r.query: r for r in evaluate.measures(hits, targets, 2).collect()}
    assert (got[1].recall, got[1].rr) == (0.5, 0.5) and math.isclose(got[1].ndcg, (1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    assert (got[2].recall, got[2].ndcg) == (0.0, 0.0) and math.isclose(got[2].rr, 1 / 3) and got[3].rr == 0.0
    p = evaluate.percentiles(spark.createDataFrame([(1, float(v)) for v in (1, 2, 3, 4)], "k int, v double"), ["k"], "v", {"p50": 0.5, "p95": 0.95}).first()
    assert p.p50 == 2.5 and math.isclose(p.p95, 3.85)
    assert random.Random(1).random() < 1
