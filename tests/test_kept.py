"""What the library keeps: commits over several tables, the store of vectors in parts, the lexical index, folders by footers, and ancestors by doubling."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from lodestar.operators import catalog, lexical, lexindex, vectorstore
from lodestar.plans import build
from lodestar.sources import commits, footers


def rows(spark, n, value="a", start=0):
    return spark.createDataFrame([(i, f"c{i % 3}", value) for i in range(start, start + n)], "id long, company string, value string")


# ---- commits


def test_readers_see_one_commit(spark, tmp_path):
    root, both = str(tmp_path), ["c0", "c1", "c2"]
    first = build.commit_ingest({"chunks": rows(spark, 9), "documents": rows(spark, 3)}, root, F.col("company"), both)
    second = build.commit_ingest({"chunks": rows(spark, 30, "b").where("company = 'c1'"), "documents": rows(spark, 3, "b").where("company = 'c1'")}, root, F.col("company"), ["c1"])
    assert (first.version, second.version, commits.latest(spark, root)) == (1, 2, 2)
    values = lambda s, t: sorted(r.value for r in s.read(spark, t).collect())
    assert values(first, "chunks") == ["a"] * 9 and values(first, "documents") == ["a"] * 3
    assert values(second, "chunks") == ["a"] * 6 + ["b"] * 10 and values(second, "documents") == ["a", "a", "b"]
    assert values(commits.snapshot(spark, root, 1), "chunks") == ["a"] * 9
    assert second.read(spark, "chunks", ["c1"]).count() == 10 and second.read(spark, "chunks", ["none"]).count() == 0
    assert {f for p in ("c0", "c2") for f in second.folders("chunks", [p])} <= set(first.folders("chunks"))  # untouched parts keep their folders
    with pytest.raises(ValueError, match="not among"):
        build.commit_ingest({"chunks": rows(spark, 3)}, root, F.col("company"), ["c1"])
    with pytest.raises(KeyError):
        second.read(spark, "nothing")


def test_of_two_writers_one_sees_a_conflict(spark, tmp_path):
    root = str(tmp_path)
    build.commit_ingest({"chunks": rows(spark, 9)}, root, F.col("company"), ["c0", "c1", "c2"])
    base = commits.snapshot(spark, root)
    one, other, apart = ({"chunks": (commits.stage(rows(spark, 9, v).where(f"company = '{c}'"), root, "chunks", F.col("company")), [c])} for v, c in (("x", "c1"), ("y", "c1"), ("z", "c2")))
    commits.commit(spark, base, replaced=one)
    with pytest.raises(commits.Conflict):
        commits.commit(spark, base, replaced=other)
    last = commits.commit(spark, base, replaced=apart)  # another part: on top of the newer commit
    assert last.version == 3 and sorted({r.value for r in last.read(spark, "chunks").collect()}) == ["a", "x", "z"]
    worked = []

    def again(now):
        worked.append(now.version)
        if len(worked) == 1:  # another writer comes between
            commits.commit(spark, now, replaced=other)
        return {"replaced": one}

    assert commits.transact(spark, root, again).version == 5 and worked == [3, 4]


def test_commits_at_the_same_time(spark, tmp_path):
    """Eight writers add at once: each gets a number of its own and nothing is lost."""
    root, made, errors = str(tmp_path), [], []
    staged = [commits.stage(rows(spark, 1, f"w{i}"), root, "log") for i in range(8)]

    def add(i):
        try:
            made.append(commits.commit(spark, commits.Snapshot(root), added={"log": staged[i]}).version)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=add, args=(i,)) for i in range(8)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert not errors and sorted(made) == list(range(1, 9))
    assert sorted(r.value for r in commits.snapshot(spark, root).read(spark, "log").collect()) == [f"w{i}" for i in range(8)]


def test_numbered_commits_and_vacuum(spark, tmp_path):
    root = str(tmp_path)
    for number in (1, 1, 2, 1):
        base = commits.snapshot(spark, root)
        commits.commit(spark, base, added={"log": commits.stage(rows(spark, 1, f"n{number}"), root, "log")}, writer="w", number=number)
    now = commits.snapshot(spark, root)
    assert now.version == 2 and sorted(r.value for r in now.read(spark, "log").collect()) == ["n1", "n2"]
    assert commits.vacuum(spark, root) == 2  # what the repeated commits had staged
    assert commits.snapshot(spark, root).read(spark, "log").count() == 2 and commits.latest(spark, root) == 2


# ---- vectors


def vectors(spark, pairs):
    return spark.createDataFrame([(i, c, [float(x), 1.0]) for i, c, x in pairs], "faiss_id long, company_id string, embedding array<float>")


def test_vector_store(spark, tmp_path):
    """Against a dictionary, through random changes; parts that no id falls into keep their files."""
    root, rng, want = str(tmp_path), random.Random(1), {}
    for turn in range(4):
        pairs = {rng.randrange(60): (rng.choice((None, "a", "b/c")), turn) for _ in range(40 if not turn else 4)}
        before = commits.snapshot(spark, root)
        after = vectorstore.upsert(vectors(spark, [(i, c, x) for i, (c, x) in pairs.items()]), root, 4)
        touched = {vectorstore_part for vectorstore_part in after.changed["vectors"]}
        assert all(after.tables["vectors"].get(p) == f for p, f in before.tables.get("vectors", {}).items() if p not in touched)
        want |= pairs
        gone = rng.sample(sorted(want), 2)
        vectorstore.remove(spark.createDataFrame([(i,) for i in [*gone, 999]], "faiss_id long"), root, 4)
        want = {i: v for i, v in want.items() if i not in gone}
        assert {r.faiss_id: (r.company_id, int(r.embedding[0])) for r in vectorstore.read(spark, root, everything=True).collect()} == want
    for company in (None, "a", "b/c", "nobody"):
        assert {r.faiss_id for r in vectorstore.read(spark, root, company).collect()} == {i for i, (c, _) in want.items() if c == company}
    version = commits.latest(spark, root)
    for _ in range(2):
        vectorstore.upsert(vectors(spark, [(1, "a", 7), (1, "a", 8)]), root, 4, writer="job", number=5)
    assert commits.latest(spark, root) == version + 1 and vectorstore.read(spark, root, "a").where("faiss_id = 1").first().embedding[0] == 8
    with pytest.raises(Exception, match="without an id"):
        vectorstore.upsert(vectors(spark, [(None, "a", 1)]), root, 4)


def test_vectors_move_once(spark, tmp_path):
    root = str(tmp_path)
    vectorstore.upsert(vectors(spark, [(i, None, i) for i in range(10)]), root, 4)
    chunks = spark.createDataFrame([(i, "a" if i % 2 else None) for i in range(8)], "faiss_id long, company string")
    with pytest.raises(ValueError, match="no vector"):
        vectorstore.move_to_companies(chunks.union(spark.createDataFrame([(77, "a")], chunks.schema)), F.col("company"), root, buckets=4)
    assert commits.latest(spark, root) == 1
    for _ in range(2):
        assert vectorstore.move_to_companies(chunks, F.col("company"), root, buckets=4).version == 2
    assert {r.faiss_id for r in vectorstore.read(spark, root, "a").collect()} == {1, 3, 5, 7} and vectorstore.read(spark, root).count() == 6


# ---- the lexical index


def searched(found):
    return sorted((r.qid, r.key, r.score, r.rank) for r in found.collect())


def test_index_finds_what_a_scan_finds(spark, tmp_path):
    """Through updates, with ties, nulls, empty texts and very common words; the best by block maxima are those of all rows."""
    rng, root = random.Random(2), str(tmp_path / "index")
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)]
    text = lambda: rng.choice((None, "", " ;", *[" ".join(rng.choices(words, k=rng.choice((1, 5, 60)))) for _ in range(30)]))
    kept = {f"k{i:04}": text() for i in range(1500)} | {f"same{i}": "w1 w2 tie" for i in range(40)}
    frame = lambda d: spark.createDataFrame(list(d.items()), "key string, text string")
    queries = spark.createDataFrame([("a", "w1 w2"), ("b", "tie"), ("c", " ".join(words[:50])), ("d", "nothing has this"), ("e", ""), ("f", None), (None, "w1")], "qid string, text string")
    lexindex.build(frame(kept), "key", root, parts=8, shards=3)
    same = lambda: searched(lexindex.top_k(spark, root, "key", queries, 7)) == searched(lexical.top_k(frame(kept), "key", queries, 7))
    assert same()
    for turn in range(2):
        new = {k: text() for k in rng.sample(sorted(kept), 200)} | {f"new{turn}-{i}": text() for i in range(50)}
        gone = [k for k in rng.sample(sorted(kept), 150) if k not in new]
        lexindex.update(frame(new), root, "key", frame(dict.fromkeys([*gone, "unknown"])), shards=2)
        kept = {k: t for k, t in (kept | new).items() if k not in gone}
        assert same()
    old = lexindex.top_k(spark, root, "key", queries, 3, version=1)
    assert old.count() > 0 and commits.latest(spark, root) == 3
    with pytest.raises(FileExistsError):
        lexindex.build(frame(kept), "key", root)
    with pytest.raises(Exception, match="without a key"):
        lexindex.update(spark.createDataFrame([(None, "x")], "key string, text string"), root, "key")


def test_index_reads_the_parts_of_its_terms(spark, tmp_path):
    root = str(tmp_path)
    lexindex.build(spark.createDataFrame([(i, f"common word{i}") for i in range(200)], "key long, text string"), "key", root, parts=16, shards=2)
    found = lexindex.top_k(spark, root, "key", spark.createDataFrame([(1, "word7 word9")], "qid long, text string"), 5)
    assert [r.key for r in found.orderBy("rank").collect()] == [7, 9]
    read = {f.split("_part=")[1].split("/")[0] for f in found.inputFiles() if "_part=" in f}
    assert len(read - {"docs"}) <= 2
    empty = str(tmp_path / "empty")
    lexindex.build(spark.createDataFrame([], "key long, text string"), "key", empty)
    assert lexindex.top_k(spark, empty, "key", spark.createDataFrame([(1, "x")], "qid long, text string"), 5).count() == 0


def test_most_ranges_are_passed_over():
    """One row is far better than all others: the ranges that cannot reach it are not scored."""
    import numpy as np

    own = lexindex.Ranges.__new__(lexindex.Ranges)
    numbers = np.arange(256 * 400)
    score = np.full(len(numbers), 0.1)
    score[70_000] = 5.0
    starts = np.arange(0, len(numbers) + 1, 256)
    own.terms = {0: (numbers, score, np.arange(400), starts, np.maximum.reduceat(score, starts[:-1]))}
    found, scores = own.best([0], 1)
    assert found.tolist() == [70_000] and scores.tolist() == [5.0]


# ---- footers


def test_row_ranges_open_the_files_they_need(spark, tmp_path):
    folder = tmp_path / "t"
    spark.range(0, 1000, 1, 7).selectExpr("id", "id * 2 AS x").write.parquet(str(folder))
    spark.range(1000, 1010).selectExpr("id", "id * 2 AS x").coalesce(1).write.parquet(str(folder / "sub"))
    (folder / "part-99999-bad.parquet").write_bytes(b"PAR1 nonsense")
    counts = {r.path.rpartition("/")[2][:10]: r.rows for r in footers.file_rows(spark, str(folder)).collect()}
    assert counts["part-99999"] == 0 and footers.total_rows(spark, str(folder)) == 1010 and len(counts) == 8
    for start, end, limit in ((0, None, None), (130, 400, None), (143, 286, None), (990, None, 15), (5, 5, None), (2000, None, None), (300, 900, 1)):
        got = footers.row_range(spark, str(folder), start, end, limit)
        stop = min(x for x in (end, start + limit if limit is not None else None, 1010) if x is not None)
        assert sorted(r.id for r in got.collect()) == list(range(1010))[start:stop]
        assert all(r.id == r._position for r in got.collect())
    part = footers.row_range(spark, str(folder), 150, 200)
    assert len(part.inputFiles()) == 1 and "Exchange hashpartitioning" not in part._jdf.queryExecution().executedPlan().toString()
    one = str(next(folder.glob("part-00000*.parquet")))
    assert footers.total_rows(spark, one) in (142, 143) and footers.row_range(spark, one, 3, 5).count() == 2
    with pytest.raises(ValueError):
        footers.row_range(spark, one, 5, 3)


# ---- ancestors


def test_long_chains_take_few_joins(spark, monkeypatch):
    n, calls = 700, []
    chain = spark.createDataFrame([(f"n{i}", f"n{i - 1}" if i else None, f"t{i}") for i in range(n)], "id string, parent_id string, text string")
    kept = catalog.checkpointed
    monkeypatch.setattr(catalog, "checkpointed", lambda df: calls.append(1) or kept(df))
    found = {r.id: r for r in catalog.paths(chain).collect()}
    assert len(calls) <= 11 and all(found[f"n{i}"].ids == [f"n{j}" for j in range(i + 1)] for i in (0, 1, 2, 63, 64, 65, 699)) and found["n699"].texts[-2:] == ["t698", "t699"]


def test_paths_by_hand(spark):
    """Random parents, with cycles, missing parents and entries that are their own."""
    rng = random.Random(6)
    parent = {f"e{i}": rng.choice((None, "gone", f"e{rng.randrange(60)}", f"e{rng.randrange(60)}", f"e{rng.randrange(60)}")) for i in range(60)}
    want = {}
    for e in parent:
        path, at = [e], parent[e]
        while at in parent and at not in path:
            path.append(at)
            at = parent[at]
        want[e] = path[::-1]
    rows_ = spark.createDataFrame([(e, p, e.upper()) for e, p in parent.items()], "id string, parent_id string, text string")
    got = {r.id: (r.ids, r.texts) for r in catalog.paths(rows_).collect()}
    assert got == {e: (p, [x.upper() for x in p]) for e, p in want.items()}
