"""Stores, content documents and what is loaded, in the odd cases that the queries over the tables do not hold."""

import json

import pytest
from pyspark.sql import functions as F

from lodestar.operators import content, entries, lifecycle, loading
from lodestar.plans import search
from lodestar.sources import sinks

ENTRY = "id long, external_id string, text string, company_id string, metadata map<string,string>, embedding array<float>"
NEW = "int_id string, external_id string, text string, company_id string, metadata map<string,string>, embedding array<float>, at int"


def test_upsert_entries(spark):
    old = spark.createDataFrame([(1, "e1", "one", "c1", {"a": "1"}, [1.0, 0.0]), (5, "e5", "five", None, {}, [0.0, 1.0])], ENTRY)
    new = spark.createDataFrame(
        [("1", None, None, None, {"companyId": "c9", "b": "2"}, [3.0, 4.0], 1), (None, None, "fresh", "c2", {}, [0.0, 2.0], 2), (" name ", None, "named", None, None, None, 3), ("5", "x5", "later", None, {}, [1.0, 0.0], 5), ("5", "x4", "sooner", None, {}, [1.0, 0.0], 4)], NEW
    )
    got = {r.id: r for r in entries.upsert_entries(old, new, [F.col("at")]).collect()}
    assert (got[1].external_id, got[1].text, got[1].company_id, got[1].metadata) == ("e1", "one", "c9", {"b": "2"}) and got[1].embedding == pytest.approx([0.6, 0.8])
    assert (got[6].external_id, got[6].text, got[6].company_id) == ("6", "fresh", "c2") and (got[5].external_id, got[5].text) == ("x5", "later")
    (named,) = [r for r in got.values() if r.external_id == "name"]
    assert named.id > 1 << 62 and named.text == "named" and len(got) == 4
    with pytest.raises(ValueError):
        entries.upsert_entries(old, spark.createDataFrame([("1", None, " ", None, {}, None, 1)], NEW), [F.col("at")])


def test_vectors_in_and_out(spark):
    v = spark.createDataFrame([(1, [3.0, 4.0]), (2, [1.0, 0.0])], "faiss_id long, embedding array<float>")
    more = spark.createDataFrame([(3, [0.0, 2.0])], "faiss_id long, embedding array<float>")
    assert {r.faiss_id: r.embedding for r in entries.add_vectors(v, more).collect()}[3] == [0.0, 1.0]
    for bad in ([(4, [1.0])], [(1, [1.0, 1.0])], [(4, [1.0, 1.0]), (4, [1.0, 1.0])]):
        with pytest.raises(ValueError):
            entries.add_vectors(v, spark.createDataFrame(bad, "faiss_id long, embedding array<float>"))
    kept, asked = entries.replace_vectors(v, spark.createDataFrame([(1,), (9,)], "faiss_id long"), more)
    assert sorted(r.faiss_id for r in kept.collect()) == [2, 3] and asked.first().requested == 2


def test_aliases_and_options(spark):
    rows = spark.createDataFrame([({"Chunk_Size": "7"},), ({"chunkSize": "8", "chunk_size": "9"},), ({},), ({"chunksize": "6"},)], "o map<string,string>")
    assert [r[0] for r in rows.select(content.alias(F.col("o"), "chunk_size", "chunkSize")).collect()] == ["7", "9", None, "6"]
    got = rows.select(content.index_options(F.col("o")).alias("o")).select("o.*").collect()
    assert [(r.chunk_size, r.chunk_overlap, r.min_chars, r.cleanup) for r in got] == [(1200, 200, 80, False), (9, 200, 80, False), (1200, 200, 80, False), (1200, 200, 80, False)]


def test_leases_are_those_of_one_after_the_other(spark):
    """The fold over a table gives what the transitions give, event by event."""
    import random

    rng = random.Random(4)
    events = [(f"d{rng.randrange(3)}", f"j{rng.randrange(3)}", rng.choice(("acquire", "acquire", "renew", "release")), float(i * 300)) for i in range(120)]
    locks, want = {}, {}
    for d, j, action, ts in events:
        lock = locks.get(d)
        if action == "acquire":
            want[d, j, action, ts], locks[d] = lifecycle.acquire(lock and {"jobId": lock["jobId"], "leaseUntil": lock["leaseUntil"]}, j, ts)
        else:
            ok, after = lifecycle.release(lock, j) if action == "release" else lifecycle.renew(lock, j, ts)
            want[d, j, action, ts], locks[d] = ok, after
    got = {(r.document_id, r.job_id, r.action, r.ts): r.granted for r in content.leases(spark.createDataFrame(events, "document_id string, job_id string, action string, ts double")).collect()}
    assert got == want


def test_timeline_of_overtaken_jobs(spark):
    rows = [("d", "old", "queued", 1), ("d", "new", "queued", 2), ("d", "new", "completed", 3), ("d", "old", "failed", 4), ("e", "x", "failed", 1)]
    got = {r.document_id: (r.state, r.job_id, r.failures) for r in content.timeline(spark.createDataFrame(rows, "document_id string, job_id string, state string, ts int")).collect()}
    assert got == {"d": ("completed", "new", 0), "e": ("failed", "x", 1)}


def test_labelled_queries(spark, tmp_path):
    path = tmp_path / "q.json"
    path.write_text(json.dumps([{"query": " a ", "relevant_urls": ["u"]}, {"query": "b", "company_id": "c", "relevant_doc_ids": ["1", "2"], "query_type": "exact"}]))
    got = loading.load_queries(spark, str(path)).orderBy("query").collect()
    assert [(r.query, r.company_id, r.doc_ids, r.urls, r.query_type, r.content_type) for r in got] == [("a", None, [], ["u"], "unknown", "unknown"), ("b", "c", ["1", "2"], [], "exact", "unknown")]
    for bad in ([{"query": " ", "relevant_urls": ["u"]}], [{"query": "a"}], ["text"]):
        path.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            loading.load_queries(spark, str(path))


def test_versions_move_by_one_rename(spark, tmp_path):
    root = f"file://{tmp_path}/v"
    first, second = spark.range(3), spark.range(5)
    sinks.publish_version(first, root, "v1")
    held = sinks.read_current(spark, root)
    sinks.publish_version(second, root, "v1")
    assert sinks.current_version(spark, root) == "v1" and sinks.read_current(spark, root).count() == 5 and held.count() == 3
    assert sinks.drop_unused(spark, root) == 1 and sinks.read_current(spark, root).count() == 5
    with pytest.raises(FileNotFoundError):
        sinks.read_current(spark, f"{root}/none")


def test_search_arguments(spark):
    with pytest.raises(ValueError):
        search.chunk_search(None, None, None, None, 0)
    with pytest.raises(ValueError):
        search.chunk_search(None, None, None, None, 5, radius=-1)
