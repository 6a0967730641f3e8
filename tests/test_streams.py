"""The streams: states of documents under late, repeated and stale reports and a restart; messages of three kinds with failing ones and a failing sink."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from lodestar.operators import content
from lodestar.sources import commits
from lodestar.streaming import dispatch, states

T0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))


def reports(seed, n):
    """What jobs report of ten documents, each report at a second of its own."""
    rng = random.Random(seed)
    seconds = rng.sample(range(100_000), n)
    return [{"document_id": f"d{rng.randrange(10)}", "job_id": f"j{rng.randrange(4)}", "state": rng.choice(("queued", "processing", "completed", "failed")), "ts": (T0 + datetime.timedelta(seconds=s)).isoformat()} for s in seconds]


def in_batch(spark, rows):
    changes = spark.createDataFrame([(r["document_id"], r["job_id"], r["state"], datetime.datetime.fromisoformat(r["ts"])) for r in rows], states.CHANGE).distinct()
    whole = content.timeline(changes)
    return {r.document_id: (r.state, r.job_id, r.q, r.s, r.f, r.failures) for r in whole.select("*", *(F.unix_micros(c).alias(a) for c, a in (("queued_at", "q"), ("started_at", "s"), ("finished_at", "f")))).collect()}


def kept(spark, root):
    return {r.document_id: (r.state, r.job_id, r.queued_at, r.started_at, r.finished_at, r.failures) for r in states.current(spark, root).collect()}


def run(spark, tmp_path, **options):
    changes = spark.readStream.schema(states.CHANGE).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = states.start(spark, changes, str(tmp_path / "out"), str(tmp_path / "checkpoint"), once=True, **options)
    q.awaitTermination(240)
    return q


def test_states_are_those_of_the_batch(spark, tmp_path):
    """Out of order over several files, many reports twice, with restarts between; and a commit that is lost after it was made."""
    rows = reports(1, 120)
    rng = random.Random(2)
    for i in range(3):
        put(tmp_path / "in", f"{i}.json", rows[i * 40 : (i + 1) * 40] + rng.sample(rows[: (i + 1) * 40], 15) + [{"document_id": None, "job_id": "x", "state": "queued", "ts": rows[0]["ts"]}, {"document_id": "d1"}])
        run(spark, tmp_path, lateness_seconds=1e6)
        assert kept(spark, str(tmp_path / "out")) == in_batch(spark, rows[: (i + 1) * 40])
    before, version = states.current(spark, str(tmp_path / "out")).collect(), commits.latest(spark, str(tmp_path / "out"))
    # Spark lost the end of its last batch, so that it runs that batch again
    done = max((tmp_path / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    done.unlink()
    (done.parent / f".{done.name}.crc").unlink(missing_ok=True)
    run(spark, tmp_path, lateness_seconds=1e6)
    assert sorted(states.current(spark, str(tmp_path / "out")).collect()) == sorted(before) and commits.latest(spark, str(tmp_path / "out")) == version


def test_late_reports_and_leases(spark, tmp_path):
    """Beyond the lateness a report counts as late alone; a document that stays in processing is said to, once."""
    at = lambda s: (T0 + datetime.timedelta(seconds=s)).isoformat()
    one = lambda job, state, s, d="a": {"document_id": d, "job_id": job, "state": state, "ts": at(s)}
    put(tmp_path / "in", "0.json", [one("j1", "queued", 0), one("j1", "processing", 10), one("j2", "queued", 0, "b"), one("j2", "completed", 5, "b")])
    run(spark, tmp_path, lateness_seconds=60, lease_seconds=0.001)
    put(tmp_path / "in", "1.json", [one("j2", "processing", 500, "b"), one("j3", "queued", 495, "b"), one("j9", "queued", 100, "b")])
    run(spark, tmp_path, lateness_seconds=60, lease_seconds=0.001)
    put(tmp_path / "in", "2.json", [one("j9", "failed", 300, "b")])
    run(spark, tmp_path, lateness_seconds=60, lease_seconds=0.001)
    rows = commits.snapshot(spark, str(tmp_path / "out")).read(spark, "transitions").collect()
    a, b = (sorted((r for r in rows if r.document_id == d), key=lambda r: r.number) for d in "ab")
    assert [(r.state, r.expired) for r in a] == [("processing", False), ("processing", True)] and [r.number for r in a] == [1, 2]
    assert [(r.state, r.job_id) for r in b] == [("completed", "j2"), ("queued", "j3")]  # the report of 500 is of a job that another was queued after
    final = states.current(spark, str(tmp_path / "out")).where("document_id = 'b'").first()
    assert final.failures == 0 and final.state == "queued"


def test_fold_in_any_order():
    rng = random.Random(5)
    for _ in range(50):
        changes = [(s, f"j{rng.randrange(3)}", rng.choice(("queued", "processing", "completed", "failed"))) for s in rng.sample(range(100), 12)]
        cut = sorted(changes)[rng.randrange(12)][0]
        whole = states.folded(states.NOTHING, changes)
        assert whole == states.folded(states.folded(states.NOTHING, [c for c in changes if c[0] < cut]), [c for c in changes if c[0] >= cut])


LONG = "All of it is said here. " * 100


def messages():
    pair = lambda t, i=None: {"text": t, "chunk_index": i}
    return [
        {"payload_type": "embedded_chunks", "job_id": "e1", "doc_id": "w1", "companyId": "c1", "chunks": [pair("one"), pair("two", 7)], "embeddings": [[1.0, 0.0], [0.0, 1.0]]},
        {"payload_type": "embedded_chunks", "job_id": "e2", "doc_id": "w2", "chunks": [pair("one")], "embeddings": []},
        {"payload_type": "embedded_chunks", "job_id": "e3", "doc_id": "w3", "chunks": [pair("one"), pair("two")], "embeddings": [[1.0], [1.0, 2.0]]},
        {"payload_type": "embedded_chunks", "job_id": "e4", "doc_id": "w4", "chunks": [], "embeddings": []},
        {"jobId": "k1", "companyId": "c1", "documentIds": ["1", "2", "99", "1", "3"]},
        {"jobId": "k2", "document_ids": ["3"]},
        {"job_id": "l1", "doc_id": "t1", "text": LONG, "metadata": {"companyId": "c7"}},
        {"job_id": "l2", "doc_id": "t2", "text": "  "},
        {"job_id": "l3", "text": "no id"},
        "not json at all",
    ]


def stored(spark):
    return spark.createDataFrame([("1", "c1", LONG), ("2", "c1", ""), ("3", "c2", LONG)], "doc_id string, company_id string, text string")


def tables(spark, root):
    now = commits.snapshot(spark, root)
    chunks = sorted((r.kind, r.doc_id, r.company_id, r.chunk_index, r.ingest_version, bool(r.embedding)) for r in now.read(spark, "chunks").collect())
    return chunks, {r.doc_id: (r.kind, r.state, r.error) for r in now.read(spark, "states").collect()}, sorted((r.kind, r.error) for r in now.read(spark, "dead").collect())


def test_dispatch(spark, tmp_path):
    """Three kinds, messages that fail beside ones that do not, and a sink that fails first."""
    put(tmp_path / "in", "0.json", messages())
    root, calls = str(tmp_path / "out"), []

    def failing(*args, **kwargs):
        calls.append(1)
        if len(calls) == 1:
            raise OSError("the disk is full")
        return commits.commit(*args, **kwargs)

    go = lambda: dispatch.start(spark, str(tmp_path / "in"), stored, root, str(tmp_path / "checkpoint"), once=True, commit=failing)
    with pytest.raises(Exception, match="disk is full"):
        go().awaitTermination(240)
    assert commits.latest(spark, root) == 0  # nothing of the batch is seen
    go().awaitTermination(240)
    chunks, state, dead = tables(spark, root)
    assert [c for c in chunks if c[0] == "embedded"] == [("embedded", "w1", "c1", 0, "e1", True), ("embedded", "w1", "c1", 7, "e1", True)]
    assert {c[1:3] + c[4:] for c in chunks if c[0] == "content"} == {("1", "c1", "k1", False), ("3", "c2", "k2", False)}
    assert {c[1:3] for c in chunks if c[0] == "legacy"} == {("t1", "c7")} and sum(c[1] == "t1" for c in chunks) == 3
    assert {d for d, s in state.items() if s[1] == "completed"} == {"w1", "w4", "1", "3", "t1"}
    assert {d: s[2] for d, s in state.items() if s[1] == "failed"} == {
        "w2": "embeddings length must match chunks length", "w3": "embeddings must be of one size", "2": "no text", "99": "document not found", "t2": "no text",
    }
    assert dead == [
        ("broken", "not a message"), ("content", "document not found"), ("content", "document of another company"), ("content", "no text"), ("embedded", "embeddings length must match chunks length"),
        ("embedded", "embeddings must be of one size"), ("legacy", "no doc_id"), ("legacy", "no text"),
    ]
    dispatch.write_batch(spark.read.text(str(tmp_path / "in")), stored(spark), root, 0)  # the batch once more
    assert tables(spark, root) == (chunks, state, dead) and commits.latest(spark, root) == 1
    put(tmp_path / "in", "1.json", [{"job_id": "l9", "doc_id": "t1", "text": "x" * 100}])
    go().awaitTermination(240)
    assert {(r.doc_id, r.ingest_version) for r in dispatch.current_chunks(spark, root).where("doc_id in ('t1', '1')").collect()} == {("t1", "l9"), ("1", "k1")}
