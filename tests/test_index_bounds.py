"""What the kept lexical index holds and works out at a time."""

import pyarrow as pa
from pyspark.sql import functions as F

from lodestar.operators import lexindex
from lodestar.sources import commits


def test_updates_work_rows_out_once(spark, tmp_path):
    """The rows of an update are evaluated once where the number of shards is given, and each part of the corrections is one file."""
    root, seen = str(tmp_path), spark.sparkContext.accumulator(0)
    rows = spark.range(0, 300, 1, 4).select("id", F.concat_ws(" ", F.lit("all"), F.concat(F.lit("w"), F.col("id") % 90)).alias("text"))
    lexindex.build(rows, "id", root, parts=4, shards=3)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    now = lexindex.update(rows.where("id < 100").mapInArrow(counted, rows.schema), root, "id", rows.where("id >= 280"), shards=2)
    assert seen.value == 100
    fewer = now.read(spark, "fewer")
    assert len(fewer.inputFiles()) == len(now.parts("fewer")) > 1
    assert {r.term: r.n for r in fewer.collect()} == {"all": -120} | {f"w{i}": -(1 + (i < 10) + (10 <= i < 30)) for i in range(90)}
    left = commits.snapshot(spark, root)
    assert lexindex.alive(spark, left).count() == 280


def test_words_are_cut_slice_by_slice(monkeypatch):
    """A shard is never held as words; its packed postings are what they were."""
    sizes, split = [], lexindex.pc.split_pattern_regex
    monkeypatch.setattr(lexindex.pc, "split_pattern_regex", lambda texts, *a, **k: sizes.append(sum(len(t or "") for t in texts.to_pylist())) or split(texts, *a, **k))
    texts = [f"word{i % 700} common common {'x' * (i % 50)}" for i in range(60_000)] + [None, "", " . "]
    table = pa.table({"shard": pa.array([5] * len(texts), pa.int64()), "id": pa.array(range(len(texts)), pa.int64()), "_lowered": pa.array(texts)})
    out = lexindex._indexed("id", pa.int64())(table)
    assert sum(sizes) > 2 << 20 and max(sizes) <= 1 << 20
    postings = out.filter(pa.compute.is_valid(out.column("term")))
    numbers, bounds = lexindex._numbers(postings)
    counts = lexindex._unpacked(postings.column("counts"), int(bounds[-1]))
    at = postings.column("term").to_pylist()
    for term, want in (("common", list(range(60_000))), ("word3", list(range(3, 60_000, 700)))):
        i = at.index(term)
        assert numbers[bounds[i] : bounds[i + 1]].tolist() == want and set(counts[bounds[i] : bounds[i + 1]].tolist()) == {2 if term == "common" else 1}
