"""Python sees tables in batches of bounded rows and bytes, in any session."""

import pytest
from pyspark.sql import functions as F

from lodestar.operators import chunking, lexical
from lodestar.sources import markup


@pytest.mark.parametrize("made", [lambda df: markup.html_to_markdown(df, "text"), markup.pages_as_markdown])
def test_markdown_in_bounded_batches(spark, made):
    own = spark.newSession()
    made(own.createDataFrame([(1, "u", "<p>x", "<p>y")], "page_id long, url string, html string, text string"))
    assert int(own.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == 1000
    assert int(own.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == 8 << 20


def test_chunks_of_html_in_one_python(spark, monkeypatch):
    """Pages become markdown and chunks in the same worker, in bounded batches; texts of many chunks are cut over several."""
    monkeypatch.setattr(chunking, "CHUNK_ROWS", 3)
    own = spark.newSession()
    df = own.createDataFrame([(1, "<h1>A</h1><p>" + "word " * 200), (2, None), (3, "<p>" + "other " * 20)], "page_id long, html string").coalesce(1)
    for cut, size in ((chunking.structure_chunks, 100), (chunking.heading_chunks, 100)):
        options = {"size": size, "overlap": 20} if cut is chunking.structure_chunks else {"target": size, "overlap": 20}
        got = cut(df, "html", "page_id", convert=markup.html_markdown, **options)
        assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
        markdown = markup.html_to_markdown(df.select("page_id", F.col("html").alias("text")), "text")
        want = [tuple(r) for r in cut(markdown, "text", "page_id", **options).collect()]
        assert [tuple(r) for r in got.collect()] == want and len(want) > 1
    assert int(own.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == 1000


def test_lexical_search_in_bounded_batches(spark):
    """The same rows however the table is cut, also where equal scores come in later batches with smaller keys."""
    own = spark.newSession()
    words = ["a b", "a", "b b c", "a c", "c", "a a b", None]
    rows = [(10_000 - i, words[i % 7]) for i in range(700)]
    queries = own.createDataFrame([(1, "a"), (2, "b c"), (3, "c zzz")], "qid int, text string")
    found = lambda: sorted(map(tuple, lexical.top_k(own.createDataFrame(rows, "id long, text string").coalesce(1), "id", queries, 5).collect()))
    whole = found()
    assert int(own.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == 1000 and len(whole) == 15
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    assert found() == whole
