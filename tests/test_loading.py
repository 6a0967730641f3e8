"""Crawled pages whose urls repeat."""

import duckdb
import pytest

from lodestar.plans import registry

PAGES = [(i, url, "") for i, url in enumerate(["u0", "u1", "u2", "u3"] * 30 + ["v"] * 20 + [None, None, "", ""])]


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("pages"))
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    return d


@pytest.mark.parametrize("name", ["crawl_rows", "preview_images"])
def test_urls_of_several_crawls(spark, pages, name):
    """As the SQL says: each page is a crawl with 20 media of its own, and has its own preview image."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{pages}/pages.parquet/*.parquet')")
    want = con.execute(registry.ORACLES[name])
    columns = [c[0] for c in want.description]
    got = [tuple(r) for r in registry.QUERIES[name](spark, pages).select(*columns).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want.fetchall()))
