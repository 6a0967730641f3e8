"""Every query with SQL against DuckDB on the smallest tables; the others against what they must hold."""

import glob
import os
import re
import zlib

import duckdb
import pytest

from lodestar.plans import oracles, registry

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the tables are not here")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for p in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def rows(pdf):
    columns = sorted(pdf.columns)
    plain = pdf[columns].astype(object).where(pdf[columns].notna(), None)
    return columns, sorted(map(str, plain.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, sql, name):
    assert rows(registry.QUERIES[name](spark, SMALL).toPandas()) == rows(sql.execute(registry.ORACLES[name]).df())


def test_all_but_two_have_sql():
    assert set(registry.QUERIES) - set(registry.ORACLES) == {"heading_chunks", "hash_encode"}


def test_hash_encode(spark, sql):
    """The norm of signed word counts, counted word by word."""
    want = {}
    for doc_id, text in sql.execute("SELECT doc_id, text FROM documents").fetchall():
        cells = [0] * 64
        for word in (text or "").lower().split():
            h = zlib.crc32(word.encode())
            cells[h % 64] += 1 if h >= 1 << 31 else -1
        want[doc_id] = (64, 1.0 if any(cells) else 0.0)
    assert {r.doc_id: (r.dimension, r.norm) for r in registry.QUERIES["hash_encode"](spark, SMALL).collect()} == want


def pieces_under_headings(text, target=1100, overlap=180):
    """Chunks by heading, as a list of paragraphs that is emptied from the front."""
    out, at = [], 0
    parts = re.split(r"(?m)^(#{1,6}\s.+)$", text)
    for title, body in zip(["# Loose", *(t.strip() for t in parts[1::2])], parts[::2], strict=True):
        todo = [p.strip() for p in body.strip("\n").split("\n\n") if p.strip()]
        if title == "# Loose" and not todo:
            continue
        begin, now, empty = at, f"{title}\n", len(title) + 1
        while todo:
            if len(now) + len(todo[0]) + 2 > target and len(now) > empty:
                out.append((title.lstrip("# ").strip(), now.strip(), begin, begin + len(now)))
                begin += max(len(now) - overlap, 0)
                now = f"{title}\n{now[-overlap:]}"
            now += f"\n{todo.pop(0)}"
        at = begin + len(now)
        out.append((title.lstrip("# ").strip(), now.strip(), begin, at))
    return out


def test_heading_chunks(spark, sql):
    want = [(page_id, i, *piece) for page_id, text in sql.execute(f"WITH {oracles.PAGES} SELECT page_id, t FROM md").fetchall() for i, piece in enumerate(pieces_under_headings(text))]
    got = registry.QUERIES["heading_chunks"](spark, SMALL).collect()
    assert sorted((r.page_id, r.chunk_index, r.heading, r.text, r.char_start, r.char_end) for r in got) == sorted(want) and len(want) > 100


def test_plans(spark):
    """Filters and columns reach the scan; the best k are limited before the shuffle."""
    plan = lambda name: registry.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan("dense_topk")
    assert "ReadSchema: struct<url:string" in plan("domain_normalize") or "html" not in plan("domain_normalize")
    assert "TakeOrderedAndProject" in plan("survey_top15")
    # no posting of a term meets a query: rows go to Python whole, and what comes back is limited before it is shuffled
    lexical = plan("lexical_topk")
    assert "WindowGroupLimit" in lexical and "term" not in lexical and "Join" not in lexical and lexical.count("Exchange") <= 2
