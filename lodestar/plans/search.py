"""Searches, from queries to ranked rows, many queries in one job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.operators import aggregates, dense, lexical
from lodestar.operators.filters import chunk_filter, is_visible, route_company, visible, with_documents
from lodestar.operators.fusion import chunk_key, is_short, one_per_document, promote, rerank, rrf, title_match
from lodestar.schema import company_of_chunk
from lodestar.session import checkpointed

#: Hits are broadcast to the chunks they name up to this many rows of ids; their number is known from the queries. Beyond, the join shuffles.
BROADCAST_HITS = 1_000_000
#: What identifies a chunk: any of these may be null.
IDS = ("chunk_id", "faiss_id", "doc_id")
RERANKED = 20


def ranked(rows: DataFrame, *order) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order)))


def few(hits: DataFrame, most: int) -> DataFrame:
    """Hits to be joined with chunks, `most` of them at most."""
    return F.broadcast(hits) if most <= BROADCAST_HITS else hits


def dense_hits(hits: DataFrame, chunks: DataFrame, documents: DataFrame, most: int, where: Column | None = None, versions: bool = True) -> DataFrame:
    """The hits(qid, faiss_id, score, scope) that lead to a chunk which may be seen: qid, the chunk's ids, score, scope and rank. Filters come after the
    candidates. Without `versions` chunks of any version are seen."""
    own = chunks if where is None else chunks.where(where)
    rows = own.select(*IDS, "chunk_index", "ingest_version").join(few(hits.select("qid", "faiss_id", "score", "scope"), most), "faiss_id")
    seen = visible(rows, documents) if versions else with_documents(rows, documents).where(is_visible(F.col("status")))
    return ranked(seen.select("qid", *IDS, "chunk_index", "score", "scope"), F.desc("score"), "chunk_id")


def lexical_hits(chunks: DataFrame, queries: DataFrame, documents: DataFrame, n: int, where: Column | None = None) -> DataFrame:
    """The best n chunks of each query that meet the filter, and of those the ones that may be seen."""
    own = chunks if where is None else chunks.where(where)
    best = lexical.top_k(own, "chunk_id", queries, n, keep=("faiss_id", "doc_id", "chunk_index", "ingest_version"))
    return ranked(visible(best, documents).select("qid", *IDS, "chunk_index", "score"), F.desc("score"), "chunk_id")


def vector_hits(vectors: DataFrame, queries: DataFrame, n: int, company: str | None = None) -> DataFrame:
    """The best n vectors of each query with the scope that served them: the company's own vectors if it has any, else all (global, or global_fallback
    where a company was named). Only whether the company has vectors decides, as a search among some always finds."""
    if company is not None:
        own = vectors.where(F.col("company_id") == company)
        if not own.where("embedding is not null").isEmpty():
            return dense.top_k(own, queries, n).withColumn("scope", F.lit("company"))
    return dense.top_k(vectors, queries, n).withColumn("scope", F.lit("global" if company is None else "global_fallback"))


def with_text(hits: DataFrame, chunks: DataFrame, most: int, radius: int = 0) -> DataFrame:
    """The hits with the text and metadata of their chunks. With a radius the text is put together from the chunks within so many places of it; the hits, which are
    few rows of ids, are then kept, as they are named several times."""
    hits = hits if radius <= 0 else checkpointed(hits)
    same = lambda a, b: F.expr(" AND ".join(f"{a}.{c} <=> {b}.{c}" for c in IDS))
    rows = chunks.select(*IDS, "text", "metadata").alias("c").join(few(hits, most).alias("h"), same("c", "h")).select("h.*", "c.text", "c.metadata")
    if radius <= 0:
        return rows
    named = few(hits.select("qid", "chunk_id", "doc_id"), most)
    wide = aggregates.neighbours(named, chunks.select("doc_id", "chunk_id", "chunk_index", "char_start", "text"), radius)
    texts = wide.groupBy("qid", F.col("hit").alias("chunk_id")).agg(aggregates.reconstruct(F.collect_list(F.struct("char_start", "chunk_index", "text"))).alias("wide"))
    return rows.join(texts, ["qid", "chunk_id"], "left").withColumn("text", F.coalesce("wide", "text")).drop("wide")


def candidates(vectors: DataFrame, chunks: DataFrame, documents: DataFrame, queries: DataFrame, k: int, filters: dict | None = None, hybrid: bool = True) -> tuple[DataFrame, DataFrame | None, int]:
    """Dense hits, lexical hits (None unless hybrid), and how many of each a query can have at most, times the queries."""
    n = dense.over_fetch(k, hybrid=hybrid, filtered=bool(filters))
    most = 2 * n * queries.count()
    where = chunk_filter(filters, company_of_chunk()) if filters else None
    found = dense_hits(vector_hits(vectors, queries, n, route_company(filters)), chunks, documents, most, where)
    return found, lexical_hits(chunks, queries.select("qid", "text"), documents, n, where) if hybrid else None, most


def chunk_search(
    vectors: DataFrame, chunks: DataFrame, documents: DataFrame, queries: DataFrame, k: int, filters: dict | None = None, hybrid: bool = True, radius: int = 0,
    reranker: Callable[[Column, Column], Column] | None = None, rerank_top: int = RERANKED,
) -> DataFrame:
    """qid, rank, the chunk's ids, score, rrf, title_match and text of the best k chunks of each query(qid, embedding, text).

    Dense candidates come from the vectors of the company that the filters name, or from all; hybrid searches fuse them with lexical ones. A reranker, a
    function of the query's and the chunk's text, orders the first `rerank_top`. Then title matches go first and each document has one
    row, except for queries too short to be a title, whose rows stay as they are.
    """
    if k <= 0 or radius < 0:
        raise ValueError("k must be positive, and the radius at least 0")
    found, words, most = candidates(vectors, chunks, documents, queries, k, filters, hybrid)
    if hybrid:
        fused = rrf(found, words, IDS, chunk_key())
    else:
        fused = found.select("qid", *IDS, "score", F.lit(None).cast("double").alias("rrf"), (F.col("rank") - 1).alias("position"))
    texts = queries.select("qid", F.col("text").alias("query"))
    rows = with_text(fused, chunks, most, radius).join(few(texts, most), "qid", "left")
    if reranker is not None and hybrid:
        rows = rerank(rows, reranker(F.col("query"), F.col("text")), rerank_top)
    rows = rows.withColumn("short", is_short(F.col("query")))
    placed = promote(rows, title_match(F.col("query"), F.col("metadata")["title"], F.col("text")), F.col("short"))
    single = one_per_document(placed, F.coalesce("doc_id", "chunk_id", F.col("faiss_id").cast("string")), F.col("short"))
    return ranked(single, "position").where(F.col("rank") <= k).select("qid", "rank", *IDS, "score", "rrf", "title_match", "text")


def search_report(vectors: DataFrame, chunks: DataFrame, documents: DataFrame, queries: DataFrame, k: int, filters: dict | None = None, hybrid: bool = True, reranked: bool = False) -> DataFrame:
    """One row for each query: how it was answered, from which scope, and how many dense and lexical candidates may be seen."""
    found, words, _ = candidates(vectors, chunks, documents, queries, k, filters, hybrid)
    company = route_company(filters)
    empty = company is not None and vectors.where((F.col("company_id") == company) & F.col("embedding").isNotNull()).isEmpty()
    scope = "global" if company is None else "global_fallback" if empty else "company"
    count = lambda df, name: df.groupBy("qid").agg(F.count(F.lit(1)).alias(name))
    rows = queries.select("qid").join(count(found, "dense_count"), "qid", "left")
    rows = rows.join(count(words, "lexical_count"), "qid", "left") if words is not None else rows.withColumn("lexical_count", F.lit(0).cast("long"))
    return rows.na.fill(0, ["dense_count", "lexical_count"]).select(
        "qid", F.lit("hybrid" if hybrid else "dense").alias("retrieval"), F.lit(hybrid).alias("hybrid_applied"), F.lit(reranked and hybrid).alias("rerank_applied"),
        "dense_count", "lexical_count", F.lit(scope).alias("index_scope"), F.lit("empty_results" if empty else None).cast("string").alias("fallback_reason"),
    )


def hybrid_search(vectors: DataFrame, chunks: DataFrame, documents: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """chunk_search() without filters: qid, rank, doc_id, chunk_id, score, rrf and title_match."""
    return chunk_search(vectors, chunks, documents, queries, k).select("qid", "rank", "doc_id", "chunk_id", "score", "rrf", "title_match")


def web_search(vectors: DataFrame, chunks: DataFrame, documents: DataFrame, queries: DataFrame, k: int, filters: dict | None = None, radius: int = 0) -> DataFrame:
    """The reduced search over a web index: the best k vectors, then the chunks that may be seen in any version and meet the filters. Nothing is fetched
    beyond k, fused, promoted or left out, so that fewer than k rows can be left."""
    most = k * queries.count()
    hits = dense.top_k(vectors, queries, k).withColumn("scope", F.lit("web"))
    where = chunk_filter(filters, company_of_chunk()) if filters else None
    return with_text(dense_hits(hits, chunks, documents, most, where, versions=False), chunks, most, radius).select("qid", "rank", *IDS, "score", "text")


def entry_search(entries: DataFrame, queries: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    """Entries(id, embedding, ...) nearest to each query, filtered after the best k are known: qid, rank among those k, score and the entry's columns."""
    hits = dense.top_k(entries, queries, k, id_column="id").withColumnRenamed("faiss_id", "id")
    rows = entries.drop("embedding").join(few(hits, k * queries.count()), "id")
    return rows if where is None else rows.where(where)
