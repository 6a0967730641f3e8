"""Queries over the tables at hand, one for each operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar import schema
from lodestar.functions import text as tx
from lodestar.functions import urls
from lodestar.operators import aggregates, catalog, chunking, dense, evaluate, filters, fusion, lexical, lifecycle
from lodestar.plans import search
from lodestar.session import table
from lodestar.sources import markup, tables

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def vector_queries(spark: SparkSession, d: str) -> DataFrame:
    """Every twentieth vector asks."""
    return schema.vectors(spark, d).where("faiss_id % 20 = 0").withColumnRenamed("faiss_id", "qid")


def text_queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")


def both_queries(spark: SparkSession, d: str) -> DataFrame:
    """Query i has the text of benchmark item i and the vector i."""
    return schema.vectors(spark, d).select(F.col("faiss_id").alias("qid"), "embedding").join(F.broadcast(text_queries(spark, d)), "qid")


# ---- vectors


@query
def dense_topk(spark, d):
    return dense.top_k(schema.vectors(spark, d), vector_queries(spark, d), 10)


@query
def dense_topk_company(spark, d):
    return dense.top_k(schema.vectors(spark, d), vector_queries(spark, d), 10, same="company_id")


@query
def dense_post_filter(spark, d):
    """The filter comes after the best 10, so that fewer can be left."""
    v = schema.vectors(spark, d)
    return dense.top_k(v, vector_queries(spark, d), 10).join(v.select("faiss_id", "company_id"), "faiss_id").where(filters.chunk_filter({"company_id": "c1"}, F.col("company_id")))


@query
def dense_fallback(spark, d):
    v, q = schema.vectors(spark, d), vector_queries(spark, d)
    return dense.with_fallback(v.where("company_id = 'c0'"), v, q, 5, "company_id")


@query
def vector_norms(spark, d):
    v = schema.vectors(spark, d).select("faiss_id", dense.normalized(F.transform("embedding", lambda x: x * 3)).alias("e"))
    return v.select("faiss_id", F.size("e").alias("dimension"), F.round(dense.inner_product(F.col("e"), F.col("e")), 4).alias("norm"))


# ---- chunks


@query
def chunk_windows(spark, d):
    return schema.chunks(spark, d).select("doc_id", "chunk_index", "char_start", "char_end", "text")


@query
def chunk_stats(spark, d):
    return chunking.chunk_stats(schema.chunks(spark, d))


@query
def chunk_strategy(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", chunking.strategy(F.col("text"), F.lit("auto")).alias("strategy"))


@query
def filter_in_null(spark, d):
    return schema.chunks(spark, d).where(filters.chunk_filter({"user_id": {"$in": ["u1", None]}, "metadata.domain": "d1.example"}, schema.company_of_chunk())).select("chunk_id", "user_id")


@query
def filter_company(spark, d):
    """The company is read from both of its places."""
    return schema.chunks(spark, d).where(filters.chunk_filter({"company_id": {"$in": ["src1", "src2"]}}, schema.company_of_chunk())).select("chunk_id", schema.company_of_chunk().alias("company"))


@query
def doc_visibility(spark, d):
    return filters.with_documents(schema.chunks(spark, d), schema.documents(spark, d)).where(filters.is_visible(F.col("status"))).select("chunk_id", "status")


@query
def active_version(spark, d):
    return filters.visible(schema.chunks(spark, d), schema.documents(spark, d)).select("chunk_id", "ingest_version")


@query
def active_chunk_count(spark, d):
    named = schema.chunks(spark, d).withColumn("company", schema.company_of_chunk())
    return lifecycle.active_chunks(named, schema.documents(spark, d)).groupBy("company").agg(F.count(F.lit(1)).alias("chunks"))


@query
def company_counts(spark, d):
    return schema.chunks(spark, d).groupBy(schema.company_of_chunk().alias("company")).agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("doc_id").alias("documents"))


@query
def company_domain_ids(spark, d):
    return schema.chunks(spark, d).select(schema.company_of_chunk().alias("company"), F.col("metadata")["domain"].alias("domain"), "doc_id", "faiss_id").distinct()


@query
def reconstruct_text(spark, d):
    chunks = schema.chunks(spark, d).groupBy("doc_id").agg(F.collect_list(F.struct("char_start", "chunk_index", "text")).alias("c"))
    return chunks.select("doc_id", aggregates.reconstruct(F.col("c")).alias("text")).select("doc_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


@query
def neighbour_radius(spark, d):
    chunks = schema.chunks(spark, d)
    hits = F.broadcast(lexical.top_k(chunks, "chunk_id", text_queries(spark, d), 3, keep=("doc_id",)).select("qid", "chunk_id", "doc_id"))
    return aggregates.neighbours(hits, chunks.select("doc_id", "chunk_id", "chunk_index"), 1).select("qid", "hit", "chunk_id")


# ---- search


@query
def lexical_topk(spark, d):
    return lexical.top_k(schema.chunks(spark, d), "chunk_id", text_queries(spark, d), 10)


@query
def rrf_fuse(spark, d):
    c, docs, q = schema.chunks(spark, d), schema.documents(spark, d), both_queries(spark, d)
    found = search.dense_hits(search.vector_hits(schema.vectors(spark, d), q, 20), c, docs, 20 * q.count())
    return fusion.rrf(found, search.lexical_hits(c, q.select("qid", "text"), docs, 20)).select("qid", "chunk_id", "score", "rrf")


@query
def title_promotion(spark, d):
    rows = _titled(spark, d)
    return rows.select("qid", "chunk_id", "title_match", "position")


@query
def doc_dedupe(spark, d):
    return fusion.one_per_document(_titled(spark, d), F.col("doc_id")).select("qid", "doc_id", "chunk_id", "position")


def _titled(spark, d):
    c = schema.chunks(spark, d)
    q = text_queries(spark, d)
    hits = lexical.top_k(c, "chunk_id", q, 20).select("qid", "chunk_id", "score", (F.col("rank") - 1).alias("position"))
    rows = c.select("chunk_id", "doc_id", "text", "metadata").join(search.few(hits, 20 * q.count()), "chunk_id").join(q.select("qid", F.col("text").alias("query")), "qid")
    return fusion.promote(rows, fusion.title_match(F.col("query"), F.col("metadata")["title"], F.col("text")))


@query
def hybrid_search(spark, d):
    return search.hybrid_search(schema.vectors(spark, d), schema.chunks(spark, d), schema.documents(spark, d), both_queries(spark, d), 10)


@query
def rerank_top(spark, d):
    """The first 5 of each query by the length of the chunk's id, the rest as before."""
    hits = lexical.top_k(schema.chunks(spark, d), "chunk_id", text_queries(spark, d), 10).select("qid", "chunk_id", (F.col("rank") - 1).alias("position"))
    return fusion.rerank(hits, F.length("chunk_id"), 5)


@query
def search_filtered(spark, d):
    """Filters on the chunk: many more candidates are fetched, and the filters come before the best lexical ones."""
    given = {"user_id": {"$in": ["u1", None]}, "metadata.domain": "d1.example"}
    return _searched(search.chunk_search(schema.vectors(spark, d), schema.chunks(spark, d), schema.documents(spark, d), both_queries(spark, d), 5, given))


@query
def search_fallback(spark, d):
    """The company that the filter names has no vectors of its own: all vectors are searched."""
    return _searched(search.chunk_search(schema.vectors(spark, d), schema.chunks(spark, d), schema.documents(spark, d), both_queries(spark, d), 5, {"company_id": "src1"}, hybrid=False))


@query
def search_short_query(spark, d):
    """Queries of two characters: the fused order stays, and documents may have several rows."""
    q = both_queries(spark, d).withColumn("text", F.substring("text", 1, 2))
    return _searched(search.chunk_search(schema.vectors(spark, d), schema.chunks(spark, d), schema.documents(spark, d), q, 10))


@query
def search_radius(spark, d):
    return _searched(search.chunk_search(schema.vectors(spark, d), schema.chunks(spark, d), schema.documents(spark, d), both_queries(spark, d), 3, radius=1))


@query
def search_reranked(spark, d):
    """The first 5 of each query reranked, here by the length of the chunk's text."""
    by_length = lambda q, t: F.length(t).cast("double")
    return _searched(search.chunk_search(schema.vectors(spark, d), schema.chunks(spark, d), schema.documents(spark, d), both_queries(spark, d), 10, reranker=by_length, rerank_top=5))


@query
def search_report(spark, d):
    return search.search_report(schema.vectors(spark, d), schema.chunks(spark, d), schema.documents(spark, d), both_queries(spark, d), 5, {"company_id": "src1"})


@query
def web_search(spark, d):
    rows = search.web_search(schema.vectors(spark, d), schema.chunks(spark, d), schema.documents(spark, d), both_queries(spark, d), 10, {"user_id": {"$in": ["u1", "u2", None]}}, radius=1)
    return rows.select("qid", "rank", "chunk_id", "score", F.md5("text").alias("digest"))


@query
def entry_search(spark, d):
    """Entries of one company among the best 10 of each query."""
    entries = schema.vectors(spark, d).withColumnRenamed("faiss_id", "id")
    return search.entry_search(entries, vector_queries(spark, d).select("qid", "embedding"), 10, F.col("company_id") == "c2")


def _searched(rows):
    return rows.select("qid", "rank", "doc_id", "chunk_id", "score", "rrf", "title_match", F.md5("text").alias("digest"))


# ---- windows and budgets


@query
def latest_per_key(spark, d):
    return aggregates.latest_per_key(schema.jobs(spark, d), ["document_id"], [F.col("ts"), F.col("job_id")], ["job_id", "state", "value"])


@query
def topn_per_key(spark, d):
    return aggregates.first_per_key(schema.jobs(spark, d), ["document_id"], [F.col("ts"), F.col("job_id")], 3).select("document_id", "job_id", "n")


@query
def running_budget(spark, d):
    return aggregates.within_budget(table(spark, d, "conversations"), ["conv_id"], [F.col("turn")], "text", 2000, joint=7).select("conv_id", "turn", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


@query
def job_latest_state(spark, d):
    return aggregates.latest_per_key(schema.jobs(spark, d), ["document_id"], [F.col("ts"), F.col("job_id")], ["state"]).groupBy("state").agg(F.count(F.lit(1)).alias("documents"))


# ---- text


@query
def domain_normalize(spark, d):
    return table(spark, d, "pages").select("page_id", urls.domain(F.col("url")).alias("domain"))


@query
def url_normalize(spark, d):
    return table(spark, d, "pages").select("page_id", urls.page_url(F.col("url")).alias("page_url"), urls.url_key(F.col("url")).alias("url_key"))


@query
def slug(spark, d):
    return table(spark, d, "customer").select("c_custkey", tx.slug(F.concat_ws("  ", "c_name", "c_mktsegment")).alias("slug"))


@query
def clean_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(tx.cleanup_lines(F.col("text"))).alias("digest"))


@query
def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"))


@query
def truncate_text(spark, d):
    text, cut, n = tx.cap_text(F.col("text"), 2000)
    return table(spark, d, "documents").select("doc_id", F.md5(text).alias("digest"), cut.alias("truncated"), n.alias("original_chars"))


@query
def string_id_hash(spark, d):
    return table(spark, d, "customer").select("c_custkey", tx.resolve_id(F.col("c_name")).alias("id"))


@query
def title_norm(spark, d):
    return table(spark, d, "benchmark").select("item_id", tx.title_norm(F.col("text")).alias("norm"))


@query
def extract_codes(spark, d):
    texts = table(spark, d, "part").select("p_partkey", F.concat(F.lit("model "), "p_type", F.lit("-"), F.col("p_size") + 100, F.lit("X "), "p_name").alias("t"))
    return texts.select("p_partkey", F.explode(tx.product_codes(F.col("t"))).alias("code"))


@query
def extract_prices(spark, d):
    texts = table(spark, d, "part").select("p_partkey", F.concat(F.lit("now "), F.col("p_retailprice").cast("int") % 1000, F.lit(" USD or $"), F.col("p_size"), F.lit(".")).alias("t"))
    return texts.select("p_partkey", F.posexplode(tx.prices(F.col("t"))).alias("n", "price"))


@query
def short_text(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.short_text(F.col("text"), 80).alias("preview"))


# ---- lifecycle


@query
def skip_existing(spark, d):
    return lifecycle.without(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), ["doc_id"])


@query
def missing_docs(spark, d):
    requested = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return tables.missing_keys(requested, table(spark, d, "labels"), "doc_id")


@query
def swap_versions(spark, d):
    """Labelled documents are taken in again as v9."""
    c = schema.chunks(spark, d)
    staged = c.join(table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("doc_id")).distinct(), "doc_id", "left_semi").withColumn("ingest_version", F.lit("v9"))
    kept, docs = lifecycle.swap_versions(c, schema.documents(spark, d), staged.select(*c.columns))
    return kept.groupBy("doc_id", "ingest_version").agg(F.count(F.lit(1)).alias("chunks")).join(docs.select("doc_id", "active_ingest_version"), "doc_id", "left")


@query
def remove_modes(spark, d):
    c, docs = schema.chunks(spark, d), schema.documents(spark, d)
    out = None
    for mode in lifecycle.MODES:
        left, ids, removed = lifecycle.removal_plan(c, docs, schema.company_of_chunk() == "src1", mode)
        row = left.agg(F.count(F.lit(1)).alias("chunks_left")).crossJoin(ids.agg(F.count(F.lit(1)).alias("vectors_removed"))).crossJoin(removed.agg(F.count(F.when(F.col("status") == "removed", 1)).alias("removed_documents")))
        row = row.select(F.lit(mode).alias("mode"), "*")
        out = row if out is None else out.unionByName(row)
    return out


@query
def index_drift(spark, d):
    v = schema.vectors(spark, d)
    return lifecycle.index_stats(schema.chunks(spark, d), schema.documents(spark, d), v.select("faiss_id"), schema.company_of_chunk())


@query
def rebuild_ids(spark, d):
    live = filters.visible(schema.chunks(spark, d), schema.documents(spark, d)).select("faiss_id")
    return lifecycle.rebuilt(schema.vectors(spark, d), live)[1]


@query
def removal_report(spark, d):
    c = schema.chunks(spark, d).select(schema.company_of_chunk().alias("company"), "faiss_id")
    return lifecycle.removal_report(c, schema.vectors(spark, d), ["company"])


@query
def migrate_groups(spark, d):
    return lifecycle.migration_groups(schema.chunks(spark, d), F.nullif(F.trim("company_id"), F.lit("")))


@query
def upsert_rows(spark, d):
    """Labels upserted from documents: known rows keep their quality, new ones bring none."""
    old = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    new = table(spark, d, "documents").select("doc_id", F.lit(-1).alias("quality"), F.lit(7).alias("toxic"))
    return lifecycle.upsert(old, new, ["doc_id"], keep=("quality",))


# ---- categories


@query
def category_path(spark, d):
    p = catalog.paths(schema.entries(spark, d))
    return p.select("id", "parent_id", F.array_join("texts", " > ").alias("path"), F.size("ids").alias("depth"))


@query
def category_attributes(spark, d):
    return catalog.attributes_along(catalog.paths(schema.entries(spark, d)), schema.attributes(spark, d)).select("id", "code", "category_id", "attribute_id")


@query
def category_stats(spark, d):
    e = schema.entries(spark, d)
    kind = F.when(F.col("id").startswith("s"), "Product").when(F.col("id").startswith("n"), " service ")
    return catalog.stats(e, kind, F.when(F.col("id").endswith("y"), "active"))


@query
def page_offset_limit(spark, d):
    total, rows = catalog.page(schema.entries(spark, d), [F.col("id")], 20, 10)
    return rows.select("id", "text", F.lit(total).cast("long").alias("total"))


# ---- evaluation


def _outcomes(spark, d):
    hits = aggregates.first_per_key(schema.jobs(spark, d), ["document_id"], [F.col("ts"), F.col("job_id")], 20).select(F.col("document_id").alias("query"), F.col("n").alias("rank"), F.col("state").alias("key"))
    targets = table(spark, d, "events").select(F.col("user_id").alias("query")).distinct().select("query", F.explode(F.array(F.lit("purchase"), F.lit("signup"))).alias("key"))
    return hits, targets


@query
def recall_at_k(spark, d):
    return evaluate.measures(*_outcomes(spark, d), 5).select("query", F.round("recall", 6).alias("recall"))


@query
def mrr(spark, d):
    return evaluate.measures(*_outcomes(spark, d), 5).agg(F.round(evaluate.mean(F.col("rr")), 6).alias("mrr"))


@query
def ndcg_at_k(spark, d):
    return evaluate.measures(*_outcomes(spark, d), 5).select("query", F.round("ndcg", 6).alias("ndcg"))


@query
def percentile_latency(spark, d):
    p = evaluate.percentiles(table(spark, d, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})
    return p.select("event_type", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query
def survey_top15(spark, d):
    return evaluate.survey(schema.chunks(spark, d), schema.company_of_chunk())


@query
def eval_breakdown(spark, d):
    m = evaluate.measures(*_outcomes(spark, d), 5)
    rows = m.select((F.col("query") % 3).cast("string").alias("config"), (F.col("query") % 2).cast("string").alias("query_type"), "recall", "rr", "ndcg", F.lit(None).cast("string").alias("error"))
    b = evaluate.breakdown(rows, "query_type")
    return b.select("config", "query_type", "is_summary", "queries", "errors", *(F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")))


# ---- sources


@query
def crawl_latest(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url", urls.domain(F.col("url")).alias("domain"), F.timestamp_seconds(F.col("page_id")).alias("fetched_at"))
    return tables.crawl_results(pages, limit=100).select("page_id", "url", "domain")


@query
def web_metadata(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("language"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("dump"))
    m = tables.web_metadata(rows)
    return rows.select("id", F.size(m).alias("n_keys"), m["language"].alias("language"), m["dump"].alias("dump"))


# ---- without SQL


@query
def html_to_markdown(spark, d):
    return markup.pages_as_markdown(table(spark, d, "pages", spread=True))


@query
def structure_chunks(spark, d):
    return chunking.structure_chunks(table(spark, d, "pages", spread=True), "html", "page_id", url="url", convert=markup.html_markdown)


@query
def heading_chunks(spark, d):
    return chunking.heading_chunks(table(spark, d, "pages", spread=True), "html", "page_id", convert=markup.html_markdown)


@query
def schema_leaves(spark, d):
    rows = table(spark, d, "events").select("event_id", F.concat(F.lit('{"a": ["'), F.repeat(F.concat("event_type", F.lit(" ")), 40), F.lit('", "https://x.example/y"], "p": '), "props", F.lit("}")).alias("text"))
    return markup.schema_index_text(rows, "text")


@query
def hash_encode(spark, d):
    rows = dense.encode(table(spark, d, "documents").select("doc_id", "text"), "text", 64)
    return rows.select("doc_id", F.size("embedding").alias("dimension"), F.round(dense.inner_product(F.col("embedding"), F.col("embedding")), 4).alias("norm"))
