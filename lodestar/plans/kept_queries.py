"""Queries over what the library keeps: a lexical index, a store of vectors in parts, tables under one log of commits, and folders by their footers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar import schema
from lodestar.operators import lexindex, vectorstore
from lodestar.plans import build
from lodestar.plans.queries import text_queries
from lodestar.session import scratch_dir, table
from lodestar.sources import commits, footers

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# ---- the lexical index


def _shards(spark, d, which="true"):
    """Chunks hold their documents' texts, and a little twice."""
    return lexindex.shards_of(table(spark, d, "documents").where(which))


def _built(spark, d, rows, which="true"):
    root = scratch_dir(spark, "index")
    lexindex.build(rows, "chunk_id", root, shards=_shards(spark, d, which))
    return root


@query
def index_build(spark, d):
    """The index of all chunks, by its postings: the rows of each term, and the bounds of its scores."""
    root = _built(spark, d, schema.chunks(spark, d))
    postings = commits.snapshot(spark, root).read(spark, "postings").where("term is not null")
    return postings.groupBy("term").agg(F.sum("n").alias("rows"), F.max(F.array_max("most")).alias("most"), F.min(F.array_min("least")).alias("least"))


@query
def lexical_indexed(spark, d):
    """lexical_topk, by the index."""
    return lexindex.top_k(spark, _built(spark, d, schema.chunks(spark, d)), "chunk_id", text_queries(spark, d), 10)


@query
def index_updated(spark, d):
    """An index of the chunks of version v1, then an update: those of v2 come in, every fifth of v1 gets another text, every seventh goes."""
    chunks, n = schema.chunks(spark, d).select("chunk_id", "text", "ingest_version", F.col("doc_id").cast("long").alias("n")), F.col("n")
    old = chunks.where("ingest_version = 'v1'")
    root = _built(spark, d, old, "doc_id % 2 = 0")
    changed = old.where((n % 5 == 0) & (n % 7 != 0)).withColumn("text", F.concat_ws(" ", F.substring("text", 301, 400), F.lit("the und les para")))
    lexindex.update(chunks.where("ingest_version = 'v2'").unionByName(changed), root, "chunk_id", old.where(n % 7 == 0), shards=_shards(spark, d, "doc_id % 2 <> 0"))
    return lexindex.top_k(spark, root, "chunk_id", text_queries(spark, d), 10)


# ---- the store of vectors in parts


@query
def vectors_in_parts(spark, d):
    """A store of all vectors, of which every fifth moves to another company, turned round, and every seventh goes."""
    root, v, n = scratch_dir(spark, "vectors"), schema.vectors(spark, d), F.col("faiss_id")
    vectorstore.upsert(v, root, writer="load", number=1)
    vectorstore.upsert(v.where(n % 5 == 0).select("faiss_id", F.lit("c9").alias("company_id"), F.transform("embedding", lambda x: -x).alias("embedding")), root)
    vectorstore.remove(v.where(n % 7 == 0), root)
    vectorstore.upsert(v, root, writer="load", number=1)  # done before: changes nothing
    return vectorstore.read(spark, root, everything=True).select("faiss_id", "company_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


@query
def vectors_moved(spark, d):
    """Global vectors, of which those that chunks of a company name are moved to it: the sizes of all sets afterwards."""
    root, v = scratch_dir(spark, "vectors"), schema.vectors(spark, d)
    vectorstore.upsert(v.withColumn("company_id", F.lit(None).cast("string")), root)
    chunks = v.select("faiss_id", F.when(F.col("faiss_id") % 3 != 0, F.col("company_id")).alias("company"))
    for _ in range(2):  # the marker makes the second call do nothing
        vectorstore.move_to_companies(chunks, F.col("company"), root)
    return vectorstore.read(spark, root, everything=True).groupBy("company_id").agg(F.count(F.lit(1)).alias("vectors"), F.sum("faiss_id").alias("ids"))


# ---- commits


@query
def ingest_committed(spark, d):
    """Chunks and documents of all companies in a first commit, those of one ingested again, without its longer chunks, in a second: rows by commit, table and company."""
    root = scratch_dir(spark, "ingest")
    chunks = schema.chunks(spark, d).select(schema.company_of_chunk().alias("company"), "doc_id", "chunk_id", "text")
    docs = schema.documents(spark, d).select(F.col("company_id").alias("company"), "doc_id", "status")
    companies = [r[0] or "__null__" for r in docs.select("company").distinct().collect()]
    build.commit_ingest({"chunks": chunks, "documents": docs}, root, F.col("company"), companies, "ingest", 1)
    again = {"chunks": chunks.where("company = 'src1' and length(text) < 1000"), "documents": docs.where("company = 'src1' and status = 'ready'")}
    for _ in range(2):
        build.commit_ingest(again, root, F.col("company"), ["src1"], "ingest", 2)
    counted = [
        commits.snapshot(spark, root, version).read(spark, name).groupBy("company").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(version).cast("long").alias("version"), F.lit(name).alias("name"), "company", "rows")
        for version in (1, 2) for name in ("chunks", "documents")
    ]
    return counted[0].unionByName(counted[1]).unionByName(counted[2]).unionByName(counted[3])


# ---- footers


@query
def footer_rows(spark, d):
    """The rows of two tables by their files' footers."""
    rows = [footers.file_rows(spark, f"{d}/{name}.parquet").agg(F.sum("rows").alias("rows")).select(F.lit(name).alias("name"), "rows") for name in ("documents", "lineitem")]
    return rows[0].unionByName(rows[1])


@query
def web_row_range(spark, d):
    """Rows 50 to 250 of the files, of which only those that hold them are opened."""
    return footers.row_range(spark, f"{d}/documents.parquet", 50, 400, 200).select("doc_id", "lang")
