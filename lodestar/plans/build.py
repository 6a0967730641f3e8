"""Builds of an index: documents in, versioned chunks with vectors out, and what is counted on the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import clean_markdown
from lodestar.functions.urls import is_url
from lodestar.operators.chunking import char_windows, heading_chunks
from lodestar.operators.dense import encode, hash_encoder
from lodestar.sources import commits
from lodestar.sources.tables import row_range, web_metadata

#: How often a job whose document is not there yet is tried again.
ATTEMPTS = 3


def web_build(records: DataFrame, order: list[Column], start: int = 0, end: int | None = None, limit: int | None = None, size: int = 1200, overlap: int = 200, min_chars: int = 40, dimensions: int = 64, encoder=hash_encoder) -> DataFrame:
    """Chunks with vectors of web records(id, text, ...) in rows [start, end) of an order: id, chunk_index, text, char_start, char_end, metadata, source and embedding."""
    rows = row_range(records, order, start, end, limit) if start or end is not None or limit is not None else records
    cut = char_windows(rows.select("id", "text", web_metadata(rows).alias("metadata")), "text", size, overlap, min_chars)
    return encode(cut.select("id", "chunk_index", F.col("chunk").alias("text"), "char_start", "char_end", "metadata", F.lit("web").alias("source")), "text", dimensions, encoder)


def build_counts(records: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row for a build: records processed, those that gave chunks, those that did not, and chunks."""
    n = chunks.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    both = records.select("id").join(n, "id", "left")
    return both.agg(F.count(F.lit(1)).alias("processed"), F.count("n").alias("chunked"), F.count(F.when(F.col("n").isNull(), 1)).alias("skipped"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"))


def markdown_pages(pages: DataFrame, **cleaning) -> DataFrame:
    """url, title, content_hash, text and error of markdown pages(url, text): cleaned, with the first heading of depth one as the title. A page without an address or
    without text is an error and has neither."""
    text = clean_markdown(F.col("text"), **cleaning)
    error = F.when(~is_url(F.col("url")), "invalid url").when(F.trim(F.coalesce("text", F.lit(""))) == "", "empty markdown")
    rows = pages.select("url", F.when(error.isNull(), text).alias("text"), error.alias("error"))
    title = F.nullif(F.trim(F.regexp_extract("text", r"(?m)^#\s+(.+)$", 1)), F.lit(""))
    return rows.select("url", title.alias("title"), F.sha1(F.col("text").cast("binary")).alias("content_hash"), "text", "error")


def markdown_chunks(pages: DataFrame, target: int = 1100, overlap: int = 180, dimensions: int = 64, encoder=hash_encoder, **cleaning) -> DataFrame:
    """The chunks of markdown_pages() by heading, with vectors."""
    clean = markdown_pages(pages, **cleaning).where("error is null")
    return encode(heading_chunks(clean, "text", "url", target, overlap), "text", dimensions, encoder)


def retried(jobs: DataFrame, documents: DataFrame, attempts: int = ATTEMPTS) -> DataFrame:
    """Jobs(document_id, attempt, ...) with `route`: run where the document is there, retry (one attempt more) where it may still come, and dead beyond."""
    there = documents.select(F.col("document_id"), F.lit(True).alias("_there")).distinct()
    route = F.when(F.col("_there"), "run").when(F.col("attempt") + 1 < attempts, "retry").otherwise("dead")
    return jobs.join(there, "document_id", "left").withColumn("route", route).withColumn("attempt", F.when(F.col("route") == "retry", F.col("attempt") + 1).otherwise(F.col("attempt"))).drop("_there")


def commit_ingest(tables: dict[str, DataFrame], root: str, company: Column, companies: list[str], writer: str | None = None, number: int | None = None, attempts: int = 3) -> commits.Snapshot:
    """Puts what an ingest made of some companies, such as chunks, vectors and documents, in the place of what the tables held of them: all tables in one commit, so that no reader
    sees the chunks of one ingest with the vectors of another. Rows of other companies are an error. Staged once, also where a Conflict makes the commit try again."""
    spark = next(iter(tables.values())).sparkSession
    if writer is not None and (now := commits.snapshot(spark, root)).writers.get(writer, -1) >= number:
        return now
    made = {name: (commits.stage(df, root, name, company), companies) for name, df in tables.items()}
    return commits.transact(spark, root, lambda base: {"replaced": made, "writer": writer, "number": number}, attempts)
