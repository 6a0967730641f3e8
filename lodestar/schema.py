"""The engine's tables, derived from the tables at hand.

vectors(faiss_id, company_id, embedding), documents(doc_id, ...status, active_ingest_version), chunks(...), entries (a tree of
categories) and jobs. Every derivation is a narrow projection: filters and column pruning pass through to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators.chunking import char_windows
from lodestar.session import table


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("faiss_id"), F.concat(F.lit("c"), (F.col("label") % 4).cast("string")).alias("company_id"), "embedding")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    return table(spark, sf_dir, "documents", spread=True).select(
        n.cast("string").alias("doc_id"),
        "text",
        F.col("source").alias("company_id"),
        F.col("lang").alias("doc_type"),
        F.when(n % 17 == 0, "disabled").when(n % 17 == 1, "removed").when(n % 17 == 2, "processing").otherwise("ready").alias("status"),
        F.when(n % 3 == 0, "v1").when(n % 3 == 1, "v2").alias("active_ingest_version"),
    )


def chunks(spark: SparkSession, sf_dir: str, size: int = 1200, overlap: int = 200, min_chars: int = 40) -> DataFrame:
    """Ids are made from the document's and the chunk's number, so that no sort over all chunks is needed. The company of odd documents is in
    the metadata alone, that of even ones at the top level."""
    n = F.col("doc_id").cast("long")
    cut = char_windows(documents(spark, sf_dir), "text", size, overlap, min_chars)
    return cut.select(
        "doc_id",
        F.concat_ws(":", "doc_id", F.col("chunk_index").cast("string")).alias("chunk_id"),
        (n + F.col("chunk_index") * (1 << 32)).alias("faiss_id"),
        "chunk_index",
        F.concat(F.lit("v"), (1 + n % 2).cast("string")).alias("ingest_version"),
        F.when(n % 2 == 0, F.col("company_id")).alias("company_id"),
        F.when(n % 5 != 0, F.concat(F.lit("u"), (n % 7).cast("string"))).alias("user_id"),
        "chunk",
        "char_start",
        "char_end",
        "doc_type",
        F.create_map(F.lit("companyId"), F.col("company_id"), F.lit("domain"), F.concat(F.lit("d"), (n % 4).cast("string"), F.lit(".example")), F.lit("title"), F.substring_index("text", ".", 1)).alias("metadata"),
    ).withColumnRenamed("chunk", "text")


def company_of_chunk() -> Column:
    """The company of a chunk: top level first, then the metadata."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in (F.col("company_id"), F.col("metadata")["companyId"], F.col("metadata")["company_id"])))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of categories: regions, their nations, and market segments within nations."""
    region = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("text"))
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("id"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("parent_id"), F.col("n_name").alias("text"))
    segment = table(spark, sf_dir, "customer").select(F.concat(F.lit("s"), F.col("c_nationkey"), F.lit("-"), F.lower("c_mktsegment")).alias("id"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("parent_id"), F.col("c_mktsegment").alias("text")).distinct()
    return region.union(nation).union(segment)


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of categories, by code: a part's brand belongs to a nation, its type to a region."""
    part = table(spark, sf_dir, "part")
    brand = part.select(F.concat(F.lit("n"), F.col("p_partkey") % 25).alias("category_id"), F.col("p_brand").alias("code"), F.col("p_partkey").alias("id"))
    kind = part.select(F.concat(F.lit("r"), F.col("p_partkey") % 5).alias("category_id"), F.col("p_type").alias("code"), F.col("p_partkey").alias("id"))
    return brand.union(kind).groupBy("category_id", "code").agg(F.min("id").alias("id"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs, or log lines: event_id, the document (user_id), its state, and when."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), F.col("user_id").alias("document_id"), F.col("event_type").alias("state"), "ts", "value")


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories as stored entries, made of parts: external ids repeat, texts may be broken or missing, and what is known of one lies in its metadata."""
    k = F.col("p_partkey")
    fields = {
        "name": F.when(k % 4 == 0, F.col("p_brand")), "label": F.when(k % 6 == 0, F.col("p_type")), "slug": F.when(k % 9 == 0, F.concat(F.lit(" My  "), "p_brand", F.lit("!"))),
        "parentId": F.when(k % 8 != 0, F.concat(F.lit("x"), k % 50)), "categoryType": F.when(k % 2 == 0, " Product ").when(k % 3 == 1, "service"), "status": F.when(k % 10 < 7, "Active").when(k % 10 == 7, "inactive"),
        "featured": F.when(k % 10 == 0, "Yes"), "isPublic": F.when(k % 4 == 1, "true"), "isSystem": F.when(k % 5 == 1, "1"), "description": F.when(k % 12 == 0, F.col("p_name")), "companyId": F.when(k % 3 == 1, F.concat(F.lit("co"), k % 7)),
    }
    metadata = F.map_filter(F.create_map(*(x for name, c in fields.items() for x in (F.lit(name), c))), lambda _, v: v.isNotNull())
    return table(spark, sf_dir, "part").select(
        k.cast("long").alias("id"), F.concat(F.lit("x"), k % 700).alias("external_id"), F.when(k % 5 == 0, "[object Object]").when(k % 7 != 0, F.col("p_name")).alias("text"),
        F.when(k % 3 == 0, F.concat(F.lit("co"), k % 11)).alias("company_id"), metadata.alias("metadata"),
    )
