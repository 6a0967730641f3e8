"""Measures of retrieval: recall, reciprocal rank, nDCG, percentiles, and what to ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def judged(hits: DataFrame, targets: DataFrame) -> DataFrame:
    """hits(query, rank from 1, key) with whether the key is one of the query's targets."""
    return hits.join(targets.select("query", "key").distinct().withColumn("hit", F.lit(1)), ["query", "key"], "left")


def measures(hits: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """Per query with targets: recall@k (distinct targets found), rr (not cut at k), ndcg@k (a gain for each row that hits)."""
    j = judged(hits, targets)
    near = F.col("rank") <= k
    found = j.groupBy("query").agg(
        F.count_distinct(F.when(near & (F.col("hit") == 1), F.col("key"))).alias("found"),
        F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"),
        F.coalesce(F.sum(F.when(near & (F.col("hit") == 1), 1.0 / F.log2(F.col("rank") + 1.0))), F.lit(0.0)).alias("gain"),
    )
    n = targets.select("query", "key").distinct().groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1.0))
    return n.join(found, "query", "left").select(
        "query", (F.coalesce("found", F.lit(0)) / F.col("n")).alias("recall"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"), (F.coalesce("gain", F.lit(0.0)) / ideal).alias("ndcg")
    )


def mean(c: Column) -> Column:
    """The mean without NaN; null where nothing is left."""
    return F.avg(F.when(~F.isnan(c), c))


def percentiles(df: DataFrame, keys: list[str], column: str, shares: dict[str, float]) -> DataFrame:
    """Exact percentiles with linear interpolation."""
    return df.groupBy(*keys).agg(*(F.expr(f"percentile({column}, {share}d)").alias(name) for name, share in shares.items()))


def survey(chunks: DataFrame, company: Column, n: int = 15) -> DataFrame:
    """The n companies with the most chunks, with their documents."""
    return chunks.withColumn("company", company).groupBy("company").agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("doc_id").alias("documents")).orderBy(F.desc("chunks"), "company").limit(n)


def breakdown(outcomes: DataFrame, attribute: str) -> DataFrame:
    """Mean measures for each configuration, and for each value of an attribute within it, by one pass of grouping sets."""
    return outcomes.groupingSets([["config"], ["config", attribute]], "config", attribute).agg(
        F.grouping(attribute).cast("int").alias("is_summary"), F.count(F.lit(1)).alias("queries"), F.count("error").alias("errors"), mean(F.col("recall")).alias("recall"), mean(F.col("rr")).alias("mrr"), mean(F.col("ndcg")).alias("ndcg")
    )


def rerank_integrity(outcomes: DataFrame) -> DataFrame:
    """Per configuration, rows that should have been reranked and were not."""
    return outcomes.groupBy("config").agg(F.count(F.when(F.col("rerank_requested") & ~F.coalesce("rerank_applied", F.lit(False)), 1)).alias("not_applied"), F.count(F.lit(1)).alias("rows"))
