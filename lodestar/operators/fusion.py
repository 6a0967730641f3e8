"""Fusion, reranking and promotion of ranked hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.functions.text import title_norm

RRF_K = 60


def chunk_key() -> Column:
    """What a hit is fused by: its chunk, or where that has no id the vector and the document."""
    return F.coalesce("chunk_id", F.concat_ws(":", F.col("faiss_id").cast("string"), "doc_id"))


def rrf(dense: DataFrame, lexical: DataFrame, columns: tuple[str, ...] = ("chunk_id",), key: Column | None = None, k: int = RRF_K) -> DataFrame:
    """qid, `columns` and score (the dense hit's where it has one), rrf (sum of 1 / (k + rank), ranks from 0) and position (from 0).

    Both sides have qid, `columns`, score and rank (from 1); hits with one `key` (the first of the columns, if none is given) are one.
    Ties go to the one seen first: dense hits by rank, then lexical ones.
    """
    side = lambda df, n: df.select("qid", *columns, "score", (F.col("rank") - 1).alias("r"), F.lit(n).alias("side"))
    both = side(dense, 0).unionByName(side(lexical, 1)).withColumn("_key", key if key is not None else F.col(columns[0]))
    fused = both.groupBy("qid", "_key").agg(F.sum(1.0 / (k + F.col("r"))).alias("rrf"), F.min_by(F.struct("side", "r", "score", *columns), F.struct("side", "r")).alias("first"))
    w = Window.partitionBy("qid").orderBy(F.desc("rrf"), "first.side", "first.r")
    return fused.select("qid", *(F.col(f"first.{c}").alias(c) for c in columns), F.col("first.score").alias("score"), "rrf", (F.row_number().over(w) - 1).alias("position")).withColumn("rrf", F.round("rrf", 6))


def rerank(rows: DataFrame, score: Column, n: int) -> DataFrame:
    """The first n of each query by a new score, ties by their old place; the rest stays behind them in order."""
    head = F.col("position") < n
    w = Window.partitionBy("qid").orderBy(F.when(head, 0).otherwise(1), F.when(head, -score), "position")
    return rows.withColumn("position", F.row_number().over(w) - 1)


#: Queries of fewer normalised characters are too short to be a title.
LEAST_QUERY = 3


def is_short(query: Column) -> Column:
    """Whether a query is too short to promote anything; also true of no query."""
    return F.length(title_norm(query)) < LEAST_QUERY


def title_match(query: Column, title: Column, text: Column) -> Column:
    """2 where the title or a heading holds the query or lies in it, 1 where the text holds it, else 0. Short queries match nothing."""
    q, t = title_norm(query), title_norm(title)
    heads = F.filter(F.transform(F.filter(F.split(text, "\n"), lambda x: F.ltrim(x).startswith("#")), lambda x: title_norm(F.regexp_replace(x, r"^\s*#+", ""))), lambda h: h != "")
    strong = ((t != "") & (t.contains(q) | q.contains(t))) | F.coalesce(F.exists(heads, lambda h: h.contains(q) | q.contains(h)), F.lit(False))
    return F.when(is_short(query), 0).when(strong, 2).when(title_norm(text).contains(q), 1).otherwise(0)


def promote(rows: DataFrame, match: Column, short: Column | None = None) -> DataFrame:
    """Places by title match, then score, then the place before. Rows of `short` queries stay in their places."""
    by_score = F.when(~short, -F.col("score")) if short is not None else -F.col("score")
    w = Window.partitionBy("qid").orderBy(F.desc("title_match"), by_score, "position")
    return rows.withColumn("title_match", match).withColumn("position", F.row_number().over(w) - 1)


def one_per_document(rows: DataFrame, doc: Column, short: Column | None = None) -> DataFrame:
    """The first row of each document of a query, and all rows of `short` queries."""
    w = Window.partitionBy("qid", doc).orderBy("position")
    first = F.row_number().over(w) == 1
    return rows.withColumn("_n", first | short if short is not None else first).where("_n").drop("_n")
