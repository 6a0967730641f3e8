"""Latest, first N and budgets per key; neighbours; putting chunks together again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """The last row of each key: an aggregate, which map-side combining makes cheap, in place of a sort."""
    picked = F.max_by(F.struct(*columns), F.struct(*order))
    return df.groupBy(*keys).agg(picked.alias("_r")).select(*keys, "_r.*")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key, with their number from 1."""
    return df.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("n") <= n)


def within_budget(df: DataFrame, keys: list[str], order: list[Column], text: str, most: int, joint: int = 0) -> DataFrame:
    """Rows of each key, in order, whose texts fit into `most` characters together with `joint` between them.

    The first that does not fit ends the key's rows; if it is the very first, it is cut instead.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    total = F.sum(F.length(text) + joint).over(w.rowsBetween(Window.unboundedPreceding, 0)) - joint
    place = F.row_number().over(w)
    counted = df.withColumn("total_chars", total).withColumn("place", place)
    return counted.where((F.col("total_chars") <= most) | (F.col("place") == 1)).withColumn(text, F.when(F.col("total_chars") > most, F.substring(text, 1, most)).otherwise(F.col(text)))


def neighbours(hits: DataFrame, chunks: DataFrame, radius: int) -> DataFrame:
    """qid, chunk_id of the hit, and the chunks of its document within `radius` places, by an equi-join on places.

    Each hit names the few places it wants, so that the join is an equality on document and place, not a range over the document.
    """
    places = chunks.join(hits.select("doc_id").distinct(), "doc_id", "left_semi")
    numbered = places.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_index", "chunk_id")))
    own = hits.join(numbered.select("doc_id", "chunk_id", "place"), ["doc_id", "chunk_id"])
    wanted = own.select("qid", F.col("chunk_id").alias("hit"), "doc_id", F.explode(F.sequence(F.col("place") - radius, F.col("place") + radius)).alias("place"))
    return wanted.join(numbered, ["doc_id", "place"])


def reconstructed_documents(chunks: DataFrame, documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, status, chunk_count, text and error of the wanted(doc_id) documents: hidden ones are refused, those without chunks are not found."""
    own = chunks.join(F.broadcast(wanted.select("doc_id").distinct()), "doc_id", "left_semi").groupBy("doc_id")
    texts = own.agg(F.count(F.lit(1)).alias("chunk_count"), reconstruct(F.collect_list(F.struct("char_start", "chunk_index", "text"))).alias("text"))
    rows = wanted.select("doc_id").distinct().join(documents.select("doc_id", "status"), "doc_id", "left").join(texts, "doc_id", "left")
    error = F.when(F.lower("status").isin("disabled", "removed"), "document_disabled").when(F.col("text").isNull(), "not_found")
    return rows.select("doc_id", "status", F.when(error.isNull(), F.col("chunk_count")).alias("chunk_count"), F.when(error.isNull(), F.col("text")).alias("text"), error.alias("error"))


def reconstruct(chunks: Column) -> Column:
    """The text of an array of structs (char_start, chunk_index, text): overlaps once, gaps as spaces. A start of 0 or null means: where the text before ends."""
    ordered = F.array_sort(F.transform(chunks, lambda c: F.struct(F.coalesce(F.nullif(c["char_start"], F.lit(0)), c["chunk_index"], F.lit(0)).alias("o"), F.coalesce(c["chunk_index"], F.lit(0)).alias("chunk_index"), c["char_start"].alias("char_start"), F.coalesce(c["text"], F.lit("")).alias("text"))))

    def add(text: Column, c: Column) -> Column:
        start = F.coalesce(F.nullif(c["char_start"], F.lit(0)), F.length(text))
        padded = F.when(start > F.length(text), F.rpad(text, start, F.lit(" "))).otherwise(text)
        return F.concat(padded, F.substring(c["text"], F.length(padded) - start + 1, F.length(c["text"])))

    return F.aggregate(ordered, F.lit(""), add)
