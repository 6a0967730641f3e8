"""Reading: Parquet folders, ranges of rows, lookups, and the resolution of where a document's text lies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def parquet_folder(spark: SparkSession, path: str) -> DataFrame:
    """All Parquet files under a folder, at any depth; files that cannot be read count as empty."""
    return spark.read.option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).parquet(path)


def first_file(df: DataFrame) -> str | None:
    return min(df.inputFiles(), default=None)


def row_range(df: DataFrame, order: list[Column], start: int, end: int | None = None, limit: int | None = None) -> DataFrame:
    """Rows [start, end) in an explicit order, and of those at most `limit`. The top end - start of a sort, not a window over all rows."""
    stop = min(x for x in (end, start + limit if limit is not None else None, (1 << 31) - 1) if x is not None)
    return df.orderBy(*order).offset(start).limit(max(0, stop - start))


def web_metadata(df: DataFrame, columns: tuple[str, ...] = ("id", "url", "dump", "file_path", "language", "language_script", "date", "language_score", "minhash_cluster_size", "top_langs")) -> Column:
    """The columns of a web record that are there, as a map without nulls."""
    pairs = [x for c in columns if c in df.columns for x in (F.lit(c), F.col(c).cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())


def by_keys(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """The rows of the given keys."""
    return df.join(keys.select(column).distinct(), column, "left_semi")


def missing_keys(requested: DataFrame, df: DataFrame, column: str) -> DataFrame:
    return requested.select(column).distinct().join(df.select(column), column, "left_anti")


def by_any_id(df: DataFrame, wanted: DataFrame, columns: list[str]) -> DataFrame:
    """For each wanted id the row that has it in the first of several columns."""
    ids = F.array(*(F.struct(F.lit(i).alias("priority"), F.col(c).cast("string").alias("wanted")) for i, c in enumerate(columns)))
    each = df.select("*", F.explode(ids).alias("k")).select("*", "k.*").drop("k").join(wanted.select("wanted").distinct(), "wanted")
    w = Window.partitionBy("wanted").orderBy("priority", *columns)
    return each.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "priority")


def crawl_results(df: DataFrame, domain: str | None = None, urls: list[str] | None = None, since: str | None = None, until: str | None = None, limit: int = 50) -> DataFrame:
    """The latest crawled pages of a domain or of some urls in a time range; the limit is held between 1 and 500."""
    out = df
    if domain:
        out = out.where(F.col("domain") == domain.lower())
    if urls:
        out = out.where(F.col("url").isin(urls))
    if since:
        out = out.where(F.col("fetched_at") >= F.lit(since).cast("timestamp"))
    if until:
        out = out.where(F.col("fetched_at") <= F.lit(until).cast("timestamp"))
    return out.orderBy(F.desc("fetched_at"), "url").limit(max(1, min(500, limit)))


def merged_metadata(file_rows: DataFrame, db_rows: DataFrame, key: str) -> DataFrame:
    """Metadata of a file and of a database: the database wins."""
    both = file_rows.alias("f").join(db_rows.alias("d"), key, "full_outer")
    return both.select(key, *(F.coalesce(F.col(f"d.{c}"), F.col(f"f.{c}")).alias(c) for c in file_rows.columns if c != key))


def later_wins(*maps: Column) -> Column:
    """One map of several; of equal keys the later map's value counts."""
    entries = F.concat(*(F.map_entries(F.coalesce(m, F.expr("map()").cast("map<string,string>"))) for m in maps))
    last = F.aggregate(entries, F.expr("cast(array() as array<struct<key:string,value:string>>)"), lambda acc, e: F.concat(F.filter(acc, lambda x: x["key"] != e["key"]), F.array(e)))
    return F.map_from_entries(last)


def source_of(text: Column, url: Column, upload: Column, kind: Column) -> Column:
    """Where a document's text comes from: its own text, an upload, what it names, or its url."""
    given = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    return F.when(given(text), "text").when(given(upload), "upload").when(given(kind), F.lower(F.trim(kind))).when(given(url), "import_url").otherwise("none")
