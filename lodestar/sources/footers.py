"""Parquet folders by their files: row counts that Spark takes from the files' footers, and ranges of rows over all files that open only the files they fall into."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _files(spark: SparkSession, path: str) -> DataFrame:
    """path and length of all files under a path; their contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path).select("path", "length")


def _plain(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile()


def _name(path: str) -> Column:
    """One spelling of paths: what lists files says file:/a, what reads them file:///a."""
    return F.regexp_replace(path, "^([a-z0-9+.-]+):/+", "$1:/")


def _reader(spark: SparkSession, schema: StructType | str):
    return spark.read.schema(schema).option("recursiveFileLookup", True).option("ignoreCorruptFiles", True)


def file_rows(spark: SparkSession, path: str) -> DataFrame:
    """path, length and rows of each Parquet file under a folder (or of one file). A file that is empty or cannot be read has 0 rows.

    Spark counts without reading a column: the counts are those of the footers, read in parallel, and a footer that is broken in one file costs that file alone.
    """
    counts = _reader(spark, "_none int").parquet(path).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("rows"))
    if _plain(spark, path):
        return counts.select("path", F.lit(None).cast("long").alias("length"), "rows")
    files = _files(spark, path)
    return files.join(counts.select(_name("path").alias("_p"), "rows"), _name("path") == F.col("_p"), "left").select("path", "length", F.coalesce("rows", F.lit(0)).alias("rows"))


def total_rows(spark: SparkSession, path: str) -> int:
    return file_rows(spark, path).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]


def row_range(spark: SparkSession, path: str, start: int, end: int | None = None, limit: int | None = None, schema: StructType | None = None) -> DataFrame:
    """Rows [start, end) of all files under a folder, and of those at most `limit`; files in the order of their paths, rows as they are in them. `_position` is a row's number.

    The driver holds a count for each file, as it holds their names. Sums of them say in which files the range lies; only those are opened, and of the first and the last the
    rows outside are left out by their place in the file. Nothing is sorted or shuffled. The schema is the first readable file's unless it is given.
    """
    if start < 0 or (end is not None and end < start):
        raise ValueError("a range begins at 0 or later and does not end before")
    stop = min((x for x in (end, start + limit if limit is not None else None) if x is not None), default=None)
    counts = sorted((r.path, r.rows) for r in file_rows(spark, path).collect())
    own, at = [], 0
    for name, n in counts:
        if n and at + n > start and (stop is None or at < stop):
            own.append((name, at))
        at += n
    if schema is None:
        readable = [name for name, n in counts if n]
        if not readable:
            raise FileNotFoundError(f"no readable rows under {path}")
        schema = spark.read.parquet(own[0][0] if own else readable[0]).schema
    if not own:
        return spark.createDataFrame([], schema).withColumn("_position", F.lit(None).cast("long"))
    rows = _reader(spark, schema).parquet(*[name for name, _ in own]).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_index"))
    offsets = spark.createDataFrame(own, "_of string, _offset long").select(_name("_of").alias("_of"), "_offset")
    placed = rows.join(F.broadcast(offsets), _name("_file") == F.col("_of")).withColumn("_position", F.col("_offset") + F.col("_index"))
    inside = F.col("_position") >= start
    return placed.where(inside if stop is None else inside & (F.col("_position") < stop)).select(*schema.fieldNames(), "_position")
