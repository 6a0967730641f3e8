"""Writing: versions with a pointer, appends, error logs, reports, jobs."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _move_pointer(spark: SparkSession, root: str, text: str) -> None:
    """Replaces the pointer by one rename, so that a reader finds the old one or the new one at any time."""
    jvm = spark._jvm
    fs, temporary = _fs(spark, f"{root}/_pointer.{uuid.uuid4().hex}")
    out = fs.create(temporary, True)
    out.write(bytearray(text.encode()))
    out.close()
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(temporary.toUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(temporary), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{root}/CURRENT")), options)


def publish_version(df: DataFrame, root: str, version: str, partition_by: tuple[str, ...] = ()) -> str:
    """Writes a version beside the others, then moves the pointer, a small file, to it. Each attempt has a folder of its own: one that fails leaves the pointer where it was, and one that is
    repeated does not touch what readers of the version have open. drop_unused() removes what no pointer leads to."""
    name = f"{version}-{uuid.uuid4().hex}"
    path = f"{root}/data/{name}"
    df.write.partitionBy(*partition_by).parquet(path)
    _move_pointer(df.sparkSession, root, f"{version}\n{name}")
    return path


def _pointer(spark: SparkSession, root: str) -> list[str] | None:
    fs, pointer = _fs(spark, f"{root}/CURRENT")
    return spark.read.text(str(pointer), wholetext=True).first()[0].split("\n") if fs.exists(pointer) else None


def current_version(spark: SparkSession, root: str) -> str | None:
    found = _pointer(spark, root)
    return found and found[0]


def read_current(spark: SparkSession, root: str) -> DataFrame:
    found = _pointer(spark, root)
    if found is None:
        raise FileNotFoundError(f"nothing is published under {root}")
    return spark.read.parquet(f"{root}/data/{found[1]}")


def drop_unused(spark: SparkSession, root: str) -> int:
    """Deletes the folders that the pointer does not lead to, once no reader has them open; says how many."""
    found, (fs, data) = _pointer(spark, root), _fs(spark, f"{root}/data")
    old = [s.getPath() for s in fs.listStatus(data) if found is None or s.getPath().getName() != found[1]]
    for path in old:
        fs.delete(path, True)
    return len(old)


def provision(spark: SparkSession, root: str, schema: str) -> bool:
    """An empty version where there is none; says whether it made one."""
    if current_version(spark, root) is not None:
        return False
    publish_version(spark.createDataFrame([], schema), root, "v0")
    return True


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def append_errors(df: DataFrame, path: str) -> None:
    """Error rows as lines of JSON, with the time they were written."""
    df.withColumn("logged_at", F.current_timestamp()).write.mode("append").json(path)


def publish_jobs(df: DataFrame, path: str) -> None:
    """Jobs as JSON files in the folder that the stream reads."""
    df.write.mode("append").json(path)


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(report, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def counted_callbacks(states: DataFrame, chunks: DataFrame) -> DataFrame:
    """callbacks() with what there is to tell of an indexed document: its chunks, words and characters, and for crawled ones the chunks of its domain."""
    words = F.regexp_count("text", F.lit(r"\S+"))
    counts = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunk_count"), F.sum(words).cast("long").alias("token_count"), F.sum(F.length("text")).alias("char_count"))
    of_domain = chunks.groupBy(F.col("metadata")["domain"].alias("domain")).agg(F.count(F.lit(1)).alias("domain_chunks"))
    told = callbacks(states).join(counts, "doc_id", "left").join(of_domain, "domain", "left")
    indexed = F.col("told_state") == "indexed"
    return told.select("doc_id", "told_state", "domain", *(F.when(indexed, F.coalesce(c, F.lit(0))).otherwise(0).alias(c) for c in ("chunk_count", "token_count", "char_count", "domain_chunks")))


def callbacks(states: DataFrame) -> DataFrame:
    """Rows that tell another service about states that changed: completed is indexed there, and only crawled documents name their domain."""
    told = F.when(F.col("state") == "completed", "indexed").when(F.col("state") == "failed", "failed").when(F.col("state").isin("processing", "indexing"), "indexing")
    return states.where(told.isNotNull()).withColumn("told_state", told).withColumn("domain", F.when(F.lower("source").contains("fetcher"), F.col("domain")))
