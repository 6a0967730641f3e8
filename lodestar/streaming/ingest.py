"""The ingest stream: job files in, chunks of a new version out, one write for each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from lodestar.operators.chunking import char_windows

JOB = "job_id string, company_id string, doc_id string, text string, payload_type string, ts timestamp"
BATCH_FILES, FLUSH = 16, "5 seconds"


def job_stream(spark: SparkSession, path: str, files: int = BATCH_FILES) -> DataFrame:
    """Jobs as they arrive, a bounded number of files a batch. Lines that are not jobs have a null job_id and go to the error sink."""
    lines = spark.readStream.option("maxFilesPerTrigger", files).text(path)
    return lines.select(F.from_json("value", JOB).alias("j"), "value").select("j.*", "value")


def kind(payload: str = "payload_type") -> F.Column:
    return F.when(F.col(payload) == "embedded_chunks", "embedded").when(F.col(payload) == "content_index", "content").otherwise("legacy")


def latest_jobs(jobs: DataFrame) -> DataFrame:
    """The newest job of each document; a job that comes again counts once."""
    w = Window.partitionBy("company_id", "doc_id").orderBy(F.desc("ts"), F.desc("job_id"))
    return jobs.dropDuplicates(["job_id"]).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def start(spark: SparkSession, jobs_path: str, chunks_path: str, errors_path: str, checkpoint: str, once: bool = False, size: int = 1200, overlap: int = 200, min_chars: int = 80) -> StreamingQuery:
    """Runs the ingest. A batch writes into a folder of its own number, replaced when the batch is run again, so a failed write is safely repeated."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            bad = batch.where("doc_id is null or job_id is null").select(F.col("value"), F.lit(number).alias("batch"))
            bad.write.mode("overwrite").json(f"{errors_path}/batch={number}")
            good = latest_jobs(batch.where("doc_id is not null and job_id is not null").drop("value"))
            rows = char_windows(good, "text", size, overlap, min_chars).withColumn("ingest_version", F.col("job_id")).drop("text").withColumnRenamed("chunk", "text")
            rows.withColumn("company", F.coalesce("company_id", F.lit("_global"))).write.mode("overwrite").partitionBy("company").parquet(f"{chunks_path}/batch={number}")
        finally:
            batch.unpersist()

    writer = job_stream(spark, jobs_path).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=FLUSH)).start()


def current_chunks(spark: SparkSession, chunks_path: str) -> DataFrame:
    """Of each document the chunks of the last batch that brought any: an older job never wins over a newer one."""
    rows = spark.read.parquet(chunks_path)
    last = rows.groupBy("company", "doc_id").agg(F.max(F.struct("ts", "batch")).alias("m"))
    return rows.join(last, ["company", "doc_id"]).where((F.col("ts") == F.col("m.ts")) & (F.col("batch") == F.col("m.batch"))).drop("m")
