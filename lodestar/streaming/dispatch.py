"""One stream of messages to several tables, by their kind: chunks that come with their vectors, documents to be indexed, and plain texts.

A batch is sorted out once: what a message makes goes to `chunks`, a row for each document with its state to `states`, and a message that cannot be worked on, or the
document of it that cannot, to `dead` with the reason, while the rest of its batch goes on. The three are one commit with the batch's number: a batch that is run again,
after any failure, changes none of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestar.operators.chunking import char_windows
from lodestar.sources import commits

#: Messages of all kinds, but for the list of documents, which senders write in three ways that differ by case alone.
LISTS = ("documentIds", "document_ids", "documentids")
MESSAGE = (
    "payload_type string, job_id string, jobId string, company_id string, companyId string, doc_id string, "
    "text string, chunks array<struct<text: string, chunk_index: int, char_start: int, char_end: int>>, embeddings array<array<float>>, metadata map<string,string>"
)
CHUNK = ("company_id", "doc_id", "ingest_version", "chunk_index", "text", "char_start", "char_end", "embedding", "kind")


def named(value: str) -> Column:
    """The documents that a message names, in a list or as one; null where it names none."""
    text = F.coalesce(*(F.get_json_object(value, f"$.{name}") for name in LISTS))
    return F.array_distinct(F.coalesce(F.from_json(text, "array<string>"), F.when(text.isNotNull(), F.array(text))))


def kind(message: Column, ids: Column) -> Column:
    """embedded, content (documents are named) or legacy."""
    return F.when(message["payload_type"] == "embedded_chunks", "embedded").when(ids.isNotNull(), "content").otherwise("legacy")


def parsed(lines: DataFrame) -> DataFrame:
    """value, kind, job_id, company_id, doc_id, metadata and error of message lines; a message that names documents is a row for each of them, each once."""
    read = lines.where("value is not null").select("value", F.from_json("value", MESSAGE).alias("m"), named("value").alias("ids"), F.try_parse_json("value").isNull().alias("broken"))
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    k = F.when(F.col("broken") | F.col("m").isNull(), "broken").otherwise(kind(F.col("m"), F.col("ids")))
    company = F.coalesce(blank("m.companyId"), blank("m.company_id"), blank(F.col("m.metadata")["companyId"]), blank(F.col("m.metadata")["company_id"]))
    ids = F.when((F.col("kind") == "content") & (F.size("ids") > 0), F.col("ids")).otherwise(F.array("m.doc_id"))
    each = read.withColumn("kind", k).withColumn("doc_id", F.explode_outer(ids))
    return each.select("value", "kind", F.coalesce(blank("m.jobId"), blank("m.job_id"), F.sha1("value")).alias("job_id"), company.alias("company_id"), blank("doc_id").alias("doc_id"), "m.text", "m.chunks", "m.embeddings")


def sorted_out(messages: DataFrame, documents: DataFrame, size: int = 1200, overlap: int = 200, min_chars: int = 80) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks, states and dead letters of parsed messages; documents(doc_id, company_id, text) are those that messages can name. Of several messages for one document in a batch
    the last in the order of job and line counts."""
    known = documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("company_id").alias("_company"), F.col("text").alias("_stored"), F.lit(True).alias("_there"))
    joined = messages.join(known.join(messages.select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id", "left")
    n = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0))
    uneven = F.coalesce(F.size(F.array_distinct(F.transform("embeddings", F.size))) > 1, F.lit(False)) | F.coalesce(F.exists("embeddings", lambda e: e.isNull()), F.lit(False))
    embedded, content = F.col("kind") == "embedded", F.col("kind") == "content"
    text = F.when(content, F.col("_stored")).otherwise(F.col("text"))
    error = (
        F.when(F.col("kind") == "broken", "not a message")
        .when(F.col("doc_id").isNull(), "no doc_id")
        .when(embedded & (n("chunks") != n("embeddings")), "embeddings length must match chunks length")
        .when(embedded & uneven, "embeddings must be of one size")
        .when(content & F.col("_there").isNull(), "document not found")
        .when(content & F.col("company_id").isNotNull() & F.col("_company").isNotNull() & (F.col("company_id") != F.col("_company")), "document of another company")
        .when(~embedded & (F.coalesce(F.trim(text), F.lit("")) == ""), "no text")
    )
    rows = joined.withColumn("error", error).withColumn("text", text).withColumn("company_id", F.coalesce("company_id", F.when(content, F.col("_company"))))
    dead = rows.where("error is not null").select("value", "kind", "doc_id", "job_id", "company_id", "error")
    parts = ["kind", "company_id", "text", "chunks", "embeddings"]
    last = rows.where("error is null").groupBy("doc_id").agg(F.max_by(F.struct("job_id", *parts), F.struct("job_id", "value")).alias("l")).select("doc_id", "l.*")
    pairs = last.where("kind = 'embedded'").select("doc_id", "job_id", "company_id", "kind", F.posexplode(F.arrays_zip("chunks", "embeddings")).alias("_i", "_p"))
    with_vectors = pairs.select(
        "company_id", "doc_id", F.col("job_id").alias("ingest_version"), F.coalesce("_p.chunks.chunk_index", "_i").alias("chunk_index"), F.coalesce("_p.chunks.text", F.lit("")).alias("text"),
        "_p.chunks.char_start", "_p.chunks.char_end", F.col("_p.embeddings").alias("embedding"), "kind",
    )
    cut = char_windows(last.where("kind <> 'embedded'").select("company_id", "doc_id", "job_id", "kind", "text"), "text", size, overlap, min_chars)
    without = cut.select("company_id", "doc_id", F.col("job_id").alias("ingest_version"), "chunk_index", F.col("chunk").alias("text"), "char_start", "char_end", F.lit(None).cast("array<float>").alias("embedding"), "kind")
    chunks = with_vectors.select(*CHUNK).unionByName(without.select(*CHUNK))
    done = last.select("doc_id", "company_id", "job_id", "kind", F.lit("completed").alias("state"), F.lit(None).cast("string").alias("error"))
    failed = dead.where("doc_id is not null").join(last.select("doc_id"), "doc_id", "left_anti").groupBy("doc_id").agg(F.max(F.struct("job_id", "kind", "company_id", "error")).alias("l"))
    states = done.unionByName(failed.select("doc_id", "l.company_id", "l.job_id", "l.kind", F.lit("failed").alias("state"), "l.error"))
    return chunks, states, dead


def write_batch(lines: DataFrame, documents: DataFrame, root: str, number: int, writer: str = "dispatch", commit: Callable = commits.commit, **cutting) -> None:
    """What a batch of lines makes, in one commit. Texts are read once: the parsed batch is staged with the rest and dropped by vacuum()."""
    spark = lines.sparkSession
    base = commits.snapshot(spark, root)
    if base.writers.get(writer, -1) >= number:
        return
    raw = commits.stage(parsed(lines), root, "raw")
    messages = spark.read.schema(raw.schema).parquet(f"{root}/data/{raw.parts['']}")
    chunks, states, dead = sorted_out(messages, documents, **cutting)
    mark = F.lit(number).cast("long").alias("batch")
    staged = {name: commits.stage(df.select("*", mark), root, name) for name, df in (("chunks", chunks), ("states", states), ("dead", dead))}
    commit(spark, base, added=staged, writer=writer, number=number)


def start(spark: SparkSession, path: str, documents: Callable[[SparkSession], DataFrame], root: str, checkpoint: str, once: bool = False, files: int = 16, every: str = "5 seconds", commit: Callable = commits.commit, **cutting) -> StreamingQuery:
    """Runs the dispatch over the files of a folder. documents() gives the documents as they are when a batch begins."""
    lines = spark.readStream.option("maxFilesPerTrigger", files).text(path)
    run = lambda batch, number: write_batch(batch, documents(batch.sparkSession), root, number, commit=commit, **cutting)
    writer = lines.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def current_chunks(spark: SparkSession, root: str) -> DataFrame:
    """Of each document the chunks of the last batch that completed it."""
    now = commits.snapshot(spark, root)
    last = now.read(spark, "states").where("state = 'completed'").groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return now.read(spark, "chunks").join(last, ["doc_id", "batch"])
