"""Changes to tables as functions that return the new table, and reports on an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.operators.filters import is_active, is_visible, with_documents
from lodestar.session import checkpointed

MODES = ("soft", "deactivate", "hard")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """New rows replace old ones of their key; of several new rows the last in `order` counts. Columns in `keep` keep the old value."""
    last = new
    if order:
        last = new.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
    both = old.alias("o").join(last.alias("n"), keys, "full_outer")
    known = F.lit(False)
    for c in last.columns:
        if c not in keys:
            known = known | F.col(f"n.{c}").isNotNull()
    pick = lambda c: (F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")) if c in keep else F.when(known, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))).alias(c)
    return both.select(*keys, *(pick(c) for c in old.columns if c not in keys))


def update(old: DataFrame, patch: DataFrame, keys: list[str]) -> DataFrame:
    """Non-null values of the patch in place of the old ones; rows that are not there stay away."""
    both = old.alias("o").join(patch.alias("p"), keys, "left")
    return both.select(*keys, *(F.coalesce(F.col(f"p.{c}"), F.col(f"o.{c}")).alias(c) if c in patch.columns else F.col(f"o.{c}") for c in old.columns if c not in keys))


def without(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(gone.select(*keys).distinct(), keys, "left_anti")


def keep_version(chunks: DataFrame, doc_id: str, version: str) -> DataFrame:
    """A document's other versions go, its unversioned rows too."""
    return chunks.where((F.col("doc_id") != doc_id) | F.col("ingest_version").eqNullSafe(F.lit(version)))


def without_document(chunks: DataFrame, doc_id: str, version: str | None = None) -> DataFrame:
    """A document's chunks go: of all versions, or of one."""
    gone = F.col("doc_id") == doc_id
    if version is not None:
        gone = gone & F.col("ingest_version").eqNullSafe(F.lit(version))
    return chunks.where(~F.coalesce(gone, F.lit(False)))


def of_company_domain(company_id: str, domain: str) -> Column:
    """The chunks of a company and a domain, which both may be at the top level or in the metadata."""
    own = (F.col("company_id") == company_id) | (F.col("metadata")["companyId"] == company_id)
    return F.coalesce(own & (F.col("metadata")["domain"] == domain), F.lit(False))


def relabelled(df: DataFrame, old: str, new: str, column: str = "source") -> DataFrame:
    """Rows whose source is `old`, at the top level or in the metadata, say `new` there."""
    swap = lambda c: F.when(c == old, new).otherwise(c)
    out = df.withColumn(column, swap(F.col(column))) if column in df.columns else df
    return out.withColumn("metadata", F.transform_values("metadata", lambda k, v: F.when((k == column) & (v == old), new).otherwise(v))) if "metadata" in df.columns else out


def snapshot(vectors: DataFrame) -> DataFrame:
    """One row: how many vectors there are, of how many dimensions, and a checksum of their ids."""
    return vectors.agg(F.count(F.lit(1)).alias("total"), F.max(F.size("embedding")).alias("dimension"), F.max("faiss_id").alias("largest_id"), F.bit_xor("faiss_id").alias("checksum"))


def swap_versions(chunks: DataFrame, documents: DataFrame, staged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Takes staged chunks in: the rows of their documents in other versions go, and the documents point to the new version, with a ready row
    made where there was none. A document without staged chunks keeps its old version."""
    versions = staged.groupBy("doc_id").agg(F.max("ingest_version").alias("new_version"), F.count(F.lit(1)).alias("chunk_count"))
    kept = chunks.join(versions.select("doc_id"), "doc_id", "left_anti").unionByName(staged.join(versions, "doc_id").where(F.col("ingest_version") == F.col("new_version")).select(*chunks.columns))
    both = documents.join(versions, "doc_id", "full_outer")
    pointed = both.withColumn("active_ingest_version", F.coalesce("new_version", "active_ingest_version")).withColumn("status", F.when(F.col("new_version").isNotNull(), "ready").otherwise(F.col("status")))
    return kept, pointed.drop("new_version")


def removal_plan(chunks: DataFrame, documents: DataFrame, targets: Column, mode: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks left, ids of vectors to remove, documents with their status): soft deletes rows alone, deactivate vectors alone, hard both; the
    status is `removed` in each."""
    if mode not in MODES:
        raise ValueError(f"the mode must be one of {MODES}")
    hit = F.coalesce(targets, F.lit(False))
    left = chunks.where(~hit) if mode in ("soft", "hard") else chunks
    ids = chunks.where(hit).select("faiss_id").distinct() if mode in ("deactivate", "hard") else chunks.where(F.lit(False)).select("faiss_id")
    removed = documents.join(chunks.where(hit).select("doc_id").distinct().withColumn("_hit", F.lit(True)), "doc_id", "left")
    return left, ids, removed.withColumn("status", F.when(F.col("_hit"), "removed").otherwise(F.col("status"))).drop("_hit")


def removal_report(ids: DataFrame, vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: ids requested, removed (those that were there), and orphaned (the difference)."""
    found = ids.join(vectors.select("faiss_id").distinct().withColumn("_hit", F.lit(1)), "faiss_id", "left")
    return found.groupBy(*keys).agg(F.count(F.lit(1)).alias("requested"), F.count("_hit").alias("removed")).withColumn("orphaned", F.col("requested") - F.col("removed"))


def active_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks of documents that have a row and are visible, in the active version."""
    return chunks.join(documents.select("doc_id", "status", "active_ingest_version"), "doc_id").where(is_visible(F.col("status")) & is_active(F.col("ingest_version"), F.col("active_ingest_version"))).drop("status", "active_ingest_version")


def index_stats(chunks: DataFrame, documents: DataFrame, vectors: DataFrame, company: Column) -> DataFrame:
    """Per company: vectors, chunks, active chunks, drift (vectors less active chunks), drift in percent, and vectors without an active chunk."""
    named = chunks.withColumn("company", company)
    total = named.groupBy("company").agg(F.count(F.lit(1)).alias("chunks"))
    active = active_chunks(named, documents).select("company", "faiss_id")
    counted = active.groupBy("company").agg(F.count(F.lit(1)).alias("active_chunks"))
    own = vectors.join(named.select("faiss_id", "company"), "faiss_id").groupBy("company").agg(F.count(F.lit(1)).alias("vectors"))
    both = total.join(counted, "company", "left").join(own, "company", "left").na.fill(0, ["active_chunks", "vectors"])
    drift = F.col("vectors") - F.col("active_chunks")
    percent = F.when(F.col("active_chunks") > 0, F.round(drift * 100.0 / F.col("active_chunks"), 2))
    return both.withColumn("drift", drift).withColumn("drift_pct", percent).withColumn("orphan_estimate", F.greatest(drift, F.lit(0)))


def rebuilt(vectors: DataFrame, live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The vectors of live ids, and a report row: source, live, kept, missing, reclaimed. The caller refuses a rebuild that keeps nothing."""
    kept = vectors.join(live.select("faiss_id").distinct(), "faiss_id", "left_semi")
    marks = live.select("faiss_id").distinct().withColumn("_live", F.lit(1)).join(vectors.select("faiss_id").withColumn("_there", F.lit(1)), "faiss_id", "full_outer")
    n = lambda c: F.count(F.when(c, 1))
    live_, there = F.col("_live").isNotNull(), F.col("_there").isNotNull()
    return kept, marks.agg(n(there).alias("source"), n(live_).alias("live"), n(live_ & there).alias("kept"), n(live_ & ~there).alias("missing"), n(there & ~live_).alias("reclaimed"))


def migration_groups(chunks: DataFrame, company: Column) -> DataFrame:
    """Per company (null: none named): chunks, ids, and rows without an id. Ids are moved by a join on them, never as one list."""
    return chunks.withColumn("company", company).groupBy("company").agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("faiss_id").alias("ids"), F.count(F.when(F.col("faiss_id").isNull(), 1)).alias("without_id"))


def migrate(vectors: DataFrame, chunks: DataFrame, company: Column, path: str) -> None:
    """Copies vectors into a partition for each company. Vectors must have unique ids."""
    n, ids = vectors.agg(F.count(F.lit(1)), F.count_distinct("faiss_id")).first()
    if not n or n != ids:
        raise ValueError("vectors must be there, with unique ids")
    named = chunks.select("faiss_id", company.alias("company_id")).where("company_id is not null").distinct()
    vectors.drop("company_id").join(named, "faiss_id").repartition("company_id", F.pmod(F.xxhash64("faiss_id"), F.lit(16))).write.mode("errorifexists").partitionBy("company_id").parquet(path)


def reserve_ids(rows: DataFrame, order: list[Column], after: int) -> DataFrame:
    """Consecutive ids after the largest one, in a total order: offsets of partitions that are sorted by range, without a global window. Where a range begins is
    sampled, so the partitions are kept before they are counted."""
    ranged = checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()))
    numbered = ranged.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    sizes = {r["_p"]: r["n"] for r in ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, total = [], after
    for p in sorted(sizes):
        offsets.append((p, total))
        total += sizes[p]
    table = rows.sparkSession.createDataFrame(offsets, "_p int, _offset long")
    return numbered.join(F.broadcast(table), "_p").withColumn("id", F.col("_offset") + F.col("_i")).drop("_p", "_i", "_offset")


# ---- leases, as a pure transition


def acquire(lock: dict | None, job_id: str, now: float, seconds: float = 900) -> tuple[bool, dict | None]:
    """Whether the job gets the lock, and the lock afterwards: it is free, has expired, or is the job's own."""
    if lock and lock.get("jobId") and lock["jobId"] != job_id and lock["leaseUntil"] >= now:
        return False, lock
    return True, {"jobId": job_id, "acquiredAt": now, "leaseUntil": now + seconds}


def release(lock: dict | None, job_id: str) -> tuple[bool, dict | None]:
    """Only its owner releases a lock."""
    return (True, None) if lock and lock.get("jobId") == job_id else (False, lock)


def renew(lock: dict | None, job_id: str, now: float, seconds: float = 900) -> tuple[bool, dict | None]:
    if lock and lock.get("jobId") == job_id:
        return True, lock | {"leaseUntil": now + seconds}
    return False, lock
