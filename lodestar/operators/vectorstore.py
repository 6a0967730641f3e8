"""A store of vectors in parts: a company's vectors lie in buckets by id, and a change rewrites only the parts that its ids fall into.

Two tables are committed together: `vectors`, by company and bucket, and `ids`, by bucket, which says in which company an id is, so that a vector that moves to
another company leaves the old one. Vectors without a company are the global set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.sources import commits

#: Buckets by id, and tasks that write the rows of one bucket of a company.
BUCKETS, TASKS = 16, 8


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col("faiss_id")), F.lit(buckets)).cast("int")


def _part(buckets: int) -> Column:
    """c:<company>/<bucket>, and g/<bucket> for the global set."""
    company = F.col("company_id")
    return F.concat_ws("/", F.when(company.isNull(), "g").otherwise(F.concat(F.lit("c:"), company)), _bucket(buckets).cast("string"))


def _change(spark: SparkSession, base: commits.Snapshot, rows: DataFrame | None, gone: DataFrame, buckets: int) -> dict:
    """What replaces the parts of the ids in `gone`, which are those of the rows too. The parts that ids fall into are listed on the driver, at most a manifest's worth."""
    gone = gone.select("faiss_id").distinct()
    of_ids = [str(r[0]) for r in gone.select(_bucket(buckets)).distinct().collect()]
    known = base.read(spark, "ids", of_ids) if "ids" in base.schemas else None
    touched: set[str] = set()
    for places in (known.join(gone, "faiss_id", "left_semi") if known is not None else None, rows):
        if places is not None:
            touched |= {r[0] for r in places.select(_part(buckets)).distinct().collect()}
    stay = lambda df: df.join(gone, "faiss_id", "left_anti")
    whole = stay(base.read(spark, "vectors", sorted(touched))) if known is not None else rows.limit(0)
    names = stay(known) if known is not None else rows.limit(0).select("faiss_id", "company_id")
    if rows is not None:
        whole, names = whole.unionByName(rows), names.unionByName(rows.select("faiss_id", "company_id"))
    dealt = _bucket(buckets * TASKS)  # rows of a bucket are in as many tasks, as one number divides the other
    staged = commits.stage(whole.repartition("company_id", dealt), base.root, "vectors", _part(buckets))
    staged_ids = commits.stage(names.repartition(dealt), base.root, "ids", _bucket(buckets))
    return {"replaced": {"vectors": (staged, sorted(touched)), "ids": (staged_ids, of_ids)}}


def upsert(rows: DataFrame, root: str, buckets: int = BUCKETS, writer: str | None = None, number: int | None = None, attempts: int = 3) -> commits.Snapshot:
    """Puts vectors(faiss_id, company_id, embedding) in the place of those with their ids, wherever they are. Of rows with one id one stays, that of the largest company and vector.
    A null id is an error. With a writer and a number a repeated call changes nothing."""
    checked = rows.withColumn("faiss_id", F.when(F.col("faiss_id").isNull(), F.raise_error(F.lit("a vector without an id")).cast("long")).otherwise(F.col("faiss_id")))
    rest = [c for c in rows.columns if c != "faiss_id"]
    single = checked.groupBy("faiss_id").agg(F.max(F.struct(*rest)).alias("_r")).select("faiss_id", "_r.*").select(*rows.columns)
    spark = rows.sparkSession
    if writer is not None and (done := commits.snapshot(spark, root)).writers.get(writer, -1) >= number:
        return done
    return commits.transact(spark, root, lambda base: _change(spark, base, single, single, buckets) | {"writer": writer, "number": number}, attempts)


def remove(ids: DataFrame, root: str, buckets: int = BUCKETS, attempts: int = 3) -> commits.Snapshot:
    """Takes the vectors of ids(faiss_id) out. Ids that are not there change nothing."""
    spark = ids.sparkSession
    return commits.transact(spark, root, lambda base: _change(spark, base, None, ids.where("faiss_id is not null"), buckets), attempts)


def read(spark: SparkSession, root: str, company: str | None = None, everything: bool = False) -> DataFrame:
    """The vectors of a company, the global ones for a blank one; or all. Only the parts asked for are read."""
    now = commits.snapshot(spark, root)
    name = f"c:{company}" if company and company.strip() else "g"
    return now.read(spark, "vectors", None if everything else [p for p in now.parts("vectors") if p.rpartition("/")[0] == name])


def move_to_companies(chunks: DataFrame, company: Column, root: str, marker: int = 1, buckets: int = BUCKETS) -> commits.Snapshot:
    """Moves the global vectors that chunks name into the sets of their companies, in one commit; done once for each marker. Chunks without a company leave their vectors where they are, and
    an id whose vector is missing is an error, before anything is written."""
    spark = chunks.sparkSession
    base = commits.snapshot(spark, root)
    if base.writers.get("move_to_companies", -1) >= marker:
        return base
    named = chunks.select("faiss_id", company.alias("_company")).where("_company is not null").groupBy("faiss_id").agg(F.min("_company").alias("_company"))
    known = base.read(spark, "ids")
    lost = named.join(known, "faiss_id", "left_anti").count()
    if lost:
        raise ValueError(f"{lost} ids have no vector")
    there = read(spark, root).drop("company_id").join(named, "faiss_id").withColumnRenamed("_company", "company_id")
    columns = base.read(spark, "vectors").columns
    return upsert(there.select(*columns), root, buckets, "move_to_companies", marker)
