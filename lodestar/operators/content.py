"""Content documents and the state of their index: sources, options, state changes in order, and leases.

Changes are tables too: a batch of them is folded over each document in the order of time, so that many writers end as one would after the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.functions.text import coerce_bool, parse_int

#: States that another service is told of, and states that end a run.
TOLD, ENDS = ("completed", "failed", "indexing"), ("completed", "failed")
LEASE_SECONDS = 900


def alias(values: Column, *names: str) -> Column:
    """The value of the first of several names in a map, as it is written, then without regard to case and underscores."""
    lowered = F.transform_keys(values, lambda k, v: F.lower(k))
    exact = [values[n] for n in names]
    return F.coalesce(*exact, *(c for n in names for c in (lowered[n.lower()], lowered[n.lower().replace("_", "")])))


def index_options(options: Column, size: int = 1200, overlap: int = 200, min_chars: int = 80) -> Column:
    """Options of a job, a map of texts, as a struct with their defaults."""
    pick = lambda *names: F.coalesce(*(F.nullif(options[n], F.lit("")) for n in names))
    return F.struct(
        parse_int(pick("chunk_size", "chunkSize"), size).alias("chunk_size"),
        parse_int(pick("chunk_overlap", "chunkOverlap"), overlap).alias("chunk_overlap"),
        parse_int(pick("minChars", "min_chars", "minchars", "min_chars_per_chunk"), min_chars).alias("min_chars"),
        *(coerce_bool(pick(*names), False).alias(name) for name, names in (("cleanup", ("cleanup",)), ("ocr", ("ocr",)), ("lang_detect", ("langDetect", "lang_detect")))),
        options["scope"].alias("scope"),
        F.lower(options["source"]).alias("source"),
    )


def initial_stats(options: Column) -> Column:
    """The counts of a document that is queued: nothing yet, and how it will be cut."""
    zero = [F.lit(0).alias(n) for n in ("chunk_count", "token_count", "char_count")]
    return F.struct(*zero, *(options[n].alias(n) for n in ("chunk_size", "chunk_overlap", "min_chars")))


def resolved_source(document: Column, source: Column, metadata: Column, options: Column) -> Column:
    """Where a document's text comes from, of maps of texts: source, doc_type, upload_id, url, text and domain, each from the first place that has it."""
    pick = lambda *found: F.coalesce(*(F.nullif(c, F.lit("")) for c in found))
    each = lambda maps, names: [m[n] for m in maps for n in names]
    return F.struct(
        F.lower(pick(source["type"], source["source"], document["source"], options["source"], F.lit("text"))).alias("source"),
        F.lower(pick(document["docType"], document["type"], source["docType"], options["scope"], F.lit("document"))).alias("doc_type"),
        pick(*each((source, document, metadata), ("uploadId", "upload_id", "uploadid"))).alias("upload_id"),
        pick(*each((source, document, metadata), ("url",))).alias("url"),
        pick(source["text"], *each((document,), ("text", "rawText", "body", "content")), metadata["text"]).alias("text"),
        F.lower(F.trim(pick(*each((source, document, metadata), ("domain", "domain_id"))))).alias("domain"),
    )


def missing_content(source: Column) -> Column:
    """Why a resolved source has nothing to load; null where it has."""
    needs = [(("upload",), "upload_id", "upload source missing upload_id"), (("import_url", "url", "web"), "url", "url source missing url")]
    out = F.when(source["source"].isin("fetcher_crawl", "crawler", "fetcher"), F.when(source["domain"].isNull() & source["url"].isNull(), "crawl source missing domain"))
    for kinds, field, message in needs:
        out = out.when(source["source"].isin(*kinds), F.when(source[field].isNull(), message))
    return out.otherwise(F.when(source["text"].isNull(), "text source missing content"))


def queued(documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """Documents(company_id, document_id, title, state, job_id, chunk_count, created_at, updated_at) after jobs(company_id, document_id, title, job_id, ts): the last job of
    a document queues it with its counts at zero. A title that is blank leaves the old one, and a document that was there keeps when it was made."""
    last = jobs.groupBy("company_id", "document_id").agg(F.max_by(F.struct("title", "job_id", "ts"), F.struct("ts", "job_id")).alias("j"))
    both = documents.alias("d").join(last, ["company_id", "document_id"], "full_outer")
    new = F.col("j").isNotNull()
    pick = lambda value, name: F.when(new, value).otherwise(F.col(f"d.{name}")).alias(name)
    return both.select(
        "company_id", "document_id", F.coalesce(F.nullif(F.col("j.title"), F.lit("")), F.col("d.title")).alias("title"), pick(F.lit("queued"), "state"), pick(F.col("j.job_id"), "job_id"),
        pick(F.lit(0).cast("long"), "chunk_count"), F.coalesce(F.col("d.created_at"), F.col("j.ts")).alias("created_at"), pick(F.col("j.ts"), "updated_at"),
    )


def patched(documents: DataFrame, patches: DataFrame, columns: list[str]) -> DataFrame:
    """Documents(company_id, document_id, object_id, ...) with patches(company_id, key, ...) applied: each to the document of its company and document id, else to that of its company
    and object id, else to that of its object id. Values that a patch leaves null stay. Keys of patches must be unique."""
    tries = [
        (["company_id", "document_id"], patches.where("company_id is not null").withColumnRenamed("key", "document_id")),
        (["document_id"], patches.where("company_id is null").drop("company_id").withColumnRenamed("key", "document_id")),
        (["company_id", "object_id"], patches.where("company_id is not null").withColumnRenamed("key", "object_id")),
        (["object_id"], patches.drop("company_id").withColumnRenamed("key", "object_id")),
    ]
    # which try each patch is used in: the first that finds a document
    ids = documents.select("company_id", "document_id", "object_id")
    found = None
    for n, (keys, rows) in enumerate(tries):
        hit = rows.join(ids, keys).select("company_id", "document_id", F.lit(n).alias("try"), F.col("patch_id"), *(F.col(c).alias(f"new_{c}") for c in columns))
        found = hit if found is None else found.unionByName(hit)
    used = found.withColumn("_n", F.dense_rank().over(Window.partitionBy("patch_id").orderBy("try"))).where("_n = 1")
    last = used.withColumn("_m", F.row_number().over(Window.partitionBy("company_id", "document_id").orderBy(F.desc("patch_id")))).where("_m = 1")
    both = documents.alias("d").join(last.select("company_id", "document_id", *(f"new_{c}" for c in columns)).alias("p"), (F.col("d.company_id").eqNullSafe(F.col("p.company_id"))) & (F.col("d.document_id") == F.col("p.document_id")), "left")
    return both.select(*((F.coalesce(f"p.new_{c}", f"d.{c}").alias(c)) if c in columns else F.col(f"d.{c}") for c in documents.columns))


def timeline(changes: DataFrame) -> DataFrame:
    """What changes(document_id, job_id, state, ts) leave: per document its state, the job that set it, when it was queued, started and finished, and how often it failed.

    A change of a job older than the last one queued counts for nothing: it cannot overwrite a newer state.
    """
    w = Window.partitionBy("document_id").orderBy("ts", "job_id").rowsBetween(Window.unboundedPreceding, 0)
    owner = F.last(F.when(F.col("state") == "queued", F.col("job_id")), ignorenulls=True).over(w)
    valid = changes.withColumn("owner", owner).where(F.col("owner").isNull() | (F.col("owner") == F.col("job_id")))
    at = lambda cond: F.max(F.when(cond, F.col("ts")))
    s = F.col("state")
    return valid.groupBy("document_id").agg(
        F.max_by(F.struct("state", "job_id"), F.struct("ts", "job_id")).alias("l"), at(s == "queued").alias("queued_at"), at(s == "processing").alias("started_at"),
        at(s.isin(*ENDS)).alias("finished_at"), F.count(F.when(s == "failed", 1)).alias("failures"),
    ).select("document_id", "l.state", "l.job_id", "queued_at", "started_at", "finished_at", "failures")


def to_tell(states: DataFrame) -> DataFrame:
    """The states that another service is told of."""
    return states.where(F.col("state").isin(*TOLD))


def leases(requests: DataFrame, seconds: float = LEASE_SECONDS) -> DataFrame:
    """The requests(document_id, job_id, action, ts in seconds) with `granted`, folded over each document's lock in the order of ts, job and action.

    `acquire` gets a lock that is free, expired, or the job's own; `renew` and `release` are granted to its owner alone. Requests of one document meet in
    one task: they are few, as one document's jobs are.
    """
    one = F.struct("ts", "job_id", "action")
    start = F.struct(F.lit(None).cast("string").alias("owner"), F.lit(None).cast("double").alias("until"), F.expr("cast(array() as array<boolean>)").alias("granted"))

    def step(s: Column, r: Column) -> Column:
        own = F.coalesce(s["owner"] == r["job_id"], F.lit(False))
        free = s["owner"].isNull() | own | (s["until"] < r["ts"])
        ok = F.when(r["action"] == "acquire", free).otherwise(own)
        holds = ok & (r["action"] != "release")
        gone = ok & (r["action"] == "release")
        return F.struct(
            F.when(gone, F.lit(None)).when(holds, r["job_id"]).otherwise(s["owner"]).alias("owner"),
            F.when(gone, F.lit(None)).when(holds, r["ts"] + F.lit(float(seconds))).otherwise(s["until"]).cast("double").alias("until"),
            F.concat(s["granted"], F.array(ok)).alias("granted"),
        )

    folded = requests.withColumn("ts", F.col("ts").cast("double")).groupBy("document_id").agg(F.sort_array(F.collect_list(one)).alias("all"))
    marked = folded.withColumn("granted", F.aggregate("all", start, step, lambda s: s["granted"]))
    return marked.select("document_id", F.inline(F.arrays_zip("all", "granted"))).select("document_id", "all.*", "granted")


def checked_company(companies: DataFrame, claims: DataFrame) -> DataFrame:
    """claims(company_id, user_id) with `error`: none without a company; else the user must be named, the company be there and active, have a user, and that be the one."""
    live = companies.where(F.col("active") & F.col("admin_active")).select("company_id", F.col("user_id").cast("string").alias("owner"), F.lit(True).alias("_there"))
    error = (
        F.when(F.coalesce(F.nullif("company_id", F.lit("")), F.lit("")) == "", F.lit(None))
        .when(F.coalesce("user_id", F.lit("")) == "", "userId is required")
        .when(F.col("_there").isNull(), "company_not_found_or_inactive")
        .when(F.col("owner").isNull(), "company_user_missing")
        .when(F.lower("owner") != F.lower("user_id"), "user_mismatch")
    )
    return claims.join(live, "company_id", "left").select("company_id", "user_id", error.alias("error"))
