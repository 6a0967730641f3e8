"""A pipeline of five stages over `documents`; each stage is one of the operators of lodestar.llm.

Every stage takes the columns of documents and ignores others, whatever their names: all but the last return these columns alone. Nulls may be in any
column, ids may repeat, texts may be empty or of any length, and each row is judged by its own text, not by its id. An empty table goes through as one.
What a stage writes on the way is deleted as soon as its result is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import WORD, by_ids, drop_written, dropped_afterwards, id_remainder, written, written_for_good
from lodestar.llm.decontaminate import find_leaks
from lodestar.llm.language_id import fit_language_model, identify_languages
from lodestar.llm.mixing import mix
from lodestar.llm.near_dedup import near_duplicates
from lodestar.llm.quality import fit_quality_model, score_quality

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def with_row(docs: DataFrame) -> DataFrame:
    """docs as a written table with a key of its own for each row, _row: doc_id may be null or repeated."""
    return written(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "keyed")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects `und` only: null texts and texts without a letter. The predicted language and its score reject nothing; lang and all else stay as they are. Rows
    without a lang are not learned from; where no row has one, there is nothing to predict by and every row is `und`."""
    docs = docs.select(*COLUMNS)
    model = fit_language_model(docs.where(id_remainder(F.col("doc_id"), 4) != 2))
    return identify_languages(docs, model).where("lang_pred <> 'und'").select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the classifier predicts to be bad (score under 0.5). Null and empty texts have the score of no text. Where the labels are of one kind
    alone, or none, every score is 0.5 and every row stays. Copies have equal scores."""
    docs = docs.select(*COLUMNS)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(id_remainder(F.col("doc_id"), 3) != 1)
    return score_quality(docs, fit_quality_model(docs, labels)).where("predicted = 1").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each group of near copies, by the default of five words and 0.8. Null ids come last; of rows that are equal in all, one is
    kept, and so it is of rows of one group whose ids tie. Texts without a word are near to nothing: only equal rows of them are copies."""
    docs = with_row(docs)
    groups = near_duplicates(docs, key="_row").select(F.col("doc_id").alias("_row"), F.col("component_id").alias("component"))
    # texts without a word are linked with nothing: among them only equal rows are copies
    blank = F.when(~F.coalesce(F.col("text").rlike(WORD), F.lit(False)), F.sha2(F.to_json(F.struct(*COLUMNS)), 256)).alias("blank")
    ids = docs.select("_row", F.col("doc_id").isNull().alias("no_id"), "doc_id", blank)
    members = written(groups.join(ids, "_row").select("_row", "no_id", "doc_id", "blank", F.when(F.col("blank").isNull(), F.col("component")).alias("component")), "groups")
    first = members.groupBy("component", "blank").agg(F.min(F.struct("no_id", "doc_id", "_row")).alias("first")).select("first._row")
    dropped = written(members.select("_row").join(first, "_row", "left_anti"), "copies")
    return by_ids(docs, dropped, "_row", "left_anti").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a benchmark passage leaks, each row by its own text. Null texts and null passages leak nothing; without passages every row stays."""
    docs = with_row(docs)
    leaks = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key="_row").select(F.col("doc_id").alias("_row")).distinct()
    return by_ids(docs, written(leaks, "leaks"), "_row", "left_anti").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document that is left: doc_id, source, size, source_size, target and taken, a row for each row. Null texts have size 0, a null
    source is a source, and rows that tie in the seeded order and size are alike in the result."""
    return mix(docs.select(*COLUMNS), F.col("source")).select("doc_id", F.col("sources")[0].alias("source"), "size", "source_size", "target", "taken")


STAGES = [
    ("language_id", language_id),
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mixture),
]

#: The classifiers and the near copies are not expressible in SQL; tests/llm test the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and reread as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        if i == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        with dropped_afterwards():
            kept = written_for_good(stage(spark, docs, sf_dir), name)
        if i:
            drop_written(docs)
        docs = kept
    return docs
