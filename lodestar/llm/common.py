"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.session import shared_dir, small_batches  # noqa: F401

#: A word is a run of anything but these six ASCII separators.
WORD = r"[^\x20\x09-\x0D]+"


_folders: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """This application's own folder within the one that driver and executors share. It goes when the driver's Python ends, with what a result may still read until then."""
    at = f"{shared_dir(spark)}/lodestar-{spark.sparkContext.applicationId}"
    if at not in _folders:
        _folders.add(at)
        atexit.register(_delete, spark, at)
    return at


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # at the end the JVM may be gone already
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jvm.org.apache.hadoop.conf.Configuration()).delete(at, True)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a Hadoop-style path and the path in it."""
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return (pafs.LocalFileSystem(), uri) if uri.startswith("/") else pafs.FileSystem.from_uri(uri)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and a lost executor costs a reread, not a recomputation."""
    out = written_for_good(df, name)
    for made in _scopes[-1:]:
        made.append(out)
    return out


def written_for_good(df: DataFrame, name: str) -> DataFrame:
    """The same for what is not to be dropped with the rest."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


_scopes: list[list[DataFrame]] = []


@contextlib.contextmanager
def dropped_afterwards() -> Iterator[None]:
    """What is written within is deleted at the end: for a caller that has by then written the result elsewhere."""
    _scopes.append([])
    try:
        yield
    finally:
        for table in _scopes.pop():
            drop_written(table)


def drop_written(df: DataFrame) -> None:
    """Deletes the table that written() made, once nothing reads it any more."""
    spark, path = df.sparkSession, df._written_at
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def words_in(text: str | Column) -> Column:
    """The number of words; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def id_remainder(c: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as the empty text."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def byte_values(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A text column of an Arrow batch as UTF-8, without decoding it."""
    return batch.column(name).cast(pa.large_binary()).to_pylist()


def in_blocks(values: Iterable, most: int, size=len) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive values with at most `most` together (or one value that is larger)."""
    start = total = i = 0
    for i, v in enumerate(values, 1):
        n = size(v) if v is not None else 0
        if i - 1 > start and total + n > most:
            yield start, i - 1
            start, total = i - 1, 0
        total += n
    if i > start:
        yield start, i


#: Ids are broadcast up to this many, 16 MB of longs; beyond, the join shuffles.
BROADCAST_IDS = 2_000_000


def by_ids(df: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """df semi- or anti-joined with distinct ids of a written table. Rows with texts stay where they are as long as the counted ids are few."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("merge"), key, how)
