"""Session settings that the operators rely on."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: WindowGroupLimit must reach the largest candidate cap (5000) to push top-k per key below the shuffle.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
}


def make_session(master: str | None = None, shuffle_partitions: int | None = None, app: str = "lodestar") -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A table of Parquet. With `spread`, for tables whose rows take long to work on, one that is a single file has its rows dealt over the cores: such a
    file is small and often one row group, which one task would read and work on alone. Folders are split as they are, without a shuffle."""
    path = f"{sf_dir}/{name}.parquet"
    df = spark.read.parquet(path)
    if spread:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        cores = spark.sparkContext.defaultParallelism
        if cores > 1 and at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
            return df.repartition(cores)
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or what setCheckpointDir() was given. Where neither is set, a local master gets a temporary folder of
    its own; on a cluster that is an error, as executors would not see a folder of the driver's machine."""
    context, at = spark.sparkContext._jsc.sc(), spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir().isEmpty():
        if not at and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(at or f"file://{tempfile.mkdtemp(prefix='lodestar-')}")
    return (at or context.getCheckpointDir().get()).rstrip("/")


_made: set[str] = set()


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder within the shared one, for what a result reads as long as the driver's Python runs: it is deleted at its end."""
    at = f"{shared_dir(spark)}/lodestar-work-{spark.sparkContext.applicationId}"
    if at not in _made:
        _made.add(at)
        atexit.register(_delete, spark, at)
    return f"{at}/{name}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # at the end the JVM may be gone already
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jvm.org.apache.hadoop.conf.Configuration()).delete(at, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Arrow batches for Python are cut at so many rows and bytes where the session says nothing else: the JVM and a worker both hold a batch.
ARROW_ROWS, ARROW_BYTES = 1000, 8 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose batches are bounded."""
    conf = df.sparkSession.conf
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        if key not in conf.getAll:
            conf.set(key, str(value))
    return df
