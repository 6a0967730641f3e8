"""Bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labels of more classes than this are an error.
MAX_CLASSES = 1000


def bounded_sample(df: DataFrame, label: str, key: str, per_class: int, seed: int = 1) -> DataFrame:
    """About per_class rows of each label and at most 2 * per_class * classes together, chosen by a hash of the key.

    One pass counts the labels, so that the hash threshold of each is known; the rows are then picked by a filter and, as a bound that
    holds for any keys, by a top-k of the hash. Adds the column `_hash`. Rows with a null label are not used.
    """
    counts = df.where(F.col(label).isNotNull()).groupBy(label).count().limit(MAX_CLASSES + 1).collect()
    if len(counts) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} labels")
    rows = df.withColumn("_hash", F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30)))
    keep = F.lit(False)
    for label_value, n in counts:
        share = min(1.0, (per_class + 4 * per_class**0.5) / n)
        keep = keep | ((F.col(label) == F.lit(label_value)) & (F.col("_hash") < int(share * (1 << 30)) + 1))
    return rows.where(keep).orderBy("_hash", key).limit(2 * per_class * max(1, len(counts)))
