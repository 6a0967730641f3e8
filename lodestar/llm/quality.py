"""Quality by compression: zstandard dictionaries trained on good and on bad text.

Text like what a dictionary was trained on takes fewer bytes with it. Texts are compressed in pieces of PIECE bytes, so that a dictionary
counts all along a long text. The difference of the two sizes, by the text's own size and by the sum of both, goes into a logistic function, each
also weighted by how short the text is, with that shortness for what a difference of nothing means. The function is calibrated on rows that the dictionaries have not seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import byte_values, drop_written, id_remainder, small_batches, written
from lodestar.llm.sampling import bounded_sample

PIECE = 2048
LEVEL = 3
DICTIONARY_BYTES = 1 << 16
#: Rows of each label that the model is fitted on, at most about, and pieces that a dictionary is trained on.
ROWS_PER_LABEL, PIECES = 3000, 4000


class Compressors:
    """Differences between the sizes of a text with the bad and with the good dictionary."""

    def __init__(self, bad: bytes, good: bytes):
        plain = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.all = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), **plain) for d in (bad, good)]

    def features(self, text: bytes) -> tuple[float, ...]:
        pieces = [text[i : i + PIECE] for i in range(0, len(text), PIECE)] or [b""]
        bad, good = (sum(len(c.compress(p)) for p in pieces) for c in self.all)
        n = max(1, len(text))
        of_text, of_both, short = (bad - good) / n, (bad - good) / (bad + good), 1 / (1 + n / 100)
        return of_text, of_both, short * of_text, short * of_both, short


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights, the last of which is the constant, by Newton steps on standardised columns."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return np.r_[w[:-1] / scale, w[-1] - (w[:-1] * mean / scale).sum()]


class QualityModel:
    def __init__(self, bad: bytes, good: bytes, weights: np.ndarray):
        self.bad, self.good, self.weights = bad, good, weights


def _train(pieces: list[bytes]) -> bytes:
    """A dictionary; with too little text for training, the text itself."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces, k=32, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(pieces)[-DICTIONARY_BYTES:]


def fit_quality_model(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", label_key: str = "doc_id", rows_per_label: int = ROWS_PER_LABEL, pieces: int = PIECES) -> QualityModel | None:
    """Fitted on a sample of the labelled documents: two thirds for the dictionaries, one third for the calibration.

    The sampled ids, at most 4 * rows_per_label, are broadcast to find their texts; those pass through a written table. None unless both
    labels occur in both parts.
    """
    usable = labels.select(F.col(label_key).alias("key"), F.col(label).cast("int").alias("label")).where("key is not null and label in (0, 1)")
    sampled = bounded_sample(usable, "label", "key", rows_per_label, seed=3)
    known = small_batches(docs).select(F.col(key).alias("key"), F.col(text).alias("text")).where("text <> ''")
    rows = written(known.join(F.broadcast(sampled.select("key", "label")), "key").withColumn("part", F.pmod(F.xxhash64(F.lit(5), "key"), F.lit(3))), "labelled")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels_, keys = batch.column("label").to_pylist(), batch.column("key").to_pylist()
            out = [(labels_[i], k, b, t[b : b + PIECE]) for i, (k, t) in enumerate(zip(keys, byte_values(batch, "text"), strict=True)) for b in range(0, len(t), PIECE)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["label", "key", "at", "piece"])

    parts = rows.where("part > 0").select("label", F.col("key").cast("long").alias("key"), "text").mapInArrow(cut, "label int, key long, at long, piece binary")
    order = (F.xxhash64(F.lit(6), "key", "at"), "key", "at", "piece")
    sets = [[bytes(r.piece) for r in parts.where(F.col("label") == v).orderBy(*order).limit(pieces).collect()] for v in (0, 1)]
    if not all(sets):
        drop_written(rows)
        return None
    bad, good = map(_train, sets)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Compressors(bad, good)
        for batch in batches:
            found = [list(own.features(t)) for t in byte_values(batch, "text")]
            if found:
                yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found, pa.list_(pa.float64()))], ["label", "x"])

    held = rows.where("part = 0").select("label", "text").mapInArrow(measured, "label int, x array<double>").orderBy("label", "x").collect()
    drop_written(rows)
    y = np.array([r.label for r in held], float)
    if len(set(y)) < 2:
        return None
    return QualityModel(bad, good, fit_logistic(np.array([r.x for r in held]), y))


def score_quality(df: DataFrame, model: QualityModel | None, text: str = "text") -> DataFrame:
    """df with score (0 to 1) and predicted (1 if score >= 0.5, else 0); older columns with these names are replaced.

    Null texts count as empty ones, which get the calibrated score of no text at all. Without a model every score is 0.5. Whole texts are used;
    repeated rows and null ids are rows like others; an empty table gives an empty result. No shuffle.
    """
    source = small_batches(df).drop("score", "predicted")
    model = df.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        compressors = Compressors(own.bad, own.good) if own else None
        for batch in batches:
            texts = byte_values(batch, text)
            if own and texts:
                x = np.array([compressors.features(t or b"") for t in texts])
                score = 1 / (1 + np.exp(-np.clip(x @ own.weights[:-1] + own.weights[-1], -30, 30)))
            else:
                score = np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema)
    return source.mapInArrow(scored, f"{kinds}, score double, predicted int")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(id_remainder(F.col("doc_id"), 3) != 1)
    model = fit_quality_model(docs, labels)
    return score_quality(docs.select("doc_id", (id_remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "text"), model).select("doc_id", "held_out", "score", "predicted")
