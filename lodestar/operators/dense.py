"""Vectors: normalising, ids, and exact top-k by inner product.

The queries of a search are few against the vectors, so they travel: their matrix is broadcast, in blocks of a checked size, and each partition
keeps its own best k of each query by one matrix product. Only k rows for each query and partition are shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Queries are broadcast in blocks of at most so many.
QUERY_BLOCK = 4096


def normalized(c: Column) -> Column:
    """Of unit length; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(c, lambda x: (x.cast("double") / norm).cast("float"))).otherwise(c)


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def checked_dimension(vectors: DataFrame, column: str = "embedding") -> int | None:
    """The one dimension of all vectors; an error where there are several."""
    least, most = vectors.agg(F.min(F.size(column)), F.max(F.size(column))).first()
    if least != most:
        raise ValueError(f"vectors of {least} to {most} dimensions")
    return most


def hash_encoder(texts: list[str | None], dimensions: int = 64) -> np.ndarray:
    """Unit vectors of signed word counts at hashed places: a stand-in for a model, with the same interface."""
    out = np.zeros((len(texts), dimensions), np.float32)
    for i, text in enumerate(texts):
        for word in (text or "").lower().split():
            h = zlib.crc32(word.encode())
            out[i, h % dimensions] += 1 if h & 0x80000000 else -1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def encode(df: DataFrame, text: str = "text", dimensions: int = 64, encoder=hash_encoder) -> DataFrame:
    """df with an embedding of each text, in Arrow batches. `encoder` maps a list of texts to a matrix."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = encoder(batch.column(text).to_pylist(), dimensions).astype(np.float32)
            offsets = pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * dimensions)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(vectors.ravel()))], [*batch.schema.names, "embedding"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(encoded, f"{kinds}, embedding array<float>")


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the best k, by score rounded to 6 places and then by id."""
    rounded = np.round(scores, 6)
    if len(rounded) > k:
        bar = np.partition(rounded, len(rounded) - k)[len(rounded) - k]
        own = np.flatnonzero(rounded >= bar)
    else:
        own = np.arange(len(rounded))
    return own[np.lexsort((ids[own], -rounded[own]))[:k]]


def top_k(vectors: DataFrame, queries: DataFrame, k: int, same: str | None = None, id_column: str = "faiss_id", strict: bool = True) -> DataFrame:
    """qid, faiss_id, score (rounded to 6), rank (from 1): the best k vectors of each query by inner product, ties by the smaller id.

    `queries` has qid, embedding and, with `same`, a column that must equal the vectors' column of that name: a search within a
    partition of the vectors, whose filter reaches the scan when the vectors are partitioned by it. Null vectors are not compared. Vectors of
    another dimension than a query's are an error, unless `strict` is off: then they are not compared either.
    """
    n = queries.count()
    parts = max(1, -(-n // QUERY_BLOCK))
    found = None
    for block in range(parts):
        own = queries.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == block) if parts > 1 else queries
        rows = own.select("qid", "embedding", *([same] if same else [])).where("embedding is not null").collect()
        q = vectors.sparkSession.sparkContext.broadcast(rows)

        def scored(batches: Iterator[pa.RecordBatch], q=q) -> Iterator[pa.RecordBatch]:
            rows = q.value
            if not rows:
                return
            groups: dict = {}
            for r in rows:
                groups.setdefault((r[2] if same else None, len(r.embedding)), []).append(r)
            groups = {g: ([r.qid for r in rs], np.array([r.embedding for r in rs], np.float64)) for g, rs in groups.items()}
            for batch in batches:
                ids = batch.column("faiss_id").to_numpy(zero_copy_only=False)
                lists = batch.column("embedding")
                sizes = np.diff(lists.offsets.to_numpy())
                flat = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
                kinds = np.array(batch.column(same).to_pylist(), object) if same else None
                valid = lists.is_valid().to_numpy(zero_copy_only=False)
                if strict and not {int(n) for n in np.unique(sizes[valid])} <= {dim for _, dim in groups}:
                    raise ValueError(f"vectors of {sorted({int(n) for n in np.unique(sizes[valid])})} dimensions, queries of {sorted({dim for _, dim in groups})}")
                out = ([], [], [])
                for (kind, dim), (qids, matrix) in groups.items():
                    mine = np.flatnonzero(valid & (sizes == dim) & (kinds == kind if same else True))
                    if not len(mine):
                        continue
                    starts = lists.offsets.to_numpy()[mine]
                    x = flat[starts[:, None] + np.arange(dim)] if len(mine) < len(sizes) or len(flat) != len(sizes) * dim else flat.reshape(-1, dim)
                    for at in range(0, len(qids), 256):
                        scores = matrix[at : at + 256] @ x.T
                        for i, row in enumerate(scores):
                            best = _best(row, ids[mine], k)
                            out[0].extend([qids[at + i]] * len(best))
                            out[1].extend(ids[mine][best].tolist())
                            out[2].extend(row[best].tolist())
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["qid", "faiss_id", "score"])

        part = vectors.select(F.col(id_column).alias("faiss_id") if id_column != "faiss_id" else id_column, "embedding", *([same] if same else [])).mapInArrow(scored, "qid long, faiss_id long, score double")
        found = part if found is None else found.union(part)
    rounded = found.select("qid", "faiss_id", F.round("score", 6).alias("score"))
    return rounded.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "faiss_id"))).where(F.col("rank") <= k)


def with_fallback(own: DataFrame, every: DataFrame, queries: DataFrame, k: int, same: str) -> DataFrame:
    """The hits of each query among `own` vectors of its company (`same`), and among `every` vector for queries whose company has none, with their
    scope. A search finds nothing only where there are no vectors, so the companies alone tell which queries fall back: no search is run twice."""
    there = own.where("embedding is not null").select(same).distinct()
    first = top_k(own, queries.join(there, same, "left_semi"), k, same=same).withColumn("scope", F.lit("company"))
    return first.unionByName(top_k(every, queries.join(there, same, "left_anti"), k).withColumn("scope", F.lit("global_fallback")))


def over_fetch(k: int, hybrid: bool = False, filtered: bool = False, cap: int = 5000) -> int:
    """How many candidates a search for k rows takes before filters."""
    n = k * 4 if hybrid else k
    return max(n, min(max(cap, 200 * k), cap)) if filtered else n
