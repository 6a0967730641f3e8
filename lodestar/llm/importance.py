"""Importance resampling towards a target: documents are drawn by how much more often the target holds their hashed n-grams than all documents do.

Texts become streams of bucket numbers once: a row for each block of documents, with packed 16-bit buckets, the documents' keys and where each document's buckets
end, written to the shared folder. Counts come from sorting each block's stream and encoding its runs, so that only a count for each bucket leaves a task. A
second pass over the streams gathers the gains and adds them up for each document.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import byte_values, drop_written, in_blocks, small_batches, written

#: A block of documents has at most so many bytes of text (or one document that is longer).
BLOCK = 4 << 20
#: Texts are worked on in windows of so many bytes, cut between words.
WINDOW = 1 << 20
#: Words of more bytes go to zlib by themselves.
SHORT_WORD = 48
#: Buckets are 16-bit numbers.
MOST_BUCKETS = 1 << 16

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Letters, digits and whatever is not ASCII; upper-case letters are lower-cased before.
INSIDE = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


CRC = _crc_table()


def crc32s(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-32 of many ranges of bytes at once: byte by byte, over all ranges that are that long."""
    order = np.argsort(starts - ends, kind="stable")
    begin, size = starts[order], (ends - starts)[order]
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    few = np.searchsorted(-size, -SHORT_WORD)  # the first so many are longer
    data = b.tobytes() if few else b""
    left = len(order)
    for i in range(min(int(size[few]), SHORT_WORD) if few < len(size) else 0):
        left = np.searchsorted(-size, -i)  # those of more than i bytes come first
        part = crc[few:left]
        crc[few:left] = CRC[(part ^ b[begin[few:left] + i]) & np.uint32(0xFF)] ^ (part >> np.uint32(8))
    crc ^= np.uint32(0xFFFFFFFF)
    for i in range(few):
        crc[i] = zlib.crc32(data[begin[i] : begin[i] + size[i]])
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _windows(b: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about WINDOW bytes that end between words; longer where a word is."""
    at = 0
    while at < len(b):
        end = min(at + WINDOW, len(b))
        while end < len(b):
            cut = np.flatnonzero(~INSIDE[b[max(at, end - WINDOW) : end]])
            if len(cut):
                end = max(at, end - WINDOW) + int(cut[-1]) + 1
                break
            end = min(end + WINDOW, len(b))
        yield at, end
        at = end


def _edges(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts' lower-cased bytes, the starts and ends of their words, and the number of words of each text."""
    b = np.frombuffer(b"\n".join(t or b"" for t in texts).translate(LOWER), np.uint8)
    starts, ends = [], []
    for at, end in _windows(b):
        edge = np.diff(np.r_[False, INSIDE[b[at:end]], False].view(np.int8))
        starts.append(np.flatnonzero(edge == 1) + at)
        ends.append(np.flatnonzero(edge == -1) + at)
    none = np.empty(0, np.int64)
    s, e = (np.concatenate(x) if x else none for x in (starts, ends))
    begin = np.r_[0, np.cumsum([len(t or b"") + 1 for t in texts])]
    return b, s, e, np.diff(np.searchsorted(s, begin))


def bucket_stream(texts: list[bytes | None], buckets: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of all features of the texts in a row, how many each text has, and its number of words. Features are the runs of 1 to `longest` words of a text,
    joined by one space; those of n words come after those of n - 1."""
    b, starts, ends, words = _edges(texts)
    if longest == 1:
        return (crc32s(b, starts, ends) % np.uint32(buckets)).astype(np.uint16), words, words
    owner = np.repeat(np.arange(len(words)), words)
    joined = [b[s:e].tobytes() for s, e in zip(starts, ends, strict=True)]
    parts, owners = [], []
    for n in range(1, longest + 1):
        first = np.flatnonzero(owner[: len(owner) - n + 1] == owner[n - 1 :])
        parts.append(np.array([zlib.crc32(b" ".join(joined[i : i + n])) % buckets for i in first], np.uint16))
        owners.append(owner[first])
    order = np.argsort(np.concatenate(owners), kind="stable")
    return np.concatenate(parts)[order], np.bincount(np.concatenate(owners), minlength=len(words)), words


def streams(df: DataFrame, key: str, text: str, buckets: int, longest: int) -> DataFrame:
    """A row for each block of documents: their keys, where each one's features end, its words, and all buckets as packed 16-bit numbers."""
    kind = df.schema[key].dataType.simpleString()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_values(batch, "text")
            for start, end in in_blocks(texts, BLOCK):
                found, n, words = bucket_stream(texts[start:end], buckets, longest)
                one = lambda values: pa.ListArray.from_arrays(pa.array([0, end - start], pa.int32()), values)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([one(batch.column("key").slice(start, end - start)), one(pa.array(np.cumsum(n), pa.int64())), one(pa.array(words, pa.int64())), pa.array([found.astype("<u2").tobytes()], pa.binary())], ["keys", "ends", "words", "buckets"])

    return small_batches(df).select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(packed, f"keys array<{kind}>, ends array<long>, words array<long>, buckets binary")


def bucket_counts(blocks: DataFrame, buckets: int) -> np.ndarray:
    """How many features each bucket has: each block sorted, its runs encoded and added up; at most `buckets` counts from each task."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for packed in batch.column("buckets"):
                ordered = np.sort(np.frombuffer(packed.as_buffer(), "<u2"))
                if len(ordered):
                    runs = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
                    total[ordered[runs]] += np.diff(np.r_[runs, len(ordered)])
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in blocks.select("buckets").mapInArrow(counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of how much likelier each bucket is in the target, one added to each count."""
    s_all, t_all = float(own.sum() + len(own)), float(target.sum() + len(own))
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(own.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(blocks: DataFrame, by_bucket: np.ndarray) -> DataFrame:
    """doc_id, n_features, n_words and weight of each document of the streams: the gains of its buckets, gathered and added up."""
    kind = blocks.schema["keys"].dataType.elementType.simpleString()
    shared = blocks.sparkSession.sparkContext.broadcast(by_bucket)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                keys, ends, words = (batch.column(c)[row].values for c in ("keys", "ends", "words"))
                last = ends.to_numpy()
                first = np.r_[0, last[:-1]]
                found = shared.value[np.frombuffer(batch.column("buckets")[row].as_buffer(), "<u2")]
                weight, filled = np.zeros(len(last), np.int64), np.flatnonzero(last > first)
                if len(filled):  # reduceat() knows no empty ranges
                    weight[filled] = np.add.reduceat(found, first[filled])
                yield pa.RecordBatch.from_arrays([keys, pa.array(last - first), words, pa.array(weight)], ["doc_id", "n_features", "n_words", "weight"])

    return blocks.mapInArrow(added, f"doc_id {kind}, n_features long, n_words long, weight long")


def gumbel(key: Column, seed: int) -> Column:
    """floor(-1000 * ln(-ln(u))), where u in (0, 1) comes from the first 8 hexadecimal digits of sha256 of `seed:key`."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """scored with rank: 1, 2, 3 ... for the `percent` of the documents with enough words that have the highest scores, else null; ties to the smaller key.

    Documents are sorted by range and written; the sizes of the ranges, a number for each partition, say where each one's ranks begin. A document's rank then is
    its place in its own range.
    """
    spark = scored.sparkSession
    usable = F.col("n_words") >= least_words
    enough = scored.where(usable)
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    place = F.monotonically_increasing_id()  # partition and place in it
    ranges = written(enough.repartitionByRange(*order).sortWithinPartitions(*order).select("*", place.alias("_at")), "ranges")
    part, at = F.shiftright("_at", 33).cast("int"), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = sorted(tuple(r) for r in ranges.groupBy(part.alias("p")).agg(F.count(F.lit(1))).collect())
    starts, total = [], 0
    for p, n in sizes:
        starts.append((p, total))
        total += n
    most = total * percent // 100
    offsets = spark.createDataFrame(starts, "_part int, _offset long")
    rank = F.col("_offset") + at + 1
    drawn = ranges.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn("rank", F.when(rank <= most, rank))
    return drawn.select(*scored.columns, "rank").unionByName(scored.where(~usable).withColumn("rank", F.lit(None).cast("long")))


def resample(df: DataFrame, target: DataFrame, percent: int = 10, buckets: int = 10_000, longest: int = 1, least_words: int = 20, seed: int = 2024, key: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """doc_id (the key), n_features, weight, score and rank of every document.

    Words are runs of ASCII letters (lower-cased), digits and characters beyond ASCII. Null texts, empty ones and those without a word have no features and weight 0;
    equal rows are documents of their own, with ranks of their own; a null key is hashed as the empty text and comes last of equal scores. An empty target has the
    gains of its counts of 0. Empty tables give empty results. Other columns are ignored.
    """
    if not 1 <= buckets <= MOST_BUCKETS:
        raise ValueError(f"buckets must be from 1 to {MOST_BUCKETS}")
    kind = df.schema[key].dataType.simpleString()
    blocks = written(streams(df, key, text, buckets, longest), "streams")
    wanted = streams(target.select(F.lit(0).alias("key"), F.col(target_text).alias("text")), "key", "text", buckets, longest)
    by_bucket = gains(bucket_counts(blocks, buckets), bucket_counts(wanted, buckets))
    scored = written(weighed(blocks, by_bucket).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "scored")
    drop_written(blocks)
    return ranked(scored, percent, least_words).select(F.col("doc_id").cast(kind).alias(key), "n_features", "weight", "score", "rank")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: The same in SQL. CRC-32 by its polynomial, over each distinct word's bytes.
ORACLE = r"""
WITH t8 AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i::BIGINT)) AS t
), w AS (
  SELECT 'd' AS side, doc_id AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
  UNION ALL
  SELECT 'b', item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark
), hashed AS (
  SELECT word, xor(list_reduce(list_transform(range(strlen(word)), lambda i: ('0x' || substr(hex(word), 2 * i + 1, 2))::BIGINT), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM w), t8
), counted AS (
  SELECT side, id, bucket, count(*) AS n FROM w JOIN hashed USING (word) GROUP BY ALL
), sums AS (
  SELECT bucket, sum(CASE WHEN side = 'd' THEN n ELSE 0 END) AS s, sum(CASE WHEN side = 'b' THEN n ELSE 0 END) AS t FROM counted GROUP BY bucket
), totals AS (
  SELECT sum(s) AS s_all, sum(t) AS t_all FROM sums
), gain AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS g FROM sums, totals
), weights AS (
  SELECT id AS doc_id, sum(n)::BIGINT AS n_features, sum(n * g)::BIGINT AS weight FROM counted JOIN gain USING (bucket) WHERE side = 'd' GROUP BY id
), scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM documents LEFT JOIN weights USING (doc_id)
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""
