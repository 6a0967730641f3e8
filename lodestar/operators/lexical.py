"""Lexical search: BM25 over lower-cased runs of letters and digits, without stemming.

The queries are few against the rows, so they travel: their vocabulary is broadcast, in blocks of a checked size. One pass over the rows counts them,
their words, and for each term of the vocabulary the rows that hold it; a second one scores each Arrow batch as a product of two matrices, terms of
rows by terms of queries, and keeps rows of each query that are among its best k so far. No posting is shuffled, however common a word is: only counts are, and k rows
for each query and batch at most, of which Spark's own limit keeps k for each query and partition before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from lodestar.session import small_batches

K1, B = 1.2, 0.75
#: Queries are broadcast in blocks of at most so many, and of so many bytes of text (or one query that is longer).
QUERY_BLOCK, QUERY_BYTES = 2048, 4 << 20
#: Scores are made for so many cells of rows by queries at a time.
CELLS = 1 << 20
SEPARATOR = r"[^\p{L}\p{N}]+"


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), SEPARATOR), lambda t: t != "")


def query_terms(queries: DataFrame) -> DataFrame:
    return queries.select("qid", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))


class Vocabulary:
    """The terms of a block of queries, and what each query weighs: 1 for each of its terms."""

    def __init__(self, terms: list[tuple[object, str]]):
        self.terms = sorted({t for _, t in terms})
        self.qids = sorted({q for q, _ in terms})
        self.place, row = {t: i for i, t in enumerate(self.terms)}, {q: i for i, q in enumerate(self.qids)}
        self.pairs = np.array([(row[q], self.place[t]) for q, t in terms], np.int64).reshape(-1, 2)
        self.idf = np.ones(len(self.terms))

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of lower-cased texts: the number of words of each, and row, term and count of each term of the vocabulary in a row."""
        words = pc.split_pattern_regex(texts.fill_null(""), SEPARATOR)
        flat, owner = pc.list_flatten(words), pc.list_parent_indices(words).to_numpy(zero_copy_only=False)
        filled = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
        sizes = np.bincount(owner[filled], minlength=len(texts))
        found = pc.index_in(flat, value_set=pa.array(self.terms, pa.string())).fill_null(-1).to_numpy(zero_copy_only=False)
        cells, tf = np.unique(owner[found >= 0].astype(np.int64) * len(self.terms) + found[found >= 0], return_counts=True)
        return sizes, cells // max(1, len(self.terms)), cells % max(1, len(self.terms)), tf


def _scores(own: Vocabulary, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """The score of all n rows for each query that shares a term with one of them: blocks of queries by blocks of terms, so that memory is bounded."""
    here = np.flatnonzero(np.bincount(terms, minlength=len(own.terms)))
    place = np.full(len(own.terms), -1)
    place[here] = np.arange(len(here))
    pairs = own.pairs[place[own.pairs[:, 1]] >= 0]
    asked = np.unique(pairs[:, 0])
    step = max(1, CELLS // max(1, n, len(here)))
    for at in range(0, len(asked), step):
        block = asked[at : at + step]
        mine = pairs[np.isin(pairs[:, 0], block)]
        wanted = np.zeros((len(block), len(here)))
        wanted[np.searchsorted(block, mine[:, 0]), place[mine[:, 1]]] = 1.0
        total = np.zeros((len(block), n))
        width = max(1, CELLS // max(1, n))
        for low in range(0, len(here), width):
            inside = (place[terms] >= low) & (place[terms] < low + width)
            held = np.zeros((min(width, len(here) - low), n))
            held[place[terms[inside]] - low, rows[inside]] = weights[inside]
            total += wanted[:, low : low + width] @ held
        yield from zip(block.tolist(), total, strict=True)


def top_k(rows: DataFrame, key: str, queries: DataFrame, k: int, text: str = "text", keep: tuple[str, ...] = (), k1: float = K1, b: float = B) -> DataFrame:
    """qid, key, the columns of `keep`, score (rounded to 6) and rank (from 1): the best k rows of each query(qid, text), ties by the smaller key.

    Only rows that share a term with the query are found. Blank and null queries and those with a null qid find nothing, null texts are found by nothing but count as rows.
    """
    spark, queries = rows.sparkSession, queries.where("qid is not null")
    n, size = queries.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    blocks = max(1, -(-n // QUERY_BLOCK), -(-(size or 0) // QUERY_BYTES))
    lowered = small_batches(rows).select(key, *(c for c in keep if c != key), F.lower(F.col(text)).alias("_lowered"))
    qid, found = queries.schema["qid"].dataType.simpleString(), None
    for block in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == block) if blocks > 1 else queries
        own = Vocabulary([tuple(r) for r in query_terms(part).collect()])
        counted = spark.sparkContext.broadcast(own)

        def count(batches: Iterator[pa.RecordBatch], counted=counted) -> Iterator[pa.RecordBatch]:
            own = counted.value
            frequency, total, words = np.zeros(len(own.terms), np.int64), 0, 0
            for batch in batches:
                sizes, _, terms, _ = own.counts(batch.column(0))
                frequency += np.bincount(terms, minlength=len(own.terms))
                total, words = total + len(sizes), words + int(sizes.sum())
            held = np.flatnonzero(frequency)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[-2, -1, held]), pa.array(np.r_[total, words, frequency[held]])], ["term", "n"])

        sums = {r.term: r.n for r in lowered.select("_lowered").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
        total, words = sums.pop(-2, 0), sums.pop(-1, 0)
        mean = words / total if total and words else 1.0
        for term, df in sums.items():
            own.idf[term] = np.log(1 + (total - df + 0.5) / (df + 0.5))
        weighed = spark.sparkContext.broadcast(own)

        def score(batches: Iterator[pa.RecordBatch], weighed=weighed, mean=mean) -> Iterator[pa.RecordBatch]:
            own, bars = weighed.value, {}
            for batch in batches:
                sizes, held, terms, tf = own.counts(batch.column("_lowered"))
                weights = own.idf[terms] * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * sizes[held] / mean)))
                order = pc.rank(batch.column(key), tiebreaker="first", null_placement="at_start").to_numpy(zero_copy_only=False)
                qids, places, scores = [], [], []
                for q, of_rows in _scores(own, held, terms, weights, batch.num_rows):
                    hit = np.flatnonzero(of_rows > 0)
                    rounded = np.round(of_rows[hit], 6)
                    # the best k scores of this and earlier batches: what is below all of them is not among the best k
                    seen = np.r_[bars.get(q, rounded[:0]), rounded]
                    bars[q] = np.partition(seen, len(seen) - k)[len(seen) - k :] if len(seen) > k else seen
                    if len(seen) >= k:
                        kept = rounded >= bars[q].min()
                        hit, rounded = hit[kept], rounded[kept]
                    best = np.lexsort((order[hit], -rounded))[:k]
                    qids += [own.qids[q]] * len(best)
                    places.append(hit[best])
                    scores.append(rounded[best])
                if qids:
                    chosen = batch.drop_columns(["_lowered"]).take(pa.array(np.concatenate(places)))
                    yield pa.RecordBatch.from_arrays([pa.array(qids).cast(kind), *chosen.columns, pa.array(np.concatenate(scores))], ["qid", *chosen.schema.names, "score"])

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lowered.schema if f.name != "_lowered")
        kind = to_arrow_type(queries.schema["qid"].dataType)
        hits = lowered.mapInArrow(score, f"qid {qid}, {kinds}, score double")
        found = hits if found is None else found.union(hits)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), key))).where(F.col("rank") <= k)
