"""A kept inverted index for lexical search, in versions.

Rows are dealt into shards by a hash of their key, and in each a row has a number in the order of keys. A posting row holds one term of one shard: the numbers of the
rows that have it, how often, and how long these rows are; and for each range of RANGE numbers the largest count and the smallest length, from which follows a score that no row of the
range can pass, whatever the statistics are later. Postings lie in parts by a hash of the term, sorted, so that a search reads the parts of its terms alone. In a shard
it scores ranges from the most promising on, and stops where none of the rest can reach the k-th best score.

An update adds shards of its own for new and changed rows and says which numbers of older shards are dead; counts of terms, rows and words are put right by rows with
negative counts, so that scores are those of the rows that are left. All tables change in one commit. An index of many updates is built anew from its rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from lodestar.operators.lexical import K1, QUERY_BLOCK, QUERY_BYTES, SEPARATOR, B, Vocabulary, query_terms
from lodestar.sources import commits

#: Parts of the postings (every task that writes some opens a file in each, which costs more than the postings where parts are many); rows and bytes of a shard, about; row numbers in a range.
PARTS, SHARD_ROWS, SHARD_BYTES, RANGE = 16, 1 << 13, 4 << 20, 256
#: Texts of about so many bytes are cut into words at a time.
SLICE_BYTES = 512 << 10
#: Terms that are written into the filter, which reaches the scan; more are joined.
LISTED = 1000
#: An update's shards come after this many of the one before.
SHARDS = 1 << 32

#: gaps: the numbers of the rows, each less the one before. Gaps, counts and lengths are packed: unsigned numbers of 1, 2, 4 or 8 bytes, of one width in a column of a shard.
POSTING = "shard long, term string, n long, gaps binary, counts binary, lengths binary, ranges array<int>, starts array<int>, most array<int>, least array<int>"
#: Rows of the same table without a term are the indexed rows, in a part of their own.
DOCS = "docs"


def _term_part(term: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(parts)).cast("int")


def _packed(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Runs of numbers that are not negative as binaries, in the least width that holds all of them."""
    width = np.min_scalar_type(int(values.max()) if len(values) else 0).itemsize
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * width).astype(np.int32)), pa.py_buffer(values.astype(f"<u{width}"))])


def _unpacked(column: pa.ChunkedArray, total: int) -> np.ndarray:
    """All numbers of a column of one shard, `total` of them."""
    data = np.frombuffer(b"".join(memoryview(c.buffers()[2])[_at(c, 0) : _at(c, len(c))] for c in column.cast(pa.binary()).chunks if len(c)), np.uint8)
    return data.view(f"<u{max(1, len(data) // max(1, total))}").astype(np.int64)


def _at(chunk: pa.Array, i: int) -> int:
    """Where value i of a binary array begins in its data."""
    return int(np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset + i])


def _numbers(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the rows of all postings of one shard, and where each posting's begin and the last ends. No posting is empty."""
    bounds = np.r_[0, np.cumsum(table.column("n").to_numpy())]
    gaps = _unpacked(table.column("gaps"), int(bounds[-1]))
    total, starts = np.cumsum(gaps), bounds[:-1]
    return total - np.repeat(total[starts] - gaps[starts], np.diff(bounds)), bounds


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of texts, and for each word in turn its place among them and its text. Words are coded slice by slice, so that those of all texts are never held."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = [0, *(np.flatnonzero(np.diff(ends // SLICE_BYTES)) + 1).tolist(), len(texts)]
    coded, owners = [], []
    for a, b in zip(cuts, cuts[1:], strict=False):
        words = pc.split_pattern_regex(texts.slice(a, b - a), SEPARATOR)
        flat, owner = pc.list_flatten(words), pc.list_parent_indices(words).to_numpy(zero_copy_only=False)
        filled = pc.greater(pc.binary_length(flat), 0)
        coded.append(flat.filter(filled).dictionary_encode())
        owners.append((owner[filled.to_numpy(zero_copy_only=False)] + a).astype(np.int32))
    coded = pa.chunked_array(coded).unify_dictionaries()
    return coded.chunk(0).dictionary.cast(pa.string()), np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in coded.chunks]), np.concatenate(owners)


def _indexed(key: str, kind: pa.DataType):
    ints = pa.list_(pa.int32())
    types = {"shard": pa.int64(), "term": pa.string(), "n": pa.int64(), **{c: pa.binary() for c in ("gaps", "counts", "lengths")}, **{c: ints for c in ("ranges", "starts", "most", "least")}, "number": pa.int32(), "length": pa.int32(), key: kind}

    def build(table: pa.Table) -> pa.Table:
        """The postings and the rows of one shard."""
        shard, n = table.column("shard")[0].as_py(), len(table)
        order = pc.array_sort_indices(table.column(key).combine_chunks())
        keys, texts = table.column(key).combine_chunks().take(order), table.column("_lowered").combine_chunks().take(order).fill_null("")
        del table
        terms, codes, owner = _words(texts)
        del texts
        lengths = np.bincount(owner, minlength=n).astype(np.int32)
        cells = codes.astype(np.int64) * n + owner
        del codes, owner
        cells.sort()
        at = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]]) if len(cells) else np.empty(0, np.int64)
        counts = np.diff(np.r_[at, len(cells)]).astype(np.int32)
        cells = cells[at]
        of, number = (cells // max(1, n)).astype(np.int32), (cells % max(1, n)).astype(np.int32)
        del cells, at
        bounds = np.searchsorted(of, np.arange(len(terms) + 1))
        gaps = np.diff(number, prepend=np.int32(0))
        gaps[bounds[:-1]] = number[bounds[:-1]]
        block = number // RANGE
        first = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (of[1:] != of[:-1])]) if len(block) else np.empty(0, np.int64)  # ranges of terms, in order
        length = lengths[number]
        most = np.maximum.reduceat(counts, first) if len(first) else first
        least = np.minimum.reduceat(length, first) if len(first) else first
        rbounds = np.searchsorted(first, bounds)
        lists = lambda values: pa.ListArray.from_arrays(pa.array(rbounds.astype(np.int32)), pa.array(np.asarray(values).astype(np.int32)))
        postings = {
            "shard": pa.array(np.full(len(terms), shard)), "term": terms, "n": pa.array(np.diff(bounds)), "gaps": _packed(gaps, bounds), "counts": _packed(counts, bounds), "lengths": _packed(length, bounds),
            "ranges": lists(block[first]), "starts": lists(first - bounds[of[first]] if len(first) else first), "most": lists(most), "least": lists(least),
        }
        docs = {"shard": pa.array(np.full(n, shard)), "number": pa.array(np.arange(n, dtype=np.int32)), "length": pa.array(lengths), key: keys}
        both = lambda c: pa.chunked_array([part[c] if c in part else pa.nulls(m, types[c]) for part, m in ((postings, len(terms)), (docs, n))], types[c])
        return pa.table({c: both(c) for c in types})

    return build


def shards_of(rows: DataFrame, text: str = "text", shard_rows: int = SHARD_ROWS, shard_bytes: int = SHARD_BYTES) -> int:
    """How many shards rows of texts fill."""
    n, size = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length(text))).first()
    return max(1, -(-n // shard_rows), -(-(size or 0) // shard_bytes))


def _segment(rows: DataFrame, key: str, text: str, first_shard: int, shards: int) -> DataFrame:
    """Postings and rows of new shards."""
    dealt = rows.select((F.pmod(F.xxhash64(key), F.lit(shards)) + first_shard).alias("shard"), key, F.lower(F.col(text)).alias("_lowered"))
    kind = rows.schema[key].dataType
    return dealt.groupBy("shard").applyInArrow(_indexed(key, to_arrow_type(kind)), f"{POSTING}, number int, length int, `{key}` {kind.simpleString()}")


def _part(parts: int) -> Column:
    return F.when(F.col("term").isNull(), DOCS).otherwise(_term_part(F.col("term"), parts).cast("string"))


def _checked(rows: DataFrame, key: str, text: str) -> DataFrame:
    return rows.select(F.when(F.col(key).isNull(), F.raise_error(F.lit("a row without a key")).cast(rows.schema[key].dataType)).otherwise(F.col(key)).alias(key), F.col(text).alias("_text"))


def _docs(spark: SparkSession, now: commits.Snapshot) -> DataFrame:
    return now.read(spark, "postings", [DOCS]).drop(*(f.split()[0] for f in POSTING.split(", ")[1:]))


def alive(spark: SparkSession, now: commits.Snapshot) -> DataFrame:
    """The rows of the index that no update has put out: shard, number, length and the key."""
    docs = _docs(spark, now)
    if "dead" not in now.schemas:
        return docs
    out = now.read(spark, "dead").select("shard", F.explode("numbers").alias("number"))
    return docs.join(out, ["shard", "number"], "left_anti")


def _added(spark: SparkSession, base: commits.Snapshot, rows: DataFrame, removed: DataFrame | None, key: str, parts: int, shards: int | None) -> dict[str, commits.Staged]:
    """What a commit adds: new shards, and where rows go, dead numbers and corrections of the counts. A task writes a file into each part, sorted by term."""
    segment = _segment(rows, key, "_text", (base.version + 1) * SHARDS, shards or shards_of(rows, "_text"))
    part = _part(parts)
    postings = commits.stage(segment.sortWithinPartitions(part, "term", "shard"), base.root, "postings", part)
    at = postings.parts.get(DOCS)
    docs = spark.read.schema(postings.schema).parquet(f"{base.root}/data/{at}") if at else spark.createDataFrame([], postings.schema)
    count = lambda df, sign: df.agg((sign * F.count(F.lit(1))).alias("rows"), (sign * F.coalesce(F.sum("length"), F.lit(0))).alias("words"), F.lit(parts).alias("parts"))
    stats, added = count(docs, 1), {"postings": postings}
    if "postings" in base.schemas:
        # the keys that come in are read from what was written: rows may be long to work out
        gone = docs.select(key) if removed is None else docs.select(key).union(removed.select(key))
        dead = alive(spark, base).join(gone.select(key).distinct(), key, "left_semi").groupBy("shard").agg(F.collect_list("number").alias("numbers"), F.sum("length").alias("length"), F.count(F.lit(1)).alias("rows"))
        added["dead"] = commits.stage(dead, base.root, "dead")
        dead = spark.read.schema(added["dead"].schema).parquet(f"{base.root}/data/{added['dead'].parts['']}")
        stats = stats.unionByName(dead.agg((-F.coalesce(F.sum("rows"), F.lit(0))).alias("rows"), (-F.coalesce(F.sum("length"), F.lit(0))).alias("words"), F.lit(parts).alias("parts")))
        # the terms of dead rows are in the postings of their shards
        held = base.read(spark, "postings", [p for p in base.parts("postings") if p != DOCS]).select("shard", "term", "n", "gaps")
        near = held.join(dead.select("shard"), "shard", "left_semi").groupBy("shard").cogroup(dead.select("shard", "numbers").groupBy("shard"))
        fewer = near.applyInArrow(_lost, "term string, n long").groupBy("term").agg((-F.sum("n")).alias("n"))
        own = _term_part(F.col("term"), parts)
        added["fewer"] = commits.stage(fewer.repartition(own), base.root, "fewer", own)
    return added | {"stats": commits.stage(stats, base.root, "stats")}


def _lost(held: pa.Table, dead: pa.Table) -> pa.Table:
    """How many of the dead rows of a shard each term of it has."""
    if not len(held) or not len(dead):
        return pa.table({"term": pa.array([], pa.string()), "n": pa.array([], pa.int64())})
    out = np.concatenate([c.values.to_numpy() for c in dead.column("numbers")])
    numbers, bounds = _numbers(held)
    gone = np.zeros(max(int(numbers.max()), int(out.max())) + 1, bool)
    gone[out] = True
    n = np.add.reduceat(gone[numbers].astype(np.int64), bounds[:-1])
    both = pa.table({"term": held.column("term"), "n": pa.array(n)})
    return both.filter(pc.greater(both.column("n"), 0))


def build(rows: DataFrame, key: str, root: str, text: str = "text", parts: int = PARTS, shards: int | None = None) -> commits.Snapshot:
    """Indexes rows of unique keys under a folder where there is no index yet. A null key is an error; null texts are rows without a word. Without a number of shards the rows are
    counted first."""
    spark = rows.sparkSession
    if commits.latest(spark, root):
        raise FileExistsError(f"there is an index under {root}")
    base = commits.Snapshot(root)
    return commits.commit(spark, base, added=_added(spark, base, _checked(rows, key, text), None, key, parts, shards))


def update(rows: DataFrame, root: str, key: str, removed: DataFrame | None = None, text: str = "text", shards: int | None = None) -> commits.Snapshot:
    """Puts rows into the index, in the place of those with their keys, and takes out the keys of `removed`. Two updates at a time: the second is a Conflict, as it may have
    put out the same rows."""
    spark = rows.sparkSession
    base = commits.snapshot(spark, root)
    parts = base.read(spark, "stats").agg(F.max("parts")).first()[0]
    added = _added(spark, base, _checked(rows, key, text), removed, key, parts, shards)
    return commits.commit(spark, base, replaced={"turn": (commits.stage(spark.range(1), root, "turn"), [""])}, added=added)


class Ranges:
    """The postings of one shard for the terms of the queries, with what each range can reach at most."""

    def __init__(self, table: pa.Table, place: dict[str, int], idf: np.ndarray, mean: float, dead: np.ndarray, k1: float, b: float):
        weigh = lambda tf, n: tf * (k1 + 1) / (tf + k1 * (1 - b + b * n / mean))
        self.terms = {}
        if not len(table):
            return
        numbers, bounds = _numbers(table)
        places = np.array([place[t] for t in table.column("term").to_pylist()])
        unpacked = lambda c: _unpacked(table.column(c), int(bounds[-1]))
        score = np.repeat(idf[places], np.diff(bounds)) * weigh(unpacked("counts"), unpacked("lengths"))
        if len(dead):
            gone = np.zeros(max(int(numbers.max()), int(dead.max())) + 1, bool)
            gone[dead] = True
            score[gone[numbers]] = 0.0
        held = [table.column(c).combine_chunks() for c in ("ranges", "starts", "most", "least")]
        sizes = pc.list_value_length(held[0]).to_numpy()
        ranges, starts, most, least = (c.flatten().to_numpy() for c in held)
        reach, ends = np.repeat(idf[places], sizes) * weigh(most, least), np.r_[0, np.cumsum(sizes)]
        for i, t in enumerate(places.tolist()):
            a, b, c, d = bounds[i], bounds[i + 1], ends[i], ends[i + 1]
            self.terms[t] = (numbers[a:b], score[a:b], ranges[c:d], np.r_[starts[c:d], b - a], reach[c:d])

    def best(self, terms: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and scores (rounded to 6) of the best k rows, ties by the smaller number. Ranges are scored until what is left cannot reach the k-th."""
        held = [self.terms[t] for t in terms if t in self.terms]
        if not held:
            return np.empty(0, np.int64), np.empty(0)
        numbers, score, ranges, reach = (np.concatenate([h[i] for h in held]) for i in (0, 1, 2, 4))
        own, bound = numbers // RANGE, np.bincount(ranges, weights=reach)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        found, scores, at, step = np.empty(0, np.int64), np.empty(0), 0, 4
        while at < len(order):
            if len(scores) >= k and np.round(bound[order[at]] + 1e-9, 6) < scores[k - 1]:
                break
            now = np.sort(order[at : at + step])
            slot = np.full(len(bound), -1)
            slot[now] = np.arange(len(now))
            places = slot[own]
            mine = places >= 0
            total = np.bincount(places[mine] * RANGE + numbers[mine] % RANGE, weights=score[mine])
            cell = np.flatnonzero(total)
            found = np.r_[found, now[cell // RANGE] * RANGE + cell % RANGE]
            scores = np.r_[scores, np.round(total[cell], 6)]
            top = np.lexsort((found, -scores))[:k]
            found, scores = found[top], scores[top]
            at, step = at + step, step * 4
        return found, scores


def _scorer(shared, mean: float, k: int, arrow: pa.DataType, k1: float, b: float):
    def score(table: pa.Table, dead: pa.Table) -> pa.Table:
        """The best k rows of one shard for each query that shares a term with it."""
        own = shared.value
        out = np.concatenate([c.values.to_numpy() for c in dead.column("numbers")]) if len(dead) else np.empty(0, np.int64)
        ranges, asks = Ranges(table, own.place, own.idf, mean, out, k1, b), {}
        for q, t in own.pairs.tolist():
            if t in ranges.terms:
                asks.setdefault(q, []).append(t)
        found = [(q, *ranges.best(terms, k)) for q, terms in asks.items()]
        qids = [own.qids[q] for q, numbers, _ in found for _ in numbers]
        cat = lambda i, t: pa.array(np.concatenate([f[i] for f in found]) if found else np.empty(0), t)
        shard = table.column("shard")[0].as_py() if len(table) else 0
        return pa.table({"qid": pa.array(qids, arrow), "shard": pa.array(np.full(len(qids), shard), pa.int64()), "number": cat(1, pa.int32()), "score": cat(2, pa.float64())})

    return score


def top_k(spark: SparkSession, root: str, key: str, queries: DataFrame, k: int, version: int | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """qid, key, score (rounded to 6) and rank (from 1): what lexical.top_k() finds among the rows of the index, ties by the smaller key.

    Queries travel in blocks of counted size. Of the postings, the parts of their terms are read, and only the rows of these terms are shuffled, to their shards. Null qids
    and blank texts find nothing.
    """
    now = commits.snapshot(spark, root, version)
    rows, words, parts = now.read(spark, "stats").agg(F.sum("rows"), F.sum("words"), F.max("parts")).first()
    mean = words / rows if rows and words else 1.0
    queries = queries.where("qid is not null")
    n, size = queries.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    blocks = max(1, -(-n // QUERY_BLOCK), -(-(size or 0) // QUERY_BYTES))
    kind, found = queries.schema["qid"].dataType, None
    arrow = to_arrow_type(kind)
    for block in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == block) if blocks > 1 else queries
        own = Vocabulary([tuple(r) for r in query_terms(part).collect()])
        asked = spark.createDataFrame([(t,) for t in own.terms], "term string")
        wanted = {str(r[0]) for r in asked.select(_term_part(F.col("term"), parts)).distinct().collect()}
        postings = now.read(spark, "postings", sorted(wanted & set(now.parts("postings"))))
        asked_for = lambda df: df.where(F.col("term").isin(own.terms)) if len(own.terms) <= LISTED else df.join(F.broadcast(asked), "term", "left_semi")  # noqa: B023, E731
        postings = asked_for(postings)
        counts = postings.select("term", "n")
        if "fewer" in now.schemas:
            counts = counts.unionByName(asked_for(now.read(spark, "fewer", sorted(wanted & set(now.parts("fewer"))))))
        for r in counts.groupBy("term").agg(F.sum("n").alias("n")).collect():
            own.idf[own.place[r.term]] = np.log(1 + (rows - r.n + 0.5) / (r.n + 0.5))
        shared = spark.sparkContext.broadcast(own)

        out = now.read(spark, "dead").select("shard", "numbers") if "dead" in now.schemas else spark.createDataFrame([], "shard long, numbers array<int>")
        held = postings.groupBy("shard").cogroup(out.groupBy("shard"))
        hits = held.applyInArrow(_scorer(shared, mean, k, arrow, k1, b), f"qid {kind.simpleString()}, shard long, number int, score double")
        found = hits if found is None else found.union(hits)
    near = found.withColumn("_r", F.rank().over(Window.partitionBy("qid").orderBy(F.desc("score")))).where(F.col("_r") <= k).drop("_r")
    keyed = _docs(spark, now).select("shard", "number", key).join(F.broadcast(near) if n * k <= 1_000_000 else near, ["shard", "number"])
    return keyed.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), key))).where(F.col("rank") <= k).select("qid", key, "score", "rank")
