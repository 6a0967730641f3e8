"""Near-duplicate documents by MinHash bands and odd sketches.

Each distinct set of word shingles gets MinHash samples, made once from 64-bit shingle hashes. The samples serve twice. Rows of them
make bands, in which similar sets collide; and all of them, folded into a bitmap of parities (an odd sketch), tell how many samples
two sets differ in, by the population count of the bitmaps' XOR. Pairs that collide and whose sketches are near enough are confirmed
on the full sets of words. Equal sets are put together first, so that copies cost nothing after the first pass.

A bucket may hold a third of all rows, so pairs are not made within one of over SMALL members. Its members are first compared with a hub, the
one among their neighbours that collides with most others, as the least edited copy does. Members whom the hub leaves outside the largest
component are compared with that component, and what is then left apart with itself, in pairs of blocks of bounded size: a block looks up the
shingles of one side among those of the other, and reports one link at most for each two components that it joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.llm.common import byte_values, drop_written, in_blocks, small_batches, written
from lodestar.llm.components import connected_components
from lodestar.llm.wordhash import WordHasher

#: A pair of similarity 0.8 misses all bands with probability (1 - 0.8 ** 5) ** 32 = 3e-6.
BANDS, ROWS, SKETCH_BITS = 32, 5, 512
#: Buckets up to this many members are paired in full.
SMALL = 8
#: Members of a block, twice the square root of those of its group within these bounds, so that no meeting is much of the group's work; and
#: shingles of a block, 8 bytes each and about 6 of text.
LEAST_BLOCK, BLOCK, BLOCK_SHINGLES = 128, 1024, 1 << 20
#: Members that are compared with one copy of their hub.
SPOKES = 256
#: Rows of a few numbers that are broadcast, if counted to be so few: large buckets, hubs, and ids with the blocks they go to.
BROADCAST = 400_000
#: Copies of each row of a table by bucket where it is too large to broadcast, so that a bucket's members lie in as many tasks.
SALTS = 16


def word_list(text: bytes) -> list[bytes]:
    """bytes know only the ASCII rules: A-Z are lower-cased, and the six separators part words."""
    return text.lower().split()


def shingle_set(text: bytes, size: int) -> set:
    """The exact set of a text, for confirming links."""
    words = word_list(text)
    return {tuple(words)} if 0 < len(words) < size else set(zip(*(words[i:] for i in range(size)), strict=False))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text, from the hashes of its words."""
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out += words[i : i + n] * np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(32)
    out.sort()
    return out[np.flatnonzero(np.r_[True, out[1:] != out[:-1]])]


def samplers(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 2**31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, k, dtype=np.uint32)


def min_hashes(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """k MinHash samples of a set: minima of a * x + b over 32 bits, in blocks that bound memory."""
    x = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    out = np.full(len(a), 2**32 - 1, np.uint32)
    for i in range(0, len(x), 512):
        v = a[:, None] * x[None, i : i + 512]
        v += b[:, None]
        np.minimum(out, v.min(axis=1), out=out)
    return out


def odd_sketch(samples: np.ndarray, bits: int) -> np.ndarray:
    """Parities of how many samples fall into each bit, as 64-bit words."""
    k = np.arange(len(samples), dtype=np.uint64)
    h = (samples.astype(np.uint64) + (k << np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    at = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)) % np.uint64(bits)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def keyed_texts(df: DataFrame, text: str, key: str) -> DataFrame:
    """doc_id, th (a hash that tells texts of one id apart) and text."""
    return small_batches(df).select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))


def signatures(df: DataFrame, text: str, key: str, size: int, bands: int, rows: int, bits: int) -> DataFrame:
    """doc_id, th (a hash of the text), n (set size), set_hash (binary, null for an empty set), bands and sketch (arrays of long, null for an empty set)."""
    a, b = samplers(bands * rows)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            keys, marks, texts = batch.column(0), batch.column(1), byte_values(batch, "text")
            for start, end in in_blocks(texts, 2 << 20):
                n, set_hash, band, sketch = [], [], [], []
                hashed, bounds = hasher.hashes([t and t.lower() for t in texts[start:end]])
                for i in range(end - start):
                    h = shingle_hashes(hashed[bounds[i] : bounds[i + 1]], size)
                    n.append(len(h))
                    if not len(h):
                        set_hash.append(None), band.append(None), sketch.append(None)
                        continue
                    set_hash.append(xxhash.xxh3_128_digest(h.tobytes()))
                    m = min_hashes(h, a, b)
                    rows_of = m.reshape(bands, rows).astype(np.uint64)
                    v = np.arange(bands, dtype=np.uint64)
                    for r in range(rows):
                        v = (v ^ (v >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) + rows_of[:, r]
                    band.append((v ^ (v >> np.uint64(29))).view(np.int64))
                    sketch.append(odd_sketch(m, bits))
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(start, end - start), marks.slice(start, end - start), pa.array(n, pa.int64()), pa.array(set_hash, pa.binary()), pa.array(band, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64()))],
                    ["doc_id", "th", "n", "set_hash", "bands", "sketch"],
                )

    return keyed_texts(df, text, key).mapInArrow(signed, "doc_id long, th long, n long, set_hash binary, bands array<long>, sketch array<long>")


def differing_bits(x: Column, y: Column, words: int) -> Column:
    return sum((F.bit_count(x[i].bitwiseXOR(y[i])) for i in range(words)), F.lit(0))


def most_bits(k: int, bits: int, similarity: float, deviations: float = 4.75) -> int:
    """The largest XOR count that a pair of at least this similarity makes in all but about a millionth of cases. It varies with the
    number of samples that differ, and with how many of those fall on one bit."""
    differing = 2 * k * (1 - similarity)
    kept = (1 - 2 / bits) ** differing
    of_samples = 2 * (k * similarity * (1 - similarity)) ** 0.5 * kept
    of_bits = 2 * (differing**2 / (2 * bits)) ** 0.5
    return min(bits, int(bits * (1 - kept) / 2 + deviations * (of_samples**2 + of_bits**2) ** 0.5) + 1)


def may_match(n1: Column, n2: Column, percent: int) -> Column:
    return F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent


def linked(x: set, y: set, percent: int) -> bool:
    both = len(x & y)
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def by_bucket(members: DataFrame, table: DataFrame, n: int, how: str = "inner") -> DataFrame:
    """Members (sid, bucket, ...) joined with a written table of n rows, one for each bucket. A bucket's members stay in many tasks."""
    if n <= BROADCAST:
        return members.join(F.broadcast(table), "bucket", how)
    salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return members.withColumn("salt", F.pmod(F.xxhash64("sid"), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), ["bucket", "salt"], how).drop("salt")


def pairs_of(buckets: DataFrame) -> DataFrame:
    """Every pair (a, b) of members of buckets that have few: a > b."""
    lists = buckets.groupBy("bucket").agg(F.sort_array(F.collect_set("sid")).alias("all")).where(F.size("all") > 1).select("all", F.explode("all").alias("b"))
    return lists.select(F.explode(F.filter("all", lambda x: x > F.col("b"))).alias("a"), "b").distinct()


class Compared:
    """Compares the sets of texts: who is compared with whom is said by rows, and each row brings its text."""

    def __init__(self, df: DataFrame, text: str, key: str, reps: DataFrame, size: int, percent: int):
        self.texts, self.reps, self.size, self.percent = keyed_texts(df, text, key), reps, size, percent

    def with_texts(self, places: DataFrame) -> DataFrame:
        """Rows of places(sid, ...) with the text of the set sid. Where there are few, each document's text goes from where it is read to the places that
        want it; only the row numbers are broadcast."""
        columns = [c for c in places.columns if c != "sid"]
        wanted = places.groupBy("sid").agg(F.collect_list(F.struct(*columns)).alias("places")).join(self.reps.select("sid", F.col("id").alias("doc_id"), "th"), "sid")
        wanted = written(wanted, "wanted")
        rows, listed = wanted.agg(F.count(F.lit(1)), F.sum(F.size("places"))).first()
        wanted_ = F.broadcast(wanted) if rows + (listed or 0) <= BROADCAST else wanted.hint("merge")
        out = self.texts.join(wanted_, ["doc_id", "th"]).select("sid", "text", F.explode("places").alias("p")).select("sid", "text", "p.*")
        out._wanted = wanted
        return out

    def stars(self, pairs: DataFrame) -> DataFrame:
        """The links (a, b) among pairs(a, b, salt). The text of b goes to each salt once, and those of its a follow it."""
        own = written(pairs.select("a", "b", F.col("salt").cast("int").alias("salt")), "pairs")
        places = own.select(F.col("a").alias("sid"), "b", "salt", F.lit(1).alias("turn")).union(own.select("b", "b", "salt", F.lit(0)).distinct())
        rows = self.with_texts(places)
        size, percent = self.size, self.percent

        def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, center = None, set()
            for batch in batches:
                ids, hubs, turns, texts = batch.column("sid").to_pylist(), batch.column("b").to_pylist(), batch.column("turn").to_pylist(), byte_values(batch, "text")
                found = []
                for sid, hub, turn, t in zip(ids, hubs, turns, texts, strict=True):
                    if turn == 0:
                        at, center = (at, center) if at == hub else (hub, shingle_set(t or b"", size))
                    elif linked(shingle_set(t or b"", size), center, percent):
                        found.append((sid, hub))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

        ordered = rows.repartition("b", "salt").sortWithinPartitions("b", "salt", "turn", "sid").select("sid", "b", "turn", "text")
        links = written(ordered.mapInArrow(compared, "a long, b long"), "links")
        drop_written(own), drop_written(rows._wanted)
        return links

    def blocks(self, left: DataFrame, right: DataFrame | None) -> DataFrame:
        """Links (a, b) that join the components of left(grp, sid, n, component) and right, or of left among itself, where they are of one grp.

        Both are cut into blocks bounded in members and shingles; each two blocks of a group meet once. Within a meeting, an a is
        linked with one b of each component that it is not in yet, by what the meeting has found so far.
        """
        other = left if right is None else right
        n = F.count(F.lit(1))
        own_block = F.greatest(F.lit(LEAST_BLOCK), F.least(F.lit(BLOCK), 2 * F.sqrt(n)))
        parts = lambda x, name: x.groupBy("grp").agg(F.greatest(F.ceil(n / own_block), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias(name))
        grid = written(parts(left, "rows").join(parts(other, "columns"), "grp"), "grid")
        cells = grid.count()
        sized = F.broadcast(grid) if cells <= BROADCAST else grid.hint("merge")
        block = lambda n, seed: F.pmod(F.xxhash64("sid", F.lit(seed)), F.col(n)).cast("int")
        upto = lambda first, n: F.explode(F.sequence(first, F.col(n) - 1))
        if right is None:  # a block meets itself and those after it
            own = left.join(sized, "grp").withColumn("own", block("rows", 1))
            rows = own.select("sid", "grp", "component", F.col("own").alias("r"), upto(F.col("own"), "rows").alias("c"), F.lit(True).alias("asks"))
            columns = own.select("sid", "grp", "component", F.explode(F.sequence(F.lit(0), F.col("own"))).alias("r"), F.col("own").alias("c"), F.lit(False).alias("asks"))
        else:
            rows = left.join(sized, "grp").select("sid", "grp", "component", block("rows", 1).alias("r"), upto(F.lit(0), "columns").alias("c"), F.lit(True).alias("asks"))
            columns = right.join(sized, "grp").select("sid", "grp", "component", upto(F.lit(0), "rows").alias("r"), block("columns", 2).alias("c"), F.lit(False).alias("asks"))
        texts = self.with_texts(rows.union(columns))
        size, percent = self.size, self.percent

        def compared(group: pa.Table) -> pa.Table:
            a, b = block_links(group.column("sid").to_numpy(), group.column("component").to_numpy(), group.column("asks").to_numpy(), group.column("text").cast(pa.large_binary()).to_pylist(), size, percent)
            return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        links = written(texts.groupBy("grp", "r", "c").applyInArrow(compared, "a long, b long"), "links")
        drop_written(grid), drop_written(texts._wanted)
        return links


def block_links(ids: np.ndarray, components: np.ndarray, asks: np.ndarray, texts: list[bytes | None], size: int, percent: int) -> tuple[list[int], list[int]]:
    """Links between texts that ask and texts that do not, enough to join their components as all links would."""
    hashed, bounds = WordHasher().hashes([t and t.lower() for t in texts])
    sets = [shingle_hashes(hashed[bounds[i] : bounds[i + 1]], size) for i in range(len(ids))]
    members = np.array([i for i in range(len(ids)) if not asks[i] and len(sets[i])], np.int64)
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    a, b = [], []
    if not len(members):
        return a, b
    sizes = np.array([len(sets[i]) for i in members])
    flat = np.concatenate([sets[i] for i in members])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], np.repeat(np.arange(len(members)), sizes)[order]
    for i in np.flatnonzero(asks).tolist():
        x = sets[i]
        if not len(x):
            continue
        low, high = np.searchsorted(flat, x, "left"), np.searchsorted(flat, x, "right")
        n = high - low
        both = np.bincount(owner[np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())], minlength=len(members))
        for k in np.flatnonzero((both > 0) & (100 * both >= percent * (sizes + len(x) - both))).tolist():
            j = int(members[k])
            p, q = find(int(components[i])), find(int(components[j]))
            if p != q and linked(shingle_set(texts[i] or b"", size), shingle_set(texts[j] or b"", size), percent):
                root[max(p, q)] = min(p, q)
                a.append(int(ids[i]))
                b.append(int(ids[j]))
    return a, b


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, bits: int = SKETCH_BITS) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id and kept.

    Words are runs of non-separators after A-Z are lower-cased; the set of a document has its distinct shingles of `size` words, or
    its whole sequence where it has fewer words. Documents are linked if 100 * intersection >= percent * union; a component
    takes the smallest doc_id in it, which alone is kept. Null, empty and blank texts have empty sets and are linked with nothing.
    A null doc_id takes part in no link: its row has a null component and is kept. Rows that repeat a doc_id and text get equal
    rows; of one id with several texts, each row is in the components of its own text. Extra columns are ignored, an empty table gives an empty result, and texts of any length are used whole.
    """
    signed = written(signatures(df, text, key, size, bands, rows, bits), "signatures")
    usable = signed.where(F.col("set_hash").isNotNull() & F.col("doc_id").isNotNull())
    # one representative for each distinct set, a row of its smallest doc_id; arrays are equal within a set
    first = usable.groupBy("set_hash").agg(F.min(F.struct("doc_id", "th")).alias("f"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    reps = written(first.select(F.monotonically_increasing_id().alias("sid"), "set_hash", F.col("f.doc_id").alias("id"), "f.th", "n", "bands", "sketch"), "sets")
    found, names = _components(df, text, key, reps, size, percent, bands * rows, bits)
    of_set = reps.select("set_hash", "sid", "id").join(found.withColumnRenamed("id", "sid"), "sid", "left").join(names, "component", "left").select("set_hash", F.coalesce("name", "id").alias("name"))
    return signed.select("doc_id", "n", "set_hash").join(of_set, "set_hash", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("name", "doc_id")).alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def _components(df: DataFrame, text: str, key: str, reps: DataFrame, size: int, percent: int, k: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """id (a set's sid) and component of the sets that are linked with another, and the name of each component: its smallest doc_id."""
    small = reps.select("sid", "n", "sketch")
    # the hash of a band depends on its number, so it alone is the key of a bucket
    members = reps.select("sid", F.explode("bands").alias("bucket"))
    big = written(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > SMALL), "buckets")
    n_big = big.count()

    limit = most_bits(k, bits, percent / 100)
    near = (differing_bits(F.col("s1"), F.col("s2"), bits // 64) <= limit) & may_match(F.col("n1"), F.col("n2"), percent)
    side = lambda x, i, own: own.select(F.col("sid").alias(x), F.col("n").alias(f"n{i}"), F.col("sketch").alias(f"s{i}"))
    sketched = lambda pairs, second: pairs.join(side("a", 1, small).hint("merge"), "a").join(second, "b").where(near).select(*pairs.columns)
    compare = Compared(df, text, key, reps, size, percent)

    # small buckets in full; each has so few members that a list of them is bounded
    little = by_bucket(members, big.select("bucket"), n_big, "left_anti") if n_big else members
    pairs = sketched(pairs_of(little).withColumn("salt", F.lit(0)), side("b", 2, small).hint("merge"))
    if n_big:
        # of large ones each member with its most central neighbour
        large = written(by_bucket(members, big, n_big).withColumn("weight", F.sum("size").over(Window.partitionBy("sid"))).select("bucket", "sid", "weight"), "members")
        hubs = written(large.groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("sid")).alias("minus"))).alias("hub")), "hubs")
        star = by_bucket(large.select("bucket", "sid"), hubs, n_big).groupBy("sid").agg(F.max("hub").alias("hub")).select(F.col("sid").alias("a"), (-F.col("hub.minus")).alias("b")).where("a <> b")
        star = written(star, "star")
        spokes = written(star.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / SPOKES).cast("int").alias("parts")).join(side("b", 2, small), "b"), "spokes")
        n_hubs = spokes.count()
        if n_hubs <= BROADCAST:
            salted = star.join(F.broadcast(spokes.select("b", "parts")), "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("salt"))
            pairs = pairs.union(sketched(salted, F.broadcast(spokes.drop("parts")) if n_hubs <= BROADCAST // 8 else spokes.drop("parts").hint("merge")))
        else:
            pairs = pairs.union(sketched(star.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int")), spokes.drop("parts").hint("merge")))
    links = compare.stars(pairs)
    found = connected_components(links, "a", "b")
    drop_written(links)
    if n_big:
        found = _rest(large, n_big, found, small, compare, sketched, side)
        for table in (large, hubs, star, spokes):
            drop_written(table)
    drop_written(big)
    names = written(found.join(reps.select(F.col("sid").alias("id"), F.col("id").alias("doc")), "id").groupBy("component").agg(F.min("doc").alias("name")), "names")
    return found, names


def _rest(large: DataFrame, n_big: int, found: DataFrame, small: DataFrame, compare: Compared, sketched: Callable, side: Callable) -> DataFrame:
    """The components, with the links in large buckets that the hubs have not found."""
    sizes = small.select("sid", "n")
    of = lambda x, named: x.join(named.withColumnRenamed("id", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))

    def split_of(placed: DataFrame) -> DataFrame:
        """Buckets whose members are in several components, and the component with most members."""
        counted = placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("members"))
        return written(counted.groupBy("bucket").agg(F.count(F.lit(1)).alias("components"), F.max(F.struct("members", "component")).alias("m")).where("components > 1").select("bucket", F.col("m.component").alias("largest")), "split")

    placed = written(of(large.select("bucket", "sid"), found), "placed")
    split = split_of(placed)
    apart = written(by_bucket(placed, split, n_big).where("component <> largest"), "apart")
    drop_written(split)
    if not apart.isEmpty():
        # the members outside the largest component of a bucket with that component
        outside = apart.select(F.col("largest").alias("grp"), "sid", "component").distinct().join(sizes, "sid")
        inside = placed.select("sid", F.col("component").alias("grp"), "component").distinct().join(outside.select("grp").distinct(), "grp", "left_semi").join(sizes, "sid")
        links = compare.blocks(outside.select("grp", "sid", "n", "component"), inside.select("grp", "sid", "n", "component"))
        found = connected_components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(links), "a", "b")
        # what is still apart, among itself: buckets that keep few such members in full, others in blocks
        now = written(of(apart.select("bucket", "sid", F.col("largest").alias("id")).join(found.withColumnRenamed("component", "l"), "id", "left").withColumn("l", F.coalesce("l", "id")).drop("id"), found).where("component <> l").select("bucket", "sid", "component"), "apart")
        left = written(now.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 <> c2").select("bucket", "size"), "left")
        n_left, n_full = left.count(), left.where(F.col("size") > SMALL).count()
        if n_left:
            rest = by_bucket(now, left, n_left)
            few = sketched(pairs_of(rest.where(F.col("size") <= SMALL)).withColumn("salt", F.lit(0)), side("b", 2, small).hint("merge"))
            more = compare.stars(few)
            if n_full:
                many = rest.where(F.col("size") > SMALL).select(F.col("bucket").alias("grp"), "sid", "component").join(sizes, "sid").select("grp", "sid", "n", "component")
                more = more.union(compare.blocks(many, None))
            found = connected_components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more), "a", "b")
        drop_written(now), drop_written(left), drop_written(links)
    drop_written(placed), drop_written(apart)
    return found


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=2)
