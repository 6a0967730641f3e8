"""Connected components of a link table, by joins and by what each partition knows of its own links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import drop_written, small_batches, written

#: Links that a partition puts together at a time.
LOCAL_LINKS = 1 << 19


def local_forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each id that some links name, but for the smallest of each component, and that smallest id."""
    nodes, place = np.unique(np.r_[u, v], return_inverse=True)
    root = np.arange(len(nodes))
    a, b = place[: len(u)], place[len(u) :]
    while True:
        high, low = np.maximum(root[a], root[b]), np.minimum(root[a], root[b])
        if (high == low).all():
            break
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    below = root != np.arange(len(nodes))
    return nodes[below], nodes[root[below]]


def _forests(edges: DataFrame) -> DataFrame:
    """Fewer links (u, v) with the same components: those of each partition, LOCAL_LINKS at a time, become stars around their smallest ids."""

    def rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def stars() -> pa.RecordBatch:
            u, v = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in local_forest(u, v)], ["u", "v"])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= LOCAL_LINKS:
                yield stars()
                held, n = [], 0
        if held:
            yield stars()

    return small_batches(edges).select("u", "v").mapInArrow(rooted, "u long, v long")


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """id and component (the smallest id reachable) for every id that a link names. Ids are longs; links with a null are no links.

    Alternating star contraction: each id u sends its larger neighbours to the smallest id next to it, then its smaller ones. Both keep
    components whole, and repeating them leaves stars around the smallest ids after about log n rounds, or fewer, since each partition first
    contracts what it has. Links never reach the driver, only a count and a checksum of each round do. An empty table gives an empty result;
    links of an id with itself and repeated links do no harm.
    """
    edges = written(_forests(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"`{a}` is not null and `{b}` is not null and u <> v")), "edges")
    before = None
    while (now := tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())) != before and now[0]:
        before = now
        # large star: neighbours of u that are larger than u, to the smallest of u and its neighbours
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours of u, and u itself, to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = written(_forests(small).distinct(), "edges")
        drop_written(edges)
        edges = after
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
