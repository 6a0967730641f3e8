"""Mixing sources to target weights by min-cost flow.

Documents may belong to several sources. They are aggregated by the set of sources they belong to (their pattern). A pattern can give its
words once at no cost, a second time at cost 1 and a third time at cost 2, to any of its sources; a source takes words up to its
target. The min-cost flow of that small network says how often each pattern is repeated. Documents are then chosen in the order of a
seeded hash: all of a pattern's for each whole repetition, and the first ones of that order for the rest.

Only sums by pattern reach the driver, and where there are more patterns than it should hold, only those that overlap with others: a source that shares
no document is a network of its own, whose flow is the smaller of its target and of what it has. The order is never made for a whole pattern: hashes
fall into about sqrt(n) buckets, and only the one bucket in which a pattern's rest ends is put in order.
"""

from __future__ import annotations

import math
from collections import defaultdict
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestar.llm.common import words_in, written
from lodestar.operators.lifecycle import reserve_ids

WEIGHTS = (5, 2, 1)
REPEATS = 3
#: Patterns that the driver solves the network of. Beyond, those that overlap with no other are solved where they are.
DRIVER_PATTERNS = 100_000
#: Copies of a row of the plan where it is too large to broadcast, so that a source's documents lie in as many tasks.
SALTS = 32


def targets_of(sizes: list[int], weights: list[int], repeats: int) -> list[float]:
    """Shares of the total by weight. None exceeds `repeats` times its size; what is above is shared again among the others by weight."""
    order = sorted(range(len(sizes)), key=lambda i: (Fraction(repeats * sizes[i], weights[i]), i))
    left, weight, out = sum(sizes), sum(weights), [0.0] * len(sizes)
    for k, i in enumerate(order):
        share = left / weight
        if repeats * sizes[i] > share * weights[i]:
            for j in order[k:]:
                out[j] = share * weights[j]
            break
        out[i] = float(repeats * sizes[i])
        left -= repeats * sizes[i]
        weight -= weights[i]
    return out


def min_cost_flow(supply: list[int], members: list[list[int]], quota: list[int], repeats: int) -> list[int]:
    """Words that each pattern gives: a flow of most words, and of those one of least repetition cost.

    Pattern p has supply[p] words in each of `repeats` copies, copy c at cost c a word, for the sources members[p]. All first copies are routed before any second one, and
    so on: a pattern from which no path leads to a source with room has none later either, so that a flow that is largest copy by copy is the cheapest of the
    largest ones. Of each copy the flow is made by blocking flows over shortest paths, on which steps back undo flow between patterns.
    """
    of_source: dict[int, list[int]] = defaultdict(list)
    for p, own in enumerate(members):
        for s in own:
            of_source[s].append(p)
    given, room = [0] * len(supply), list(quota)
    flow: dict[tuple[int, int], int] = defaultdict(int)
    for _ in range(repeats):
        left = list(supply)
        while _blocking_flow(left, given, members, of_source, flow, room):
            pass
    return given


def _blocking_flow(left: list[int], given: list[int], members: list[list[int]], of_source: dict[int, list[int]], flow: dict[tuple[int, int], int], room: list[int]) -> bool:
    """Routes what is left of patterns along paths as short as the shortest there is, until none of these is open; says whether it routed anything."""
    level: dict[tuple[bool, int], int] = {(True, p): 0 for p, n in enumerate(left) if n > 0}
    queue, end = list(level), None
    for node in queue:
        pattern, i = node
        if end is not None and level[node] >= end:
            break
        for nxt in [(False, s) for s in members[i]] if pattern else [(True, q) for q in of_source[i] if flow[q, i] > 0]:
            if nxt not in level:
                level[nxt] = level[node] + 1
                queue.append(nxt)
                if pattern and room[nxt[1]] > 0 and end is None:
                    end = level[nxt]
    if end is None:
        return False
    tried: dict[tuple[bool, int], int] = defaultdict(int)  # arcs of a node that lead nowhere any more
    for first in [i for pattern, i in level if pattern and level[pattern, i] == 0]:
        path = [(True, first)]
        while left[first] > 0 and path:
            pattern, i = path[-1]
            if not pattern and room[i] > 0:
                back = [(q, s) for (_, s), (_, q) in zip(path[1::2], path[2::2], strict=False)]
                most = min(left[first], room[i], *(flow[x] for x in back))
                for (_, p), (_, s) in zip(path[::2], path[1::2], strict=True):
                    flow[p, s] += most
                for x in back:
                    flow[x] -= most
                left[first] -= most
                given[first] += most
                room[i] -= most
                path = path[:1]
                continue
            arcs = members[i] if pattern else of_source[i]
            while tried[path[-1]] < len(arcs):
                j = arcs[tried[path[-1]]]
                if level.get((not pattern, j)) == level[path[-1]] + 1 and level[path[-1]] < end and (pattern or flow[j, i] > 0):
                    path.append((not pattern, j))
                    break
                tried[path[-1]] += 1
            else:
                path.pop()
                if path:
                    tried[path[-1]] += 1
    return True


def mix(df: DataFrame, sources: Column, text: str = "text", key: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, seed: int = 42) -> DataFrame:
    """One row per input row: doc_id, size (words; 0 for null), sources, source_size, target and taken (words the mix takes, repeats counted).

    `sources` is a string (one source) or an array of strings (several); null is a source of its own. Sources in the order of their
    code points, null last, weigh `weights`, repeating. source_size and target are those of the source, of several the sums. Within
    a pattern documents are taken in the order of (md5 of seed and id, id, size), rows that are equal in all of these being alike in the result; the
    last of them may be taken in part, so that a pattern gives exactly the words of the flow. A document without a source (an empty array) is not taken. Empty texts take nothing; rows that
    repeat an id are taken each; a null id is an id. An empty table gives an empty result.
    """
    many = isinstance(df.select(sources).schema[0].dataType, T.ArrayType)
    own = F.array_sort(F.array_distinct(F.coalesce(sources, F.expr("array()")))) if many else F.array(sources.cast("string"))
    name = F.array_join(F.transform(own, lambda s: F.coalesce(F.concat(F.length(s).cast("string"), F.lit(":"), s), F.lit("n"))), ",")
    order = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long")
    sized = written(df.select(F.col(key).alias("doc_id"), words_in(text).alias("size"), own.alias("sources"), name.alias("pattern"), order.alias("order")), "sized")

    patterns = written(sized.groupBy("pattern").agg(F.first("sources").alias("sources"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")), "patterns")
    n_patterns, largest = patterns.agg(F.count(F.lit(1)), F.max("n")).first()
    few = n_patterns <= DRIVER_PATTERNS
    plan = _plan_on_driver(patterns, weights, repeats) if few else _plan_by_tables(patterns, weights, repeats)

    # the bucket in which each pattern's rest ends
    buckets = 1 << max(4, math.ceil(math.log2(max(1, largest or 1)) / 2))
    bucket = F.floor(F.col("order") / ((1 << 32) // buckets))
    before = F.sum("words").over(Window.partitionBy("pattern").orderBy("bucket")) - F.col("words")
    sums = sized.groupBy("pattern", bucket.alias("bucket")).agg(F.sum("size").alias("words")).withColumn("before", before)
    ends = sums.join(F.broadcast(plan) if few else plan, "pattern").where("before < rest and before + words >= rest").groupBy("pattern").agg(F.min(F.struct("bucket", "before")).alias("e")).select("pattern", "e.*")
    plan = written(plan.join(ends, "pattern", "left").select("pattern", "copies", "rest", "source_size", "target", F.coalesce("bucket", F.lit(-1)).alias("last"), F.coalesce("before", F.lit(0)).alias("before")), "plan")
    if few:
        placed = sized.join(F.broadcast(plan), "pattern")
    else:
        salted = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        placed = sized.withColumn("salt", F.pmod(F.xxhash64("order", "doc_id"), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), ["pattern", "salt"])
    placed = placed.withColumn("bucket", bucket)
    columns = lambda taken: ("doc_id", "size", "sources", "source_size", "target", (F.col("copies") * F.col("size") + taken).alias("taken"))
    through = F.sum("size").over(Window.partitionBy("pattern").orderBy("order", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, 0))
    whole = placed.where("bucket <> last").select(*columns(F.when(F.col("bucket") < F.col("last"), F.col("size")).otherwise(0)))
    partly = placed.where("bucket = last").withColumn("left", F.col("rest") - F.col("before") - (through - F.col("size"))).select(*columns(F.greatest(F.lit(0), F.least("size", "left"))))
    return whole.unionByName(partly)


PLAN = "pattern string, copies long, rest long, source_size long, target double"


def _row(pattern: str, size: int, given: int, source_size: int, target: float) -> tuple:
    return (pattern, given // size if size else 0, given % size if size else 0, source_size, float(target))


def _plan_on_driver(patterns: DataFrame, weights: tuple[int, ...], repeats: int) -> DataFrame:
    """PLAN: how often each pattern is taken whole, how many words of it are taken once more, and its source's size and target."""
    totals = sorted(patterns.collect(), key=lambda r: r.pattern)
    names = sorted({s for r in totals for s in r.sources}, key=lambda s: (s is None, s or ""))
    at = {s: i for i, s in enumerate(names)}
    sizes = [0] * len(names)
    for r in totals:
        for s in r.sources:
            sizes[at[s]] += r.size
    everything = sum(r.size for r in totals if r.sources)
    own = [weights[i % len(weights)] for i in range(len(names))]
    targets = targets_of(sizes, own, repeats) if sum(sizes) == everything else _overlapping(sizes, weights, repeats, everything)
    given = min_cost_flow([r.size for r in totals], [[at[s] for s in r.sources] for r in totals], [math.floor(t) for t in targets], repeats)
    rows = [_row(r.pattern, r.size, g, sum(sizes[at[s]] for s in r.sources), sum(targets[at[s]] for s in r.sources)) for r, g in zip(totals, given, strict=True)]
    return patterns.sparkSession.createDataFrame(rows, PLAN)


def _plan_by_tables(patterns: DataFrame, weights: tuple[int, ...], repeats: int) -> DataFrame:
    """The same for more patterns than the driver should hold. Sources are ranked by ranges, their shares found by sums over those that stop at their most, and
    patterns that share no source are given what the flow of one pattern gives. Those that overlap must be few enough for the driver."""
    named = patterns.select(F.explode("sources").alias("source"), "size").groupBy("source").agg(F.sum("size").alias("size"))
    ranked = reserve_ids(named, [F.col("source").isNull(), F.col("source")], 0)
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (1 + (F.col("id") - 1) % len(weights)).cast("int"))
    sources = written(ranked.select("source", "size", weight.alias("weight")), "sources")
    everything = patterns.where(F.size("sources") > 0).agg(F.sum("size")).first()[0] or 0
    together, all_weights = sources.agg(F.sum("size"), F.sum("weight")).first()
    share, stopped = together / all_weights, -1
    while True:
        full = F.col("size") * repeats <= F.lit(share) * F.col("weight")
        n, words, weighed = sources.where(full).agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if n == stopped or weighed == all_weights:
            break
        stopped, share = n, (together - repeats * words) / (all_weights - weighed)
    target = F.least(F.lit(share) * F.col("weight"), (F.col("size") * repeats).cast("double")) * F.lit(everything / together if together else 1.0)
    sources = written(sources.select("source", "size", target.alias("target")), "targets")
    overlapping = patterns.where(F.size("sources") > 1)
    shared = written(overlapping.select(F.explode("sources").alias("source")).distinct(), "shared")
    if overlapping.count() + shared.count() > DRIVER_PATTERNS:
        raise ValueError(f"more than {DRIVER_PATTERNS} patterns and sources that overlap")
    single = patterns.where(F.size("sources") == 1).withColumn("source", F.get("sources", F.lit(0)))
    same = lambda x, y: x["source"].eqNullSafe(y["source"])
    alone = single.join(F.broadcast(shared), same(single, shared), "left_anti")
    of = sources.withColumnRenamed("size", "source_size").withColumnRenamed("source", "name")
    given = F.least(F.col("size") * repeats, F.floor("target"))
    has = F.col("size") > 0
    out = alone.join(of, alone["source"].eqNullSafe(of["name"])).select(
        "pattern", F.when(has, F.floor(given / F.col("size"))).otherwise(0).cast("long").alias("copies"), F.when(has, given % F.col("size")).otherwise(0).cast("long").alias("rest"), "source_size", "target"
    )
    nothing = patterns.where(F.size("sources") == 0).select("pattern", F.lit(0).cast("long").alias("copies"), F.lit(0).cast("long").alias("rest"), F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"))
    network = sorted(overlapping.unionByName(single.join(F.broadcast(shared), same(single, shared), "left_semi").drop("source")).collect(), key=lambda r: r.pattern)
    known = sources.join(F.broadcast(shared), same(sources, shared), "left_semi").collect()
    at = {r.source: i for i, r in enumerate(known)}
    solved = min_cost_flow([r.size for r in network], [[at[s] for s in r.sources] for r in network], [math.floor(r.target) for r in known], repeats)
    rows = [_row(r.pattern, r.size, g, sum(known[at[s]].size for s in r.sources), sum(known[at[s]].target for s in r.sources)) for r, g in zip(network, solved, strict=True)]
    return written(out.unionByName(nothing).unionByName(patterns.sparkSession.createDataFrame(rows, PLAN)), "plan")


def _overlapping(sizes: list[int], weights: tuple[int, ...], repeats: int, everything: int) -> list[float]:
    """Targets that share the words of all documents, counted once, though sources overlap."""
    scaled = targets_of(sizes, [weights[i % len(weights)] for i in range(len(sizes))], repeats)
    return [t * everything / sum(sizes) for t in scaled]


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), F.col("source")).drop("sources")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w,
         row_number() OVER (ORDER BY source NULLS LAST) AS n
  FROM d GROUP BY source),
r AS (
  SELECT *, ((SELECT sum(size) FROM d) - coalesce(sum(3 * source_size) OVER o, 0))::DOUBLE / (sum(w) OVER f)::DOUBLE AS share,
         row_number() OVER (ORDER BY 3 * source_size / w::DOUBLE, n) AS k
  FROM s WINDOW o AS (ORDER BY 3 * source_size / w::DOUBLE, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                f AS (ORDER BY 3 * source_size / w::DOUBLE, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
cut AS (SELECT min(k) AS k, arg_min(share, k) AS share FROM r WHERE 3 * source_size > share * w),
t AS (SELECT source, source_size, CASE WHEN r.k >= cut.k THEN cut.share * w ELSE (3 * source_size)::DOUBLE END AS target FROM r, cut),
g AS (SELECT *, least(floor(target)::BIGINT, 3 * source_size) AS given FROM t),
p AS (SELECT *, CASE WHEN source_size > 0 THEN given // source_size ELSE 0 END AS copies, CASE WHEN source_size > 0 THEN given % source_size ELSE 0 END AS rest FROM g)
SELECT d.doc_id, d.size, p.source_size, p.target,
       (p.copies * d.size + greatest(0, least(d.size, p.rest - (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) - d.size))))::BIGINT AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
"""
