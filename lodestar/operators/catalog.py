"""Categories and attributes: paths up a tree, attributes along a path, counts, pages of a list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.session import checkpointed


def paths(entries: DataFrame) -> DataFrame:
    """id, parent_id, text and the ids and texts from the root down to each entry. A missing parent, or one already on the path, ends it.

    By doubling: in each step the path of an entry is put below that of the entry above its top, which is as long, so that the steps are the logarithm of the depth. Each step is
    computed once; entries whose path is whole take no part in later steps but as what others are put below.
    """
    nodes = entries.select("id", "parent_id", "text")
    known = nodes.select(F.col("id").alias("up")).distinct()
    first = nodes.join(known, nodes["parent_id"] == known["up"], "left")
    level = first.select("id", "parent_id", "text", F.array("id").alias("ids"), F.array("text").alias("texts"), F.when(F.col("up") != F.col("id"), F.col("up")).alias("next"))
    done = None
    while True:
        level = checkpointed(level)
        closed = level.where("next is null")
        done = closed if done is None else done.unionByName(closed)
        level = level.where("next is not null")
        if level.isEmpty():
            return done.select("id", "parent_id", "text", "ids", "texts")
        above = done.unionByName(level).select(F.col("id").alias("up"), F.col("ids").alias("up_ids"), F.col("texts").alias("up_texts"), F.col("next").alias("above")).dropDuplicates(["up"])
        # where both hold one entry the tree has a cycle: the path ends below it
        meets = F.arrays_overlap("ids", "up_ids")
        after = F.when(meets, F.array_max(F.transform("up_ids", lambda x, i: F.when(F.array_contains("ids", x), i + 1).otherwise(0)))).otherwise(0)
        rest = lambda c: F.slice(c, F.col("_after") + 1, F.size(c) - F.col("_after"))
        joined = level.join(above, level["next"] == above["up"]).withColumn("_after", after)
        level = joined.select("id", "parent_id", "text", F.concat(rest("up_ids"), "ids").alias("ids"), F.concat(rest("up_texts"), "texts").alias("texts"), F.when(F.col("_after") == 0, F.col("above")).alias("next"))


def attributes_along(paths_: DataFrame, attributes: DataFrame) -> DataFrame:
    """The attributes of each category and of all above it, each code once: the nearest level's, then the smallest id."""
    levels = paths_.select("id", F.posexplode("ids").alias("level", "category_id"))
    found = levels.join(attributes.withColumnRenamed("id", "attribute_id"), "category_id")
    w = Window.partitionBy("id", "code").orderBy(F.desc("level"), "attribute_id")
    return found.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "level")


def stats(entries: DataFrame, kind: Column, status: Column, company: Column | None = None, featured: Column | None = None, public: Column | None = None, system: Column | None = None) -> DataFrame:
    """group, name and count: totals, roots and children, counts by type and status, and where they are given by company, and of what is featured, public and made by the
    system. The three standard types are always listed. One pass: each row adds to a cell of each group."""
    lowered = lambda c, default: F.coalesce(F.nullif(F.lower(F.trim(c)), F.lit("")), F.lit(default))
    groups = [
        ("total", F.lit("all")),
        ("hierarchy", F.when(F.coalesce(F.trim("parent_id"), F.lit("")) == "", "root").otherwise("child")),
        ("type", lowered(kind, "general")),
        ("status", lowered(status, "unknown")),
    ]
    if company is not None:
        groups.append(("company", F.nullif(F.trim(company), F.lit(""))))
    for name, flag, yes, no in (("featured", featured, "featured", None), ("visibility", public, "public", "private"), ("system", system, "system", "user")):
        if flag is not None:
            groups.append((name, F.when(flag, yes).otherwise(no)))
    cells = F.array(*(F.struct(F.lit(g).alias("group"), c.alias("name")) for g, c in groups))
    counted = entries.select(F.explode(cells).alias("c")).select("c.*", F.lit(1).alias("one")).where("name is not null")
    always = entries.sparkSession.createDataFrame([("type", t, 0) for t in ("product", "service", "general")], "group string, name string, one int")
    return counted.unionByName(always).groupBy("group", "name").agg(F.sum("one").alias("count"))


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> tuple[int, DataFrame]:
    """The total before paging, and one page in order."""
    return df.count(), df.orderBy(*order).offset(offset).limit(limit)


def first_by_external_id(entries: DataFrame) -> DataFrame:
    """The entry of the smallest id for each external id."""
    return entries.groupBy("external_id").agg(F.min_by(F.struct(*[c for c in entries.columns if c != "external_id"]), "id").alias("e")).select("external_id", "e.*")
