"""Entries of a vector store: ids, upserts, look-ups, and the rows that categories and attributes are shown as.

entries(id long, external_id string, text string, company_id string, metadata map<string,string>, embedding array<float>).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.functions.text import display_text, resolve_id, slug
from lodestar.operators.dense import checked_dimension, normalized
from lodestar.operators.lifecycle import reserve_ids

COMPANY_KEYS = ("companyId", "company_id", "companyid")


def given(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def shown(c: Column, *fallbacks: Column) -> Column:
    """A text as it is displayed, or the first fallback where nothing is to be displayed."""
    return F.coalesce(F.nullif(display_text(c), F.lit("")), *fallbacks)


# ---- changes


def add_vectors(vectors: DataFrame, new: DataFrame) -> DataFrame:
    """Vectors with new ones, normalised. An error where dimensions differ, and where an id is new twice or there already."""
    dimension, there = checked_dimension(new), checked_dimension(vectors)
    if dimension != there and None not in (dimension, there):
        raise ValueError(f"new vectors have {dimension} dimensions, the others {there}")
    twice = new.groupBy("faiss_id").count().where("count > 1").select("faiss_id").union(new.select("faiss_id").join(vectors.select("faiss_id"), "faiss_id", "left_semi"))
    if not twice.isEmpty():
        raise ValueError("ids must be new")
    return vectors.unionByName(new.withColumn("embedding", normalized(F.col("embedding"))), allowMissingColumns=True)


def replace_vectors(vectors: DataFrame, old_ids: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vectors with old ids gone and new vectors in their place, and a row with the number of ids that were asked to go."""
    kept = vectors.join(old_ids.select("faiss_id").distinct(), "faiss_id", "left_anti")
    return add_vectors(kept, new), old_ids.agg(F.count("faiss_id").alias("requested"))


def identified(entries: DataFrame, new: DataFrame, order: list[Column]) -> DataFrame:
    """New rows(int_id string, ...) with the id that each gets: digits are the id, other text is hashed, and rows without one follow the largest
    id, in order. `alias` is the text that was hashed."""
    known = new.withColumn("id", resolve_id(F.col("int_id"))).withColumn("alias", F.when(~F.trim("int_id").rlike(r"^[+-]?\d+$"), F.nullif(F.trim("int_id"), F.lit(""))))
    top = known.select("id").union(entries.select("id")).agg(F.max(F.when(F.col("id") < (1 << 62), F.col("id")))).first()[0] or 0
    numbered = reserve_ids(known.where("id is null").drop("id"), order, top)
    return known.where("id is not null").unionByName(numbered)


def upsert_entries(entries: DataFrame, new: DataFrame, order: list[Column]) -> DataFrame:
    """Entries after new rows(int_id, external_id, text, company_id, metadata, embedding): the last of an id in `order` counts.

    Its metadata replaces the old without the keys of the company, which is the metadata's first, then the row's, then the old one's. Text and external id
    fall back to the old ones, the external id to the text that made the id, and where there is none to the id itself. Rows need a text or a vector.
    """
    if not new.where("embedding is null and coalesce(trim(text), '') = ''").isEmpty():
        raise ValueError("a row needs a text or a vector")
    last = identified(entries, new, order).withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(*(c.desc() for c in order)))).where("_n = 1")
    both = entries.alias("o").join(last.alias("n"), "id", "full_outer")
    named = F.coalesce(*(F.col("n.metadata")[k] for k in COMPANY_KEYS), F.col("n.company_id"), F.col("o.company_id"))
    fresh = F.col("n._n").isNotNull()
    pick = lambda new_value, name: F.when(fresh, new_value).otherwise(F.col(f"o.{name}")).alias(name)
    return both.select(
        "id",
        pick(F.coalesce(given(F.col("n.external_id"), F.col("n.alias"), F.col("o.external_id")), F.col("id").cast("string")), "external_id"),
        pick(given(F.col("n.text"), F.col("o.text")), "text"),
        pick(named, "company_id"),
        pick(F.map_filter("n.metadata", lambda k, v: ~k.isin(*COMPANY_KEYS)), "metadata"),
        pick(F.coalesce(normalized(F.col("n.embedding")), F.col("o.embedding")), "embedding"),
    )


# ---- look-ups


def slug_of(entries_slug: Column, text: Column) -> Column:
    """The slug of an entry: its own, or that of its text."""
    return given(slug(entries_slug), slug(text))


def ids_for(entries: DataFrame, identifiers: DataFrame, external: bool = False, slugs: bool = True) -> DataFrame:
    """identifier, id and kind (id, external_id or slug) of all that identifiers(identifier) stand for.

    Digits are an id as it is, unless `external`; anything else is an external id, and where none has it, a slug.
    """
    asked = identifiers.select(F.trim("identifier").alias("identifier")).where("identifier <> ''").distinct()
    number = F.col("identifier").rlike(r"^\d+$") & F.lit(not external)
    by_id = asked.where(number).select("identifier", F.col("identifier").cast("long").alias("id"), F.lit("id").alias("kind"))
    names = asked.where(~number)
    by_external = names.join(entries.select(F.col("external_id").alias("identifier"), "id"), "identifier").withColumn("kind", F.lit("external_id"))
    out = by_id.unionByName(by_external)
    if slugs:
        rest = names.join(by_external.select("identifier").distinct(), "identifier", "left_anti").withColumn("slug", slug(F.col("identifier")))
        own = entries.select("id", slug_of(F.col("metadata")["slug"], F.col("text")).alias("slug"))
        out = out.unionByName(rest.join(own, "slug").select("identifier", "id", F.lit("slug").alias("kind")))
    return out


#: Other names of what an entry is filtered by.
ALIASES = {"externalId": "external_id", "companyId": "company_id", "companyid": "company_id", "parentId": "parent_id", "parentid": "parent_id"}


def _condition(key: str, value) -> Column:
    scope, _, name = key.rpartition(".")
    name, want, m = ALIASES.get(name, name), str(value), F.col("metadata")
    places = {"external_id": F.col("external_id"), "company_id": F.col("company_id"), "parent_id": m["parentId"]}
    if scope == "metadata":
        inner = {"company_id": given(F.col("company_id"), *(m[k] for k in COMPANY_KEYS)), "parent_id": m["parentId"]}
        return F.coalesce(inner.get(name, m[name]), F.lit("None")) == want
    if name in places:
        return F.trim(F.coalesce(places[name], F.lit(""))) == want.strip()
    if name == "slug":
        return F.coalesce(slug_of(m["slug"], F.col("text")), F.lit("")) == slug(F.lit(want))
    found = F.coalesce(F.col(name).cast("string"), m[name]) if name in ("id", "text") else m[name]
    return F.coalesce(found == want, F.lit(not want.strip()))


def category_filter(filters: dict | None) -> Column:
    """As categories are filtered: every comparison is one of texts. Names that an entry has of its own are looked up there and trimmed, `slug` is normalised, `metadata.x` is
    the metadata's, where what is missing reads None; any other name is the metadata's too, and a blank value is met by what is missing."""
    out = F.lit(True)
    for key, value in (filters or {}).items():
        out = out & _condition(key, value)
    return out


def with_metadata(hits: DataFrame, stored: DataFrame, held: DataFrame) -> DataFrame:
    """Hits(id, ...) with the metadata(id, external_id, text, company_id) that is stored, or where there is none that which is held beside the vectors; hits without any are
    left out."""
    pick = lambda c: F.coalesce(F.col(f"s.{c}"), F.when(F.col("s.id").isNull(), F.col(f"m.{c}"))).alias(c)
    both = hits.alias("h").join(stored.alias("s"), F.col("h.id") == F.col("s.id"), "left").join(held.alias("m"), F.col("h.id") == F.col("m.id"), "left")
    return both.where("s.id is not null or m.id is not null").select("h.*", *(pick(c) for c in ("external_id", "text", "company_id")))


def created(entries: DataFrame, new: DataFrame) -> DataFrame:
    """New(company_id, text, n) categories with `error` and `existing`: a text that its company has already, exactly, or that an earlier new row of the company has, is a duplicate.
    A row without a company is compared with all."""
    there = entries.where("text is not null").select(F.col("company_id").alias("c"), F.col("text").alias("t"), F.col("external_id").alias("e"), "id")
    own = there.groupBy("c", "t").agg(F.min_by("e", "id").alias("own"))
    any_ = there.groupBy("t").agg(F.min_by("e", "id").alias("any"))
    first = F.row_number().over(Window.partitionBy("company_id", "text").orderBy("n")) == 1
    rows = new.withColumn("_first", first).alias("n").join(own, (F.col("n.company_id") == F.col("c")) & (F.col("n.text") == F.col("t")), "left").drop("c", "t").join(any_, F.col("n.text") == F.col("t"), "left").drop("t")
    existing = F.when(F.col("company_id").isNull(), F.col("any")).otherwise(F.col("own"))
    return rows.select("company_id", "text", "n", existing.alias("existing"), F.when(existing.isNotNull() | ~F.col("_first"), "duplicate_entry").alias("error"))


# ---- rows to show


def serialised(df: DataFrame) -> DataFrame:
    """Rows as they are answered: without internal ids, times as ISO text."""
    iso = lambda f: F.date_format(f.name, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(f.name)
    return df.select(*(iso(f) if f.dataType.typeName().startswith("timestamp") else F.col(f.name) for f in df.schema if f.name != "_id"))


def category_rows(entries: DataFrame) -> DataFrame:
    """id, category_id (the external id), text, name, label, slug, company_id and description of each category."""
    m = F.col("metadata")
    fallback = F.nullif(F.trim(F.coalesce("external_id", F.lit(""))), F.lit(""))
    named = entries.withColumn("_text", shown(given(F.col("text"), m["text"], m["name"], m["label"]), fallback)).withColumn("_name", shown(given(m["name"], m["label"], F.col("_text")), F.col("_text")))
    return named.select(
        "id", F.col("external_id").alias("category_id"), F.col("_text").alias("text"), F.col("_name").alias("name"), shown(m["label"], F.col("_name")).alias("label"),
        F.coalesce(slug_of(m["slug"], F.col("text")), F.nullif(slug(fallback), F.lit(""))).alias("slug"), "company_id", m["description"].alias("description"),
    )


def attribute_rows(attributes: DataFrame, categories: DataFrame) -> DataFrame:
    """id, attribute_id, text, name, label, category_id, category_name and category_slug of each attribute; of several categories with the external id that it
    names, that of the smallest id is meant. What the attribute says itself comes first."""
    m = F.col("metadata")
    rows = category_rows(categories)
    meant = rows.groupBy(F.col("category_id")).agg(F.min_by(F.struct("name", "text", "slug"), "id").alias("c"))
    own = attributes.withColumn("category_id", given(m["categoryId"], m["category_id"], m["category"])).withColumn("name", given(m["name"], m["label"], F.col("text")))
    return own.join(meant, "category_id", "left").select(
        "id", F.col("external_id").alias("attribute_id"), "text", "name", given(m["label"], F.col("name")).alias("label"), "category_id",
        given(m["categoryName"], m["category_name"], F.col("c.name"), F.col("c.text")).alias("category_name"), given(m["categorySlug"], m["category_slug"], F.col("c.slug")).alias("category_slug"),
    )


def upserted_rows(results: DataFrame, entries: DataFrame) -> DataFrame:
    """What an upsert answers for results(id, external_id): the category's row, or where the entry is not there its external id alone."""
    rows = category_rows(entries).select("id", F.col("category_id").alias("own"), "text", "name")
    return results.join(rows, "id", "left").select("id", F.coalesce("own", "external_id").alias("category_id"), "text", "name")


def category_payload(df: DataFrame) -> DataFrame:
    """Rows to be stored from payloads(text, name, title, label, slug, parent, company_id, metadata): names fall back to one another, the slug to the text, and the
    metadata holds label, slug, parentId and description. `error` says what is wrong with a payload without a text."""
    m = F.col("metadata")
    text = display_text(given(F.col("text"), F.col("name"), F.col("title"), F.col("label"), m["label"], m["name"], m["text"]))
    rows = df.withColumn("_text", F.nullif(text, F.lit(""))).withColumn("_name", shown(F.col("name"), F.col("_text")))
    made = F.map_from_entries(F.array(
        F.struct(F.lit("label"), shown(given(F.col("label"), m["label"]), F.col("_name"))),
        F.struct(F.lit("slug"), F.nullif(slug(given(F.col("slug"), m["slug"], F.col("_text"))), F.lit(""))),
        F.struct(F.lit("parentId"), F.coalesce(given(F.col("parent")), m["parentId"])),
        F.struct(F.lit("description"), F.nullif(display_text(m["description"]), F.lit(""))),
    ))
    rest = F.map_filter(F.coalesce(m, F.expr("cast(map() as map<string,string>)")), lambda k, v: ~k.isin(*COMPANY_KEYS, "label", "slug", "parentId", "description"))
    return rows.select(
        *(c for c in df.columns if c not in ("text", "name", "title", "label", "slug", "parent", "metadata")),
        F.col("_text").alias("text"), F.col("_name").alias("name"), shown(F.col("title"), F.col("_name")).alias("title"),
        F.map_concat(rest, F.map_filter(made, lambda k, v: v.isNotNull())).alias("metadata"), F.when(F.col("_text").isNull(), "category text must be a non-empty string").alias("error"),
    )
