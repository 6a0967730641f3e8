"""Lines and pictures that go with crawled pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINES_CHARS = 2000


def first_text(*columns: Column) -> Column:
    """The first that is not blank."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in columns))


def preview_image(og: Column, images: Column) -> Column:
    """og:image, its secure and plain url, then the first image that has a source. `og` is a map, `images` an array of structs with src."""
    listed = F.filter(images, lambda i: F.trim(i["src"]) != "")
    return first_text(og["og:image"], og["og:image:secure_url"], og["og:image:url"], F.when(F.size(listed) > 0, listed[0]["src"]))


def media_line(kind: Column, src: Column, alt: Column, title: Column, caption: Column) -> Column:
    return F.concat_ws(" | ", *(F.nullif(F.trim(c), F.lit("")) for c in (kind, title, alt, caption, src)))


def with_media(text: Column, media: Column) -> Column:
    return F.when(F.coalesce(media, F.lit("")) == "", text).otherwise(F.concat(F.coalesce(text, F.lit("")), F.lit("\n\n[media]\n"), media))


def lines_within(lines: Column, most: int | Column = LINES_CHARS) -> Column:
    """The first lines, joined, that together have at most `most` characters with their line breaks; the first that exceeds it ends the text."""
    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("full"))
    step = lambda acc, line: F.when(acc["full"] | (F.length(acc["text"]) + F.length(line) + F.when(acc["text"] == "", 0).otherwise(1) > most), F.struct(acc["text"].alias("text"), F.lit(True).alias("full"))).otherwise(
        F.struct(F.when(acc["text"] == "", line).otherwise(F.concat(acc["text"], F.lit("\n"), line)).alias("text"), F.lit(False).alias("full"))
    )
    return F.aggregate(lines, start, step, lambda acc: acc["text"])


def page_block(url: Column, title: Column, text: Column) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("[url] "), url), F.when(F.trim(title) != "", F.concat(F.lit("[title] "), title)), text)


def page_text(schema_text: Column, clean: Column, markdown: Column, html: Column, s3: Column, disk: Column, preferences: Column) -> Column:
    """Extracted fields first, then the stores in the order of preference (db: clean, markdown, html), then the database."""
    database = first_text(clean, markdown, html)
    by_store = lambda p: F.when(p == "db", database).when(p == "s3", first_text(s3)).when(p == "disk", first_text(disk))
    preferred = F.filter(F.transform(preferences, by_store), lambda x: x.isNotNull())
    return F.coalesce(first_text(schema_text), F.when(F.size(preferred) > 0, preferred[0]), database)
