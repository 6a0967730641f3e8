"""URL functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: scheme, authority, path, query (with ?), fragment (with #)
PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*)://)?([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def _part(c: Column, n: int) -> Column:
    return F.regexp_extract(F.trim(F.coalesce(c, F.lit(""))), PARTS, n)


def domain(c: Column) -> Column:
    """The host in lower case, without user, port and outer dots; www. stays."""
    host = F.regexp_replace(F.regexp_replace(F.lower(_part(c, 2)), r"^.*@", ""), r":\d*$", "")
    return F.regexp_replace(host, r"^\.+|\.+$", "")


def page_url(c: Column) -> Column:
    """Scheme (https by default) and host in lower case, / for an empty path, the query kept, no fragment; empty without a host."""
    scheme = F.coalesce(F.nullif(F.lower(_part(c, 1)), F.lit("")), F.lit("https"))
    return F.when(_part(c, 2) != "", F.concat(scheme, F.lit("://"), F.lower(_part(c, 2)), F.coalesce(F.nullif(_part(c, 3), F.lit("")), F.lit("/")), _part(c, 4))).otherwise("")


def url_key(c: Column) -> Column:
    """A key for comparing pages: no scheme, www., fragment or trailing /; the query kept."""
    host = F.regexp_replace(F.lower(_part(c, 2)), r"^www\.", "")
    return F.concat(host, F.regexp_replace(_part(c, 3), "/+$", ""), _part(c, 4))


def is_url(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^https?://[^\s/?#]+"), F.lit(False))


def page_urls_of(c: Column, names: tuple[str, ...] = ("urls", "pageUrls", "page_urls", "pages", "url")) -> Column:
    """page_urls() of JSON that may be an object, with the list under the first of several names that has one, or of a list of objects with an url."""
    inner = F.coalesce(*(F.get_json_object(c, f"$.{n}") for n in names))
    objects = F.transform(F.from_json(c, "array<struct<url:string>>"), lambda o: o["url"])
    listed = F.when(c.rlike(r"^\s*\[\s*\{"), F.to_json(objects)).when(c.rlike(r"^\s*\{"), inner).otherwise(c)
    return page_urls(listed)


def page_urls(c: Column) -> Column:
    """The URLs of a JSON list or a comma list, normalised, in order, each once."""
    listed = F.when(F.trim(c).startswith("["), F.from_json(c, "array<string>")).otherwise(F.split(c, r"[,\s]+"))
    return F.array_distinct(F.filter(F.transform(F.coalesce(listed, F.expr("array()").cast("array<string>")), page_url), lambda u: u != ""))


def s3_key(c: Column) -> tuple[Column, Column]:
    """Bucket and key of s3://bucket/key, https://bucket.s3.region.amazonaws.com/key and plain keys (null bucket)."""
    host = _part(c, 2)
    scheme = F.lower(_part(c, 1))
    web = scheme.isin("http", "https")
    bucket = F.when(scheme == "s3", host).when(web & host.rlike(r"\.s3[.-]"), F.regexp_extract(host, r"^(.+?)\.s3[.-]", 1)).when(web, F.regexp_extract(_part(c, 3), "^/([^/]+)/", 1))
    path = F.when(web & ~host.rlike(r"\.s3[.-]"), F.regexp_replace(_part(c, 3), "^/[^/]+/", "")).when(scheme == "", F.concat(host, _part(c, 3))).otherwise(_part(c, 3))
    return F.nullif(bucket, F.lit("")), F.try_url_decode(F.regexp_replace(path, "^/+", ""))
