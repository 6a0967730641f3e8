"""Filters given as dicts, as Columns. One builder serves chunks (strict) and entries (loose)."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPANY_KEYS = ("company_id", "companyId", "companyid")
PARENT_KEYS = ("parent_id", "parentId", "parentid")
HIDDEN = ("disabled", "removed")
# Sources of crawls that are not indexed for other companies.
BLOCKED_SOURCES = ("blocked", "denied", "private", "disallowed", "forbidden")


def _field(key: str, company: Column) -> Column:
    if key in COMPANY_KEYS:
        return company
    if key.startswith("metadata."):
        return F.col("metadata")[key.split(".", 1)[1]]
    return F.col(key)


def matches(c: Column, value) -> Column:
    """Equality, or membership of {"$in": [...]}; a null in the value is met by a null."""
    if isinstance(value, dict) and "$in" in value:
        listed = [v for v in value["$in"] if v is not None]
        hit = F.coalesce(c.isin(listed), F.lit(False)) if listed else F.lit(False)
        return hit | c.isNull() if None in value["$in"] else hit
    return c.eqNullSafe(F.lit(value))


def chunk_filter(filters: dict | None, company: Column) -> Column:
    """All conditions together; keys are columns, `metadata.x`, or the company, which is read from both of its places."""
    out = F.lit(True)
    for key, value in (filters or {}).items():
        out = out & matches(_field(key, company), value)
    return out


def entry_filter(filters: dict | None) -> Column:
    """As for entries: the company and the parent are compared as text and never met by a null; the rest is strict equality."""
    out = F.lit(True)
    for key, value in (filters or {}).items():
        if key in COMPANY_KEYS:
            c = F.coalesce(F.col("companyId"), F.col("metadata")["companyId"])
        elif key in PARENT_KEYS:
            c = F.col("metadata")["parentId"]
        else:
            out = out & _field(key, F.col("companyId")).eqNullSafe(F.lit(value))
            continue
        out = out & F.coalesce(c.isNotNull() & (c.cast("string") == F.lit(str(value))), F.lit(False))
    return out


def route_company(filters: dict | None) -> str | None:
    """The one company that the filters name, or None: then the global partition is searched."""
    for key, value in (filters or {}).items():
        if key in COMPANY_KEYS or key in ("metadata.companyId", "metadata.company_id"):
            if isinstance(value, dict):
                value = value["$in"][0] if len(value.get("$in", ())) == 1 else None
            if value:
                return str(value)
    return None


def parse_filter(value) -> dict | None:
    """A dict, or JSON of one; an error for anything else."""
    if value is None or value == "":
        return None
    found = json.loads(value) if isinstance(value, str) else value
    if not isinstance(found, dict):
        raise ValueError("a filter must be an object")
    return found


def is_visible(status: Column) -> Column:
    """Documents that are disabled or removed are hidden; a missing document row is visible."""
    return status.isNull() | ~F.lower(status).isin(*HIDDEN)


def is_active(version: Column, active: Column) -> Column:
    """Rows of the active version; all rows where there is none."""
    return active.isNull() | (active == "") | version.eqNullSafe(active)


def with_documents(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    return chunks.join(documents.select("doc_id", "status", "active_ingest_version"), "doc_id", "left")


def visible(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks of visible documents in their active version."""
    return with_documents(chunks, documents).where(is_visible(F.col("status")) & is_active(F.col("ingest_version"), F.col("active_ingest_version"))).drop("status", "active_ingest_version")


def owned(domains: DataFrame, company: Column) -> DataFrame:
    """Domains that a company may index: its own, or one it is an owner of; all where no company is named."""
    allowed = F.array_distinct(F.filter(F.concat(F.array("companyId"), F.coalesce(F.transform("informationOwners", lambda o: o["companyId"]), F.expr("array()").cast("array<string>"))), lambda c: c.isNotNull()))
    return domains.where((F.size(allowed) == 0) | F.array_contains(allowed, company))
