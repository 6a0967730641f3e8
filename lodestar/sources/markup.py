"""Markup and JSON as text: HTML to markdown, and the leaves of extracted fields."""

from __future__ import annotations

import contextlib
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import clean_markdown
from lodestar.session import small_batches

# Elements that are left out of the markdown of a page.
SKIPPED = frozenset(("script", "style", "noscript", "nav", "footer", "header", "iframe"))
BLOCKS = frozenset("p div section article main ul ol table tr blockquote pre figure dl dt dd hr body".split())
VOID = frozenset("br hr img input link meta wbr source area base col embed param track".split())


class _Markdown(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skipped: list[str] = []
        self.links: list[str | None] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.skipped or tag in SKIPPED:
            if tag not in VOID:
                self.skipped.append(tag)
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.out.append("\n* ")
        elif tag == "br":
            self.out.append("\n")
        elif tag in BLOCKS:
            self.out.append("\n\n")
        elif tag == "a":
            self.links.append(dict(attrs).get("href"))
            self.out.append("[" if self.links[-1] else "")
        elif tag in ("b", "strong"):
            self.out.append("**")

    def handle_endtag(self, tag: str) -> None:
        if self.skipped:
            if tag in self.skipped:
                del self.skipped[len(self.skipped) - 1 - self.skipped[::-1].index(tag) :]
        elif re.fullmatch("h[1-6]", tag) or tag in BLOCKS:
            self.out.append("\n\n")
        elif tag == "a" and self.links:
            href = self.links.pop()
            self.out.append(f"]({href})" if href else "")
        elif tag in ("b", "strong"):
            self.out.append("**")

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            self.out.append(re.sub(r"\s+", " ", data))


def html_markdown(html: str | None) -> str:
    """The body as markdown: headings, lists, links and bold, without images, scripts, styles and page furniture."""
    text = html or ""
    body = re.search(r"(?is)<body\b.*", text)
    parser = _Markdown()
    parser.feed(body[0] if body else text)
    parser.close()
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]*\n[ \t]*", "\n", "".join(parser.out))).strip()


# How deep extracted fields are read, how many items of a list count, and the least text worth an index entry.
LEAF_DEPTH, LEAF_ITEMS, LEAST_TEXT = 6, 200, 200
#: An address that is a whole field: a picture or a link, no text.
ADDRESS = re.compile(r"(?:data:|https?://)\S+")


def leaf_texts(tree) -> list[str]:
    """The strings of a JSON value in reading order, trimmed, without blank ones and addresses. Walks level by level from an explicit stack."""
    found, stack = [], [(tree, 0)]
    while stack:
        node, level = stack.pop()
        match node:
            case str():
                found += [t for t in (node.strip(),) if t and not ADDRESS.fullmatch(t)]
            case dict() if level < LEAF_DEPTH:
                stack += [(v, level + 1) for v in reversed(node.values())]
            case list() if level < LEAF_DEPTH:
                stack += [(v, level + 1) for v in reversed(node[:LEAF_ITEMS])]
    return found


def schema_text(content: str | None, least: int = LEAST_TEXT) -> str:
    """The text of extracted fields, one a line; what is not JSON is text already. Empty where there is too little."""
    lines = (content or "").strip()
    with contextlib.suppress(ValueError):
        lines = "\n".join(leaf_texts(json.loads(lines)))
    return lines if len(lines) >= least else ""


def _mapped(df: DataFrame, column: str, convert) -> DataFrame:
    """df with a text column converted, in bounded Arrow batches; a plan node of its own, so that JVM expressions can follow."""
    at = df.columns.index(column)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.set_column(at, column, pa.array(map(convert, batch.column(at).to_pylist()), pa.string()))

    return small_batches(df).mapInArrow(rows, df.schema)


def html_to_markdown(df: DataFrame, column: str) -> DataFrame:
    return _mapped(df, column, html_markdown)


def schema_index_text(df: DataFrame, column: str) -> DataFrame:
    return _mapped(df, column, schema_text)


def pages_as_markdown(pages: DataFrame) -> DataFrame:
    """page_id, url and the cleaned text of crawled pages."""
    rows = html_to_markdown(pages.select("page_id", "url", F.col("html").alias("text")), "text")
    return rows.select("page_id", "url", clean_markdown(F.col("text"), ascii_footers=True).alias("text"))
