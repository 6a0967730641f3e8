"""Texts of files: plain, HTML, PDF, DOCX, XLSX and PPTX. Legacy DOC needs a parser that is not here and is an error."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodestar.sources.pdf import pdf_text

PLAIN = (".txt", ".md", ".markdown", ".csv", ".json", ".log")


class _Texts(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []

    def handle_data(self, data: str) -> None:
        if data.strip():
            self.found.append(data.strip())


def html_text(data: bytes) -> str:
    """Text nodes, one a line."""
    parser = _Texts()
    parser.feed(data.decode("utf-8", "replace"))
    parser.close()
    return "\n".join(parser.found)


def _local(node) -> str:
    return node.tag.rpartition("}")[2]


def _runs(node, tag: str) -> str:
    return "".join(x.text or "" for x in node.iter() if _local(x) == tag)


def _parts(z: zipfile.ZipFile, pattern: str) -> list[str]:
    found = [(int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)]


def docx_text(data: bytes) -> str:
    """Paragraphs, one a line."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return "\n".join(_runs(p, "t") for p in root.iter() if _local(p) == "p")


def xlsx_text(data: bytes) -> str:
    """Per sheet a line with its name, then rows of cells; blank cells and rows are left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = [_runs(s, "t") for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _local(s) == "si"] if "xl/sharedStrings.xml" in z.namelist() else []
        names = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _local(s) == "sheet"]
        out = []
        for name, part in zip(names, _parts(z, r"xl/worksheets/sheet(\d+)\.xml"), strict=False):
            out.append(f"[sheet] {name}")
            for row in (r for r in ElementTree.fromstring(z.read(part)).iter() if _local(r) == "row"):
                cells = []
                for c in row:
                    value = _runs(c, "t") if c.get("t") == "inlineStr" else next((v.text or "" for v in c if _local(v) == "v"), "")
                    value = shared[int(value)] if c.get("t") == "s" and value else value
                    if value.strip():
                        cells.append(value.strip())
                if cells:
                    out.append(" | ".join(cells))
    return "\n".join(out)


def pptx_text(data: bytes) -> str:
    """Per slide a line with its number, then the texts of its shapes."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        out = []
        for i, part in enumerate(_parts(z, r"ppt/slides/slide(\d+)\.xml"), 1):
            out.append(f"[slide] {i}")
            for body in (b for b in ElementTree.fromstring(z.read(part)).iter() if _local(b) == "txBody"):
                text = "\n".join(t for p in body if _local(p) == "p" and (t := _runs(p, "t").strip()))
                if text:
                    out.append(text)
    return "\n".join(out)


def file_text(name: str, data: bytes, mime: str | None = None) -> str:
    """By suffix, then by MIME type; other files are an error."""
    low, kind = name.lower(), (mime or "").lower()
    for suffixes, kinds, read in (((".html", ".htm"), ("html",), html_text), ((".pdf",), ("pdf",), pdf_text), ((".docx",), ("wordprocessingml",), docx_text), ((".xlsx",), ("spreadsheetml",), xlsx_text), ((".pptx",), ("presentationml",), pptx_text)):
        if low.endswith(suffixes) or any(k in kind for k in kinds):
            return read(data)
    if low.endswith(PLAIN) or kind.startswith("text/") or "json" in kind:
        return data.decode("utf-8", "replace")
    raise ValueError(f"unsupported file: {name}")


def load_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text and error of each file under a path; a file that cannot be read has an error in place of a text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for p, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    rows.append((p, file_text(p, content), None))
                except Exception as e:  # noqa: BLE001  one bad file must not end the job
                    rows.append((p, None, f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["path", "text", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInArrow(read, "path string, text string, error string")
