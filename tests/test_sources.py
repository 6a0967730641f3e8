import io
import json
import os
import shutil
import subprocess
import sys
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from lodestar.sources import formats, markup, sinks, tables
from lodestar.streaming import ingest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/"), text)
    return out.getvalue()


def test_formats(spark, tmp_path):
    docx = zipped(**{"word__document.xml": "<w:document xmlns:w='w'><w:p><w:t>Hello</w:t><w:t> there</w:t></w:p><w:p><w:t>two</w:t></w:p></w:document>"})
    xlsx = zipped(**{"xl__workbook.xml": "<w xmlns='x'><sheets><sheet name='S1'/></sheets></w>", "xl__sharedStrings.xml": "<sst xmlns='x'><si><t>shared</t></si></sst>", "xl__worksheets__sheet1.xml": "<s xmlns='x'><row><c t='s'><v>0</v></c><c><v>3</v></c><c><v> </v></c></row><row/></s>"})
    pptx = zipped(**{"ppt__slides__slide1.xml": "<s xmlns:p='p' xmlns:a='a'><p:txBody><a:p><a:t>Title</a:t></a:p></p:txBody></s>"})
    for name, data in (("a.docx", docx), ("b.xlsx", xlsx), ("c.pptx", pptx), ("d.html", b"<p>x</p><script>s</script>"), ("e.txt", b"caf\xff"), ("f.doc", b"x"), ("g.docx", b"broken"), ("h.pdf", pdf_file([["one", "two"], ["three"]])), ("i.pdf", b"no")):
        (tmp_path / name).write_bytes(data)
    got = {os.path.basename(r.path): r for r in formats.load_files(spark, str(tmp_path)).collect()}
    assert [got[n].text for n in ("a.docx", "b.xlsx", "c.pptx", "d.html", "e.txt")] == ["Hello there\ntwo", "[sheet] S1\nshared | 3", "[slide] 1\nTitle", "x\ns", "caf�"]
    assert "unsupported" in got["f.doc"].error and got["g.docx"].text is None
    assert got["h.pdf"].text == "one\ntwo\nthree" and "not a PDF" in got["i.pdf"].error


def pdf_file(pages, packed=True, unicode_font=False):
    """A PDF of lines, as a writer would lay it out: the pages of the tree in another order than in the file."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(pages))), len(pages))}
    objects[3] = b"<< /Type /Font /Subtype /Type0 /ToUnicode 4 0 R >>" if unicode_font else b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"
    table = b"1 beginbfrange <0041> <005a> <0061> endbfrange 1 beginbfchar <0001> <00e9> endbfchar"
    objects[4] = b"<< /Length %d >>\nstream\n%s\nendstream" % (len(table), table)
    for i, lines in enumerate(pages):
        show = lambda t: b"<%s> Tj" % "".join(f"{ord(c) - 32 if c != 'é' else 1:04x}" for c in t).encode() if unicode_font else b"(%s) Tj" % t.replace("(", r"\(").replace(")", r"\)").encode("cp1252")
        content = b"BT /F1 12 Tf " + b" 0 -14 Td ".join(show(t) for t in lines) + b" ET"
        objects[11 + 2 * i] = (b"<< /Filter /FlateDecode >>\nstream\n%s\nendstream" % zlib.compress(content)) if packed else b"<< >>\nstream\n%s\nendstream" % content
        objects[10 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (11 + 2 * i)
    return b"%PDF-1.4\n" + b"\n".join(b"%d 0 obj\n%s\nendobj" % (n, objects[n]) for n in sorted(objects, reverse=True)) + b"\ntrailer << /Root 1 0 R >>"


def test_pdf():
    from lodestar.sources.pdf import pdf_text

    for packed in (True, False):
        assert pdf_text(pdf_file([["a (b) café", "c"], [], ["d"]], packed)) == "a (b) café\nc\n\nd"
    assert pdf_text(pdf_file([["abé", "z"]], unicode_font=True)) == "abé\nz"
    for bad in (b"", b"%PDF-1.4 1 0 obj << /Encrypt 3 0 R >> endobj"):
        with pytest.raises(ValueError):
            pdf_text(bad)


def test_markup():
    assert markup.html_markdown("<head><title>t</title></head><body><nav>m</nav><h2>H</h2><p>a <b>b</b> <a href='u'>c</a><ul><li>x<li>y</ul><img src=i></body>") == "## H\n\na **b** [c](u)\n\n* x\n* y"
    assert markup.schema_text(json.dumps({"a": ["x" * 150, "https://u/x"], "b": {"c": "y" * 60}})) == "x" * 150 + "\n" + "y" * 60
    assert markup.schema_text("short") == "" and markup.schema_text(None) == "" and markup.schema_text("p" * 200) == "p" * 200
    assert list(markup.leaf_texts([str(i) for i in range(300)])) == [str(i) for i in range(200)]
    deep = "v"
    for _ in range(8):
        deep = [deep]
    assert list(markup.leaf_texts(deep)) == []


def test_tables(spark):
    df = spark.createDataFrame([(i, f"k{i % 3}") for i in range(20)], "n int, k string")
    assert [r.n for r in tables.row_range(df, [F.col("n")], 5, 15, 4).collect()] == [5, 6, 7, 8]
    assert tables.missing_keys(spark.createDataFrame([("k1",), ("zz",)], "k string"), df, "k").collect()[0].k == "zz"
    ids = spark.createDataFrame([("x", "o1", "1"), ("y", "x", "2")], "document_id string, object_id string, _id string")
    got = tables.by_any_id(ids, spark.createDataFrame([("x",), ("2",)], "wanted string"), ["document_id", "object_id", "_id"]).orderBy("wanted").collect()
    assert [(r.wanted, r._id) for r in got] == [("2", "2"), ("x", "1")]
    m = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3"})], "x map<string,string>, y map<string,string>").select(tables.later_wins(F.col("x"), F.col("y")).alias("m")).first().m
    assert m == {"a": "1", "b": "3"}


def test_versions_on_disk(spark, tmp_path):
    root = f"{tmp_path}/t"
    assert sinks.provision(spark, root, "a int") and not sinks.provision(spark, root, "a int")
    sinks.publish_version(spark.createDataFrame([(1,)], "a int"), root, "v1")
    assert sinks.current_version(spark, root) == "v1" and sinks.read_current(spark, root).count() == 1
    sinks.publish_version(spark.createDataFrame([(1,), (2,)], "a int"), root, "v2")
    assert sinks.read_current(spark, root).count() == 2
    with pytest.raises(FileNotFoundError):
        sinks.read_current(spark, f"{tmp_path}/none")
    sinks.append_errors(spark.createDataFrame([("bad",)], "e string"), f"{tmp_path}/errors")
    assert spark.read.json(f"{tmp_path}/errors").first().e == "bad"


def test_stream(spark, tmp_path):
    jobs, chunks, errors, checkpoint = (f"{tmp_path}/{x}" for x in ("jobs", "chunks", "errors", "checkpoint"))
    os.makedirs(jobs)

    def put(name, *rows):
        with open(f"{jobs}/{name}", "w") as f:
            f.write("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))

    job = lambda i, doc, text, ts: {"job_id": i, "company_id": "c", "doc_id": doc, "text": text, "ts": f"2024-01-0{ts}T00:00:00"}
    put("1.json", job("j1", "d1", "old " * 40, 1), job("j1", "d1", "old " * 40, 1), "not json", job("j2", "d2", "two " * 40, 1))
    ingest.start(spark, jobs, chunks, errors, checkpoint, once=True).awaitTermination()
    put("2.json", job("j4", "d1", "new " * 40, 3), job("j3", "d1", "older " * 40, 2))
    ingest.start(spark, jobs, chunks, errors, checkpoint, once=True).awaitTermination()
    got = {r.doc_id: (r.ingest_version, r.text[:3]) for r in ingest.current_chunks(spark, chunks).collect()}
    assert got == {"d1": ("j4", "new"), "d2": ("j2", "two")}
    assert [r.value for r in spark.read.json(errors).collect()] == ["not json"]


def test_without_the_llm_folders(tmp_path):
    """The library stands without its subpackage for training data."""
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'hybrid_search' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
