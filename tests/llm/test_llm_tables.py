"""The queries without SQL on the tables at hand: against brute force, another parser, and held-out rows. README's figures of accuracy come from here."""

import os
import zlib
from html.parser import HTMLParser

import duckdb
import pytest

from lodestar.llm import decontaminate, html_extract, near_dedup, registry
from test_llm_operators import components_of

SMALL, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"
pytestmark = pytest.mark.skipif(not os.path.isdir(LARGER), reason="the tables are not here")


def rows(folder, table, columns):
    return duckdb.sql(f"SELECT {columns} FROM '{folder}/{table}.parquet'").fetchall()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SMALL}/{table}.parquet')")
    got, want = registry.QUERIES[name](spark, SMALL).toPandas(), con.execute(registry.ORACLES[name]).df()
    plain = lambda df: sorted(map(str, df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).itertuples(index=False, name=None)))
    assert sorted(got.columns) == sorted(want.columns) and plain(got.convert_dtypes()) == plain(want.convert_dtypes())


class Article(HTMLParser):
    """The blocks of the article, by the standard library's parser. These pages have one article, of headings and paragraphs, with nothing else in it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside = self.inside or tag == "article"
        if tag in ("h1", "h2", "p"):
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        self.inside = self.inside and tag != "article"

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_all_pages(spark):
    """Every page of the larger tables, to the letter."""
    got = {r.page_id: (r.text, r.n_chars) for r in registry.QUERIES["op4_html_extraction"](spark, LARGER).collect()}
    pages = rows(LARGER, "pages", "page_id, html")
    assert len(got) == len(pages)
    for page_id, html in pages:
        parser = Article()
        parser.feed(html or "")
        parser.close()
        text = "\n".join(b for b in (" ".join(x.split()) for x in parser.blocks) if b)
        assert got[page_id] == (text, len(text))


def test_languages_of_held_out_documents(spark):
    lang = dict(rows(LARGER, "documents", "doc_id, lang"))
    got = [r for r in registry.QUERIES["op5_language_id"](spark, LARGER).collect() if r.held_out and lang[r.doc_id]]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in got) and len(got) > 2000
    assert sum(r.lang_pred == lang[r.doc_id] for r in got) >= 0.998 * len(got)


def test_quality_of_held_out_documents(spark):
    quality = dict(rows(LARGER, "labels", "doc_id, quality"))
    got = [r for r in registry.QUERIES["op9_quality_classifier"](spark, LARGER).collect() if r.held_out and quality.get(r.doc_id) is not None]
    assert len(got) > 1000 and sum(r.predicted == quality[r.doc_id] for r in got) >= 0.99 * len(got)


def test_near_duplicates_of_all_documents(spark):
    docs = rows(SMALL, "documents", "doc_id, text")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in registry.QUERIES["op7_minhash_near_dedup"](spark, SMALL).collect()}
    assert got == components_of(docs, 2, 80) and sum(d != c for d, (_, c) in got.items()) > 20


def test_exact_passages_in_all_documents(spark):
    """Whatever a search for whole passages finds, the query finds; and every stretch it reports is as near as it says."""
    words = lambda t: decontaminate_words(t or "")
    items = {i: words(t) for i, t in rows(LARGER, "benchmark", "item_id, text")}
    docs = {d: words(t) for d, t in rows(LARGER, "documents", "doc_id, text")}
    joined = {d: f" {' '.join(w)} " for d, w in docs.items()}
    exact = {(d, i) for i, w in items.items() if w for d, t in joined.items() if f" {' '.join(w)} " in t}
    found = registry.QUERIES["op1_benchmark_decontamination"](spark, LARGER).collect()
    assert len(exact) > 100 and exact <= {(r.doc_id, r.item_id) for r in found}
    for r in found:
        stretch, pattern = docs[r.doc_id][r.first_word : r.first_word + r.n_words], items[r.item_id]
        row = list(range(len(stretch) + 1))
        for i, x in enumerate(pattern, 1):
            new = [i]
            for j, y in enumerate(stretch, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        assert row[-1] == r.edits <= 0.2 * r.item_words and r.item_words == len(pattern)


def decontaminate_words(text):
    separators = decontaminate.SEPARATORS.decode()
    return [w for w in text.lower().translate(str.maketrans(dict.fromkeys(separators, " "))).split(" ") if w]


def test_odd_sketches_agree_with_sets():
    """The bound on differing bits lets every pair of 0.8 through, of those that documents make."""
    docs = [t for _, t in rows(SMALL, "documents", "doc_id, text") if t][:400]
    a, b = near_dedup.samplers(160)
    from lodestar.llm.wordhash import WordHasher

    sets = [near_dedup.shingle_set(t.encode(), 2) for t in docs]
    hashed, bounds = WordHasher().hashes([t.lower().encode() for t in docs])
    sketches = [near_dedup.odd_sketch(near_dedup.min_hashes(near_dedup.shingle_hashes(hashed[bounds[i] : bounds[i + 1]], 2), a, b), 512) if s else None for i, s in enumerate(sets)]
    limit, pairs = near_dedup.most_bits(160, 512, 0.8), 0
    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and near_dedup.linked(x, sets[j], 80):
                pairs += 1
                assert sum(bin(int(v) & (2**64 - 1)).count("1") for v in sketches[i] ^ sketches[j]) <= limit
    assert pairs


def test_default_field_is_trained_once():
    assert html_extract.default_field() is html_extract.default_field()


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Each stage on what its predecessor kept, against a letter test, labels, all pairs, every passage by its edit distance, and SQL."""
    import unicodedata

    import corpus_pipeline
    from lodestar.llm import mixing

    folder = "/root/testdata/sf0.001"
    quality, items = dict(rows(folder, "labels", "doc_id, quality")), [decontaminate_words(t or "") for _, t in rows(folder, "benchmark", "item_id, text")]
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}.parquet")
        before = {r.doc_id: r.text for r in docs.collect()}
        after = spark.read.parquet(f"{tmp_path}/{name}.parquet")
        kept = {r.doc_id for r in after.collect()}
        if name == "language_id":
            assert kept == {d for d, t in before.items() if any(unicodedata.category(c)[0] == "L" for c in t or "")}
        elif name == "quality":
            judged = [(d in kept, quality[d] == 1) for d in before if quality.get(d) is not None]
            assert sum(x == y for x, y in judged) >= 0.95 * len(judged)
        elif name == "near_dedup":
            assert kept == {d for d, (_, c) in components_of(list(before.items()), 5, 80).items() if c == d}
        elif name == "decontaminate":
            leaks = lambda words: any(decontaminate.edit_distance_within(decontaminate.bits_of(p), len(p), words)[0] <= len(p) // 5 for p in items if p)
            assert kept == {d for d, t in before.items() if not leaks(decontaminate_words(t or ""))}
        else:
            con = duckdb.connect()
            con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/decontaminate.parquet/*.parquet')")
            want = {(d, size, source_size, taken): target for d, size, source_size, target, taken in con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.ORACLE})").fetchall()}
            assert {(r.doc_id, r.size, r.source_size, r.taken): pytest.approx(r.target) for r in after.collect()} == want
        docs = after
    assert 0 < len(kept) < 200
