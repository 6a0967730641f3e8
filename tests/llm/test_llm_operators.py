"""The operators on small tables: against brute force, and in the odd cases that their docstrings define."""

import base64
import collections
import hashlib
import random
import textwrap
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import components, decontaminate, html_extract, language_id, license_scan, media, mixing, near_dedup, quality, url_filters, warc

DOCS = "doc_id long, text string, lang string, source string, score double, id long, size long, bucket long, component long, words string, kept boolean"
LONG = " ".join(f"w{i % 977}" for i in range(60_000))


def odd_docs(spark):
    """Nulls, empty and long texts, repeats, and columns whose names clash with the operators' own."""
    extra = (0.5, 1, 2, 3, 4, "x", False)
    rows = [(None, "a null id here", "en", "s"), (1, None, None, None), (2, "", "en", "s"), (3, " \t\n ", "de", "s"), (4, "one", "en", None), (5, "two words", "en", "t"), (6, LONG, "en", "t"), (7, "12 34", "en", "t"), (8, "again and again", "en", "s"), (8, "again and again", "en", "s"), (9, "Again AND again", None, "s")]
    return spark.createDataFrame([(*r, *extra) for r in rows], DOCS)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def components_of(rows, size, percent):
    sets = {d: frozenset(near_dedup.shingle_set((t or "").encode(), size)) for d, t in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def near_rows(seed, n):
    """Families of edited copies, some large, with chains of edits."""
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(3000)]
    rows = []
    while len(rows) < n:
        base = [rng.choice(vocabulary) for _ in range(rng.choice((1, 2, 3, 8, 40, 120)))]
        for _ in range(rng.choice((1, 1, 2, 5, 60))):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 12))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                base = words
            rows.append((len(rows) * 3 + 1, rng.choice((" ", "\n", "  ")).join(words).upper() if rng.random() < 0.2 else " ".join(words)))
    return rows


@pytest.mark.parametrize(("seed", "size"), [(1, 2), (2, 5)])
def test_near_duplicates(spark, seed, size):
    rows = near_rows(seed, 500)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=size).collect()
    want = components_of(rows, size, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_in_one_bucket(spark):
    """One large group whose members are linked by some pairs only, so that hubs, blocks and sketches all take part."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.choice((0, 2, 6, 9, 12))):
            words[rng.randrange(100)] = f"e{rng.randrange(60)}"
        rows.append((i + 10, " ".join(words)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=2).collect()
    assert {r.doc_id: r.component_id for r in got} == {d: c for d, (_, c) in components_of(rows, 2, 80).items()}


def test_near_duplicates_of_a_template(spark, monkeypatch):
    """Texts of one template that are all a little too far from each other, with a few pairs that are near: buckets are large and nobody is the hub of all.
    Blocks are small enough here to be many, and tables by bucket are joined both ways."""
    rng = random.Random(11)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(260):
        words = [w if rng.random() > 0.1 else f"e{rng.randrange(10**6)}" for w in base]
        rows.append((2 * i, " ".join(words)))
        if i % 13 == 0:
            words[rng.randrange(60)] = "changed"
            rows.append((2 * i + 1, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {d: c for d, (_, c) in components_of(rows, 2, 80).items()}
    assert 5 < sum(d != c for d, c in want.items()) < 200
    monkeypatch.setattr(near_dedup, "LEAST_BLOCK", 20)
    for broadcast in (near_dedup.BROADCAST, 0):
        monkeypatch.setattr(near_dedup, "BROADCAST", broadcast)
        assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, size=2).collect()} == want


def test_block_links():
    """The components of a block are those of all its pairs, with one link for each two components that are joined."""
    rng = random.Random(6)
    base = [f"b{i}" for i in range(30)]
    texts = [" ".join(w if rng.random() > 0.06 else f"e{rng.randrange(99)}" for w in base).encode() for _ in range(60)] + [b"", None]
    ids, asks = list(range(62)), [i % 3 == 0 for i in range(62)]
    a, b = near_dedup.block_links(np.array(ids) + 100, np.array(ids), np.array(asks), texts, 2, 80)
    sets = [near_dedup.shingle_set(t or b"", 2) for t in texts]
    true = [(i, j) for i in ids for j in ids if asks[i] and not asks[j] and near_dedup.linked(sets[i], sets[j], 80)]
    assert set(zip(a, b, strict=True)) <= {(i + 100, j + 100) for i, j in true}
    roots = lambda pairs: dict(zip(*map(np.ndarray.tolist, components.local_forest(np.array([x for x, _ in pairs]), np.array([y for _, y in pairs]))), strict=True))
    assert roots(list(zip(a, b, strict=True))) == roots([(i + 100, j + 100) for i, j in true]) and len(a) == len(roots(list(zip(a, b, strict=True))))


def test_near_duplicates_of_ids_with_two_texts(spark):
    """One id for two texts: each is compared by itself."""
    x, y = (" ".join(f"{c}{i}" for i in range(40)) for c in "xy")
    rows = [(1, x), (1, y), (2, x + " more"), (3, y + " more"), (4, y), (4, y)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 36, 1), (1, 36, 1), (2, 37, 1), (3, 37, 1), (4, 36, 1), (4, 36, 1)]


def test_near_duplicates_odd_cases(spark):
    got = sorted((tuple(r) for r in near_dedup.near_duplicates(odd_docs(spark), size=2).collect()), key=lambda r: (r[0] is not None, r))
    assert [r[:1] + r[2:] for r in got] == [(None, None, True), (1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 5, True), (6, 6, True), (7, 7, True), (8, 8, True), (8, 8, True), (9, 8, False)]
    assert [r[1] for r in got][1:6] == [0, 0, 0, 1, 1]
    assert near_dedup.near_duplicates(empty_docs(spark)).collect() == []


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(50)] + [(7, 7)]
    parent = {x: x for pair in links for x in pair}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {x: root(x) for a, b in links if a != b for x in (a, b)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


def test_leaks(spark):
    passage = "The quick brown fox, having seen the lazy dog, jumps over it twice and runs away laughing."
    other = "Nothing of this sentence is anywhere else in the whole of the small collection here."
    docs = spark.createDataFrame([(1, f"Intro text. {passage} More."), (2, f"x {passage.upper().replace('BROWN', 'red')} y"), (3, "the quick brown fox alone"), (None, passage), (4, None), (5, ""), (6, LONG + " " + other), (6, LONG + " " + other)], "doc_id long, text string")
    items = spark.createDataFrame([(10, passage), (11, other), (12, None), (13, "too short"), (14, ""), (10, "blue fox")], "item_id long, text string")
    for block_rows in (200_000, 2):
        got = decontaminate.find_leaks(docs, items, block_rows=block_rows).collect()
        assert sorted((r.doc_id or 0, r.item_id, r.edits) for r in got) == [(0, 10, 0), (1, 10, 0), (2, 10, 1), (6, 11, 0), (6, 11, 0)]
        assert {(r.first_word, r.n_words) for r in got if r.doc_id == 1} == {(2, 17)}
    again = decontaminate.find_leaks(spark.createDataFrame([(7, "one blue fox, Too short! too_short")], "doc_id long, text string"), items).collect()
    assert sorted((r.item_id, r.first_word, r.n_words, r.item_words) for r in again) == [(10, 1, 2, 2), (13, 3, 2, 2), (13, 5, 2, 2)]
    assert decontaminate.find_leaks(empty_docs(spark), items).collect() == []
    assert decontaminate.find_leaks(docs, items.limit(0)).collect() == []
    assert {r.doc_id for r in decontaminate.find_leaks(odd_docs(spark), items).collect()} == set()


def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.choice((0, 1, 5, 40)), rng.choice(("a", "b", "c", "ü", None))) for i in range(400)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), F.col("source")).collect()
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = dict(zip(names, mixing.targets_of([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 3), strict=True))
    taken = collections.Counter()
    for r in got:
        taken[r.sources[0]] += r.taken
        assert 0 <= r.taken <= 3 * r.size and r.source_size == sizes[r.sources[0]] and r.target == pytest.approx(targets[r.sources[0]])
    assert len(got) == len(rows)
    assert all(taken[s] == int(targets[s]) for s in names)
    again = mixing.mix(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string").repartition(7), F.col("source")).collect()
    assert {(r.doc_id, r.taken) for r in again} == {(r.doc_id, r.taken) for r in got}


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_of_more_patterns_than_the_driver_holds(spark, monkeypatch, seed):
    """Hundreds of sources, some of which share documents: the tables give what the driver gives."""
    rng = random.Random(seed)
    names = [f"s{i:03}" for i in range(150)] + ["ü", "Z", None]
    rows = [(i, "w " * rng.choice((0, 1, 3, 30, 200)), [rng.choice(names)] if rng.random() < 0.97 else rng.sample(names[:12], 2)) for i in range(1200)]
    rows += [(9000, "a b", []), (9001, "c", None)]
    if seed == 2:
        rows = [(i, t, s) for i, t, s in rows if s and len(s) == 1]
    df = spark.createDataFrame(rows, "doc_id long, text string, s array<string>")
    took = lambda: {r.doc_id: (r.size, r.source_size, pytest.approx(r.target), r.taken) for r in mixing.mix(df, F.col("s")).collect()}
    want = took()
    monkeypatch.setattr(mixing, "DRIVER_PATTERNS", 100)
    assert took() == want and len(want) == len(rows)


def test_mix_overlapping_and_odd(spark):
    rows = [(1, "a b c d", ["x"]), (2, "a b", ["x", "y"]), (3, "a b c", ["y", None]), (4, "a", []), (5, "a b", None)]
    got = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, s array<string>"), F.col("s")).collect()}
    assert got[4].taken == got[5].taken == 0 and sum(r.taken for r in got.values()) <= 9
    assert all(r.taken <= 3 * r.size for r in got.values())
    assert len(mixing.mix(odd_docs(spark), F.col("source")).collect()) == 11
    assert mixing.mix(empty_docs(spark), F.col("source")).collect() == []


def test_mix_of_rows_that_share_an_id(spark):
    """One id for all rows, of several sizes: what is taken does not depend on how the rows lie."""
    rows = [(1, "w " * n, s) for n in (1, 2, 3, 5, 8, 13, 21) for s in ("a", "b")]
    took = lambda order, parts: sorted((r.sources[0], r.size, r.taken) for r in mixing.mix(spark.createDataFrame(order, "doc_id long, text string, s string").repartition(parts), F.col("s")).collect())
    assert took(rows, 1) == took(rows[::-1], 5) == took(rows[5:] + rows[:5], 3)
    assert sum(t for s, _, t in took(rows, 2) if s == "a") == 75 and sum(t for s, _, t in took(rows, 2) if s == "b") == 30


PAGES = "page_id long, url string, html string, text string, hex string, rule string"


def odd_pages(spark):
    rows = [(1, "http://a/", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://b/\n", None), (4, "", ""), (5, "u", "é" * 3_000_000), (5, "u", "é" * 3_000_000), (None, "http://n", "<p>n</p>"), (None, None, None)]
    return spark.createDataFrame([(*r, "t", "h", "r") for r in rows], PAGES)


def test_warc(spark):
    rows = [(r.page_id, r.html) for r in odd_pages(spark).collect()]
    largest = {}
    for i, h in rows:
        largest[h or ""] = max((x for x in (i, largest.get(h or "")) if x is not None), default=None)
    import lodestar.llm.warc as w

    manifest = w.archive_pages(odd_pages(spark))
    for payloads in (True, False):
        got = w.chunk_table(manifest, payloads=payloads).collect()
        assert len({r.record_id for r in got}) == len(rows)
        by_record = collections.defaultdict(list)
        for r in got:
            by_record[r.record_id.partition("#")[0], r.record_type].append(r)
        long = [r for r in by_record["urn:page:5", "response"]]
        assert len(long) == 2 * -(-6_000_000 // w.CHUNK) and sorted(r.chunk_no for r in long if r.is_last) == [5, 5]
        if payloads:
            whole = b"".join(r.chunk for r in sorted(long, key=lambda r: (r.record_id, r.chunk_no))[:6])
            assert whole == ("é" * 3_000_000).encode()
        assert max(len(r.chunk or b"") for r in got) <= w.CHUNK
    want = sorted((i or 0, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if i == largest[h or ""] else "revisit", None if i == largest[h or ""] else largest[h or ""]) for i, h in rows)
    last = [r for r in w.chunk_table(manifest, payloads=False).collect() if r.is_last]
    page = lambda s: int(s.rpartition(":")[2].partition("#")[0] or 0)
    assert sorted((page(r.record_id), r.header_bytes, r.header_digest, r.record_type, r.refers_to and page(r.refers_to)) for r in last) == want
    assert all(r.sha1_so_far == r.header_digest for r in last if r.record_type == "response")
    empty = w.archive_pages(odd_pages(spark).limit(0))
    assert w.chunk_table(empty).collect() == []


def test_warc_of_long_urls_and_many_copies(spark, monkeypatch):
    """A url of 3 MB goes through; copies revisit their largest page also where their digests are too many to broadcast."""
    rows = [(i, "http://h/" + "u" * (3_000_000 if i == 7 else 3), f"<p>{i % 10}</p>") for i in range(200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for most in (warc.BROADCAST_IDS, 0):
        monkeypatch.setattr(warc, "BROADCAST_IDS", most)
        got = {r.record_id: r for r in warc.chunk_table(warc.archive_pages(df)).collect()}
        assert {k: (r.url, r.refers_to) for k, r in got.items()} == {f"urn:page:{i}": (u, None if i >= 190 else f"urn:page:{190 + i % 10}") for i, u, _ in rows}


def test_op3_query(spark, tmp_path):
    odd_pages(spark).select("page_id", "url", "html").write.parquet(f"{tmp_path}/pages.parquet")
    got = warc.op3_warc_records(spark, str(tmp_path)).collect()
    assert sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in got) == [(0, 0, "revisit", 4), (0, 8, "response", None), (1, 8, "revisit", 2), (2, 8, "response", None), (3, 0, "revisit", 4), (4, 0, "response", None), (5, 6_000_000, "response", None), (5, 6_000_000, "response", None)]


def test_html(spark):
    got = html_extract.extract_text(odd_pages(spark)).collect()
    assert len(got) == 8 and all(r.n_chars == len(r.text) for r in got)
    assert sorted(r.n_chars for r in got)[:3] == [0, 0, 0]
    page = "<html><body><header><h1>Site</h1></header><nav><a href=/>Home</a></nav><div class='cookie-notice'>We use cookies.</div><article><h1>Title &eacute;</h1><p>First   one.</p><div class=ad>Buy now</div><p>Second <a href=x>two</a>.</p></article><aside>More</aside><section class=comments><p>Nice article, I liked it very much.</p></section><form><label>Mail</label></form><footer>&copy; me</footer></body></html>"
    one = html_extract.extract_text(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")).first()
    assert one.text == "Title é\nFirst one.\nSecond two."
    assert html_extract.extract_text(odd_pages(spark).limit(0)).collect() == []


def test_language(spark):
    rng = random.Random(1)
    words = {"en": "the and ing tion", "de": "der und keit schen", "fr": "les des eaux ment"}
    rows = [(i, " ".join(rng.choices(words[lang].split(), k=20)), lang) for i, lang in enumerate(["en", "de", "fr"] * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit_language_model(docs.where("doc_id < 90"))
    got = language_id.identify_languages(docs, model).collect()
    assert all(r.lang_pred == r.lang for r in got)
    odd = language_id.identify_languages(odd_docs(spark), model)
    assert odd.columns[-2:] == ["lang_pred", "score"] and odd.columns.count("score") == 1
    assert {r.doc_id: r.lang_pred for r in odd.collect() if r.lang_pred == "und"}.keys() == {1, 2, 3, 7}
    assert all(0 <= r.score <= 1 for r in odd.collect())
    signs = spark.createDataFrame([(1, "½"), (2, "² 12"), (3, "①Ⅷ _!"), (4, "¼ é"), (5, "中"), (6, "ª")], "doc_id long, text string")
    assert [r.doc_id for r in language_id.identify_languages(signs, model).orderBy("doc_id").collect() if r.lang_pred == "und"] == [1, 2, 3]
    none = language_id.fit_language_model(empty_docs(spark))
    assert none is None and {r.lang_pred for r in language_id.identify_languages(docs, none).collect()} == {"und"}
    assert language_id.identify_languages(empty_docs(spark), model).collect() == []


def quality_rows(n=300):
    rng = random.Random(8)
    good, bad = ("plain words that make a fair sentence about things".split(), "BUY NOW!!! cheap $$$ click### WIN%%%".split())
    return [(i, " ".join(rng.choices(good if i % 3 else bad, k=40)), int(i % 3 > 0)) for i in range(n)]


def test_quality(spark):
    rows = quality_rows()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows if i < 200] + [(None, 1, 0), (3, None, 0), (9999, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit_quality_model(docs, labels)
    got = quality.score_quality(docs, model).collect()
    assert sum(r.predicted == q for r, (_, _, q) in zip(sorted(got), rows, strict=True)) >= 0.98 * len(rows)
    odd = quality.score_quality(odd_docs(spark), model).collect()
    assert len(odd) == 11 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in odd)
    assert {r.score for r in quality.score_quality(docs, quality.fit_quality_model(docs, labels.limit(0))).collect()} == {0.5}
    assert quality.score_quality(empty_docs(spark), model).collect() == []


def test_urls(spark):
    urls = ["https://a.net/x", "http://a.net", "https://Example.NET/en/1?q#f", "http://x.example.net/de/", "http://example.com/de/", "http://myexample.com/de/", "https://w.org/fr/1", "http://w.org/en/", "http://m.casino-win.example.org/fr/", "http://m.casino-win.example.org/en/", "no scheme", "", None, "http://", "://h.net/", "http://a.net:80/"]
    got = {r.url: r for r in url_filters.judge_urls(spark.createDataFrame([(u, "r") for u in urls], "url string, rule string"), keep=("url",)).collect()}
    want = ["net/ block", "None allow", "example.net/en/ allow", "net/ block", "example.com/de/ block", "None allow", "org/fr/ allow", "None allow", "org/fr/ allow", "None block", "None allow", "None allow", "None allow", "None allow", "net/ block", "None allow"]
    assert [f"{got[u].rule} {got[u].verdict}" for u in urls] == want
    assert (got[urls[2]].host, got[urls[2]].path) == ("example.net", "/en/1") and got[None].host == got["no scheme"].path == ""
    assert url_filters.judge_urls(odd_pages(spark).limit(0)).collect() == []


def test_url_lists(spark):
    """Lists from a table, over many files, with nulls, repeats and kinds that mean nothing."""
    keys = [f"h{i}.example" for i in range(300)]
    rows = [("host", k) for k in keys[::3]] * 2 + [("url", f"{k}/x") for k in keys[1::3]] + [("host", None), (None, "h2.example"), ("odd", "h2.example"), ("word", "Ünicode"), ("host", "")]
    listed = spark.createDataFrame(rows, "kind string, value string")
    urls = [f"http://{s}{k}{p}" for k in keys for s in ("", "www.", "x") for p in ("/x", "/y")]
    df = spark.createDataFrame([(u,) for u in urls], "url string").repartition(3)
    for file_keys in (1 << 21, 16):
        got = {r.url: r.verdict for r in url_filters.judge_urls(df, keep=("url",), rules=(), listed=listed, file_keys=file_keys).collect()}
        assert {u for u, v in got.items() if v == "block"} == {u for u in urls for k in keys[::3] if u.split("/")[2] in (k, f"www.{k}")} | {f"http://{k}/x" for k in keys[1::3]}
    assert {r.verdict for r in url_filters.judge_urls(df, rules=(), keep=(), listed=listed.limit(0)).collect()} == {"allow"}


def test_digests_are_sparks(spark):
    texts = ["", "a", "abc", "é" * 5, "x" * 31, "y" * 32, "z" * 33, "w" * 1000, "12345678", "123456789012"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.xxhash64("t").alias("h")).collect()
    assert all(r.h % (1 << 64) == url_filters.digest_of(r.t.encode()) for r in rows)


def test_media_columns(spark):
    got = media.media_features(media.encode_media(odd_docs(spark)))
    rows = got.collect()
    texts = [(r.doc_id, r.text) for r in odd_docs(spark).collect()]
    want = sorted((d or 0, len((t or "").encode()), hashlib.sha256(media.pad64((t or "").encode())).hexdigest(), zlib.crc32(media.pad64((t or "").encode())[-64:])) for d, t in texts)
    assert sorted((r.doc_id or 0, r.n_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == want
    assert all(r.payload_bytes % 64 == 0 and r.payload_bytes >= 64 for r in rows)
    assert len({(r.media_sha256, r.feature) for r in rows if r.doc_id == 8}) == 1
    clips = media.clip_rows(media.encode_media(odd_docs(spark))).where("doc_id = 6").orderBy("clip").collect()
    assert clips[0].start_s == 0 and all(a.end_s == b.start_s for a, b in zip(clips, clips[1:], strict=False))
    assert media.encode_media(empty_docs(spark)).collect() == []
    odd = media.encode_media(odd_docs(spark)).where("doc_id = 8 or doc_id = 2").selectExpr("doc_id", "if(doc_id = 2, null, media) as media", "1 as clip", "'x' as feature", "2 as n_frames")
    assert [r.doc_id for r in media.media_features(odd).collect()] == [8, 8] and {r.feature for r in media.media_features(odd).collect()} == {r.feature for r in rows if r.doc_id == 8}
    assert [(r.doc_id, r.clip) for r in media.clip_rows(odd).collect()] == [(8, 0), (8, 0)] and media.clip_rows(odd.limit(0)).collect() == []


def test_licenses(spark):
    docs = spark.createDataFrame([(1, "intro\nReleased under the MIT License.\nmore\nreleased UNDER the mit license"), (2, "Licensed under the Apache License, Version 2.0."), (3, "licensed under the law of the land, version of events"), (4, None), (5, ""), (None, "a longer line before it\nReleased under the MIT License."), (2, "Licensed under the Apache License, Version 2.0."), (6, LONG + "\nLicensed under CC BY-NC 4.0.")], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.license, r.n_units, r.first_unit, r.dice) for r in license_scan.scan_licenses(docs).collect()))
    assert got == [(0, "MIT", 1, 1, 1.0), (1, "MIT", 2, 1, 1.0), (2, "Apache-2.0", 1, 0, 1.0), (6, "CC-BY-NC-4.0", 1, 1, 1.0)]
    assert license_scan.scan_licenses(odd_docs(spark)).collect() == [] and license_scan.scan_licenses(empty_docs(spark)).collect() == []


def best_runs(text):
    """Brute force: for each licence what its best Dice coefficient may be. That of lines and the whole text counts; that of all runs of words up to 1.5 times a
    template's counts where no line matches, and may count where one does: a long text can match beside a line that is a notice by itself."""
    units, runs = collections.Counter(), collections.Counter()
    words = license_scan.normalised(text)
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    for name, notice in license_scan.TEMPLATES:
        own = license_scan.normalised(notice)
        grams, longest = set(license_scan.bigrams(own)), (len(own) - 1) * 3 // 2
        dice = lambda x: 2 * len(x & grams) / (len(x) + len(grams))  # noqa: B023, E731
        for unit in {*text.split("\n"), text}:
            units[name] = max(units[name], dice(set(license_scan.bigrams(license_scan.normalised(unit)))))
        for i in range(len(pairs)):
            seen = set()
            for p in pairs[i : i + longest]:
                seen.add(p)
                runs[name] = max(runs[name], dice(seen))
    return {name: {round(max(units[name], runs[name]), 6), round(units[name], 6)} if units[name] >= 0.8 else {round(runs[name], 6)} for name in runs if runs[name] >= 0.8}


def test_licenses_in_passages(spark):
    """Every notice in a document of 200 other words, wrapped or inside a line, whole or edited, against brute force."""
    rng = random.Random(4)
    prose = lambda n: " ".join(f"{rng.choice('bdfgk')}{rng.choice('aeiou')}{rng.randrange(99)}x" for _ in range(n))
    rows, whole = [], set()
    for name, notice in license_scan.TEMPLATES:
        for wrapped in (textwrap.fill(notice, 70), textwrap.fill(notice, 78, initial_indent=" * ", subsequent_indent=" * "), f"{prose(40)} {notice} {prose(40)}"):
            whole.add((len(rows), name))
            rows.append((len(rows), f"{prose(100)}\n{wrapped}\n{prose(100)}"))
        for _ in range(3):
            words = notice.split()
            for _ in range(rng.randint(1, 1 + len(words) // 6)):
                at = rng.randrange(len(words))
                words[at : at + rng.randint(0, 1)] = [prose(1)] * rng.randint(0, 2)
            rows.append((len(rows), f"{prose(30)}\n{prose(9)} {' '.join(words)} {prose(60)}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = license_scan.scan_licenses(docs.union(docs.limit(1))).collect()
    found, want = {(r.doc_id, r.license): r.dice for r in got}, {(i, name): d for i, text in rows for name, d in best_runs(text).items()}
    assert found.keys() == want.keys() and all(min(want[k]) <= d <= max(want[k]) for k, d in found.items())
    assert whole <= found.keys()
    assert all(r.first_unit == 1 for r in got if (r.doc_id, r.license) in whole)


def test_licenses_where_passages_lie(spark):
    """Passages count by the line in which they begin, across the blocks of long texts, and not again where a line matches."""
    mit, far = "Released under the MIT License.", " ".join(["far"] * (license_scan.BLOCK - 3))
    rows = [(1, f"This project is {mit}"), (2, f"x\nwell, {mit} {far} {mit}\n" + f"so it is {mit}\n{far}\n" * 3), (3, f"{far} Released under\nthe MIT License\nx"), (4, f"{mit}\nand {far}"), (5, f"x {far}\n{mit}")]
    got = license_scan.scan_licenses(spark.createDataFrame([*rows, (None, rows[0][1]), (None, rows[0][1])], "doc_id long, text string")).collect()
    assert {tuple(r) for r in got} == {(None, "MIT", 1, 0, 1.0), (1, "MIT", 1, 0, 1.0), (2, "MIT", 4, 1, 1.0), (3, "MIT", 1, 0, 1.0), (4, "MIT", 1, 0, 1.0), (5, "MIT", 1, 1, 1.0)}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    good = quality_rows(240)
    passage = " ".join(f"leak{i}" for i in range(20))
    docs = [(i, f"{t} u{i} v{i} x{i}", "en", f"s{i % 4}", len(t)) for i, t, _ in good] + [(1000, good[1][1] + " u1 v1 x1", "en", "s1", 1), (1001, f"{good[2][1]} {passage} y", "en", "s2", 1), (1002, None, "en", "s1", 0), (1003, "12345", "en", "s1", 5)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, _, q in good], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality", "near_dedup", "decontaminate", "mix"]
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in rows}
    assert ids <= {i for i, _, q in good if q} and len(ids) >= 0.95 * sum(q for *_, q in good)
    assert not ids & {1000, 1001, 1002, 1003}


def test_pipeline_stages_with_odd_ids(spark, tmp_path):
    """Null ids, equal rows, and texts that share an id: each row goes or stays by its own text."""
    import corpus_pipeline

    text = lambda w: " ".join(f"{w}{i}" for i in range(30))
    passage = text("leak")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"x {passage} y"), (None, text("a")), (None, text("a")), (7, f"z {passage}"), (7, text("b")), (8, text("c")), (8, text("c")), (9, text("c")), (5, text("d")), (6, text("a")), (4, text("d")), (4, text("e")), (3, ""), (3, ""), (3, None), (2, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = lambda df: collections.Counter((r.doc_id, r.text) for r in df.collect())
    assert kept(corpus_pipeline.decontaminate(spark, docs, str(tmp_path))) == collections.Counter(r for r in rows if passage not in (r[1] or ""))
    want = [(7, f"z {passage}"), (7, text("b")), (8, text("c")), (6, text("a")), (4, text("d")), (4, text("e")), (3, ""), (3, None), (2, "")]
    assert kept(corpus_pipeline.near_dedup(spark, docs, str(tmp_path))) == collections.Counter(want)
