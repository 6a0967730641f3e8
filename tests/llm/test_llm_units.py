"""The parts of the operators, without Spark."""

import base64
import hashlib
import html as html_lib
import io
import random
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm import decontaminate, html_extract, language_id, license_scan, media, mixing, near_dedup, quality, url_filters, warc
from lodestar.llm.common import in_blocks
from lodestar.llm.wordhash import WordHasher


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@given(st.lists(st.one_of(st.none(), st.text(max_size=40)), max_size=30), st.integers(1, 60))
@settings(max_examples=60, deadline=None)
def test_blocks_cover_all(values, most):
    spans = list(in_blocks(values, most))
    assert [i for a, b in spans for i in range(a, b)] == list(range(len(values)))
    assert all(b - a == 1 or sum(len(v or "") for v in values[a:b]) <= most for a, b in spans)


@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab c\n\té ", max_size=60)), max_size=12))
@settings(max_examples=60, deadline=None)
def test_word_hashes_are_those_of_the_words(texts):
    data = [t and t.encode() for t in texts]
    h, bounds = WordHasher().hashes(data)
    own = {}
    for i, t in enumerate(data):
        words = (t or b"").split()
        assert bounds[i + 1] - bounds[i] == len(words)
        for w, v in zip(words, h[bounds[i] : bounds[i + 1]], strict=True):
            assert own.setdefault(w, v) == v
    assert len(set(own.values())) == len(own)


def test_word_hashes_over_chunks():
    text = b"word " * 300_000 + b"x" * 3_000_000 + b" word"
    h, bounds = WordHasher().hashes([text, b"word"])
    assert list(np.diff(bounds)) == [300_002, 1]
    assert h[0] == h[300_001] == h[-1] != h[300_000]


@given(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.lists(st.integers(0, 4), max_size=14))
@settings(max_examples=200, deadline=None)
def test_bit_parallel_distance(pattern, text):
    best = min(levenshtein(pattern, text[i:j]) for i in range(len(text) + 1) for j in range(i, len(text) + 1))
    got, end = decontaminate.edit_distance_within(decontaminate.bits_of(pattern), len(pattern), text)
    assert got == best
    assert min(levenshtein(pattern, text[i:end]) for i in range(end + 1)) == best


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        at = rng.randrange(len(words))
        rng.choice((lambda: words.pop(at), lambda: words.insert(at, "new"), lambda: words.__setitem__(at, "other")))()
    return words


@pytest.mark.parametrize(("sizes", "share", "least"), [((1, 4), 0.0, 1.0), ((5, 7), 0.0, 1.0), ((5, 7), 0.2, 0.9), ((8, 60), 0.0, 1.0), ((8, 60), 0.1, 0.99), ((8, 60), 0.2, 0.95)])
def test_recall_of_edited_passages(sizes, share, least):
    """Passages of a vocabulary in which a few words are very common. README states these figures."""
    rng = random.Random(3)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    passages = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(*sizes))).encode()) for i in range(150)]
    index = decontaminate.PassageIndex(passages, 0.2, decontaminate.REPETITIONS)
    texts = []
    for _, p in passages:
        words = edited(rng, p.decode().split(), int(share * len(p.split())))
        around = [rng.choice(vocabulary) for _ in range(300)]
        texts.append(" ".join([*around[:150], *words, *around[150:]]).encode())
    h, bounds = WordHasher(decontaminate.SEPARATORS).hashes(texts)
    leaks = index.leaks(index.symbols(h), bounds)
    found = {(d, index.passages[p][0]) for d, p, *_ in leaks}
    assert sum((i, i) in found for i, _ in passages) >= least * len(passages)
    for d, p, first, n, edits in leaks[:2000]:
        words = texts[d].decode().split()[first : first + n]
        assert levenshtein(passages[index.passages[p][0]][1].decode().split(), words) == edits <= 0.2 * index.sizes[p]


def test_leaks_against_brute_force():
    """Every document with every passage by the full edit distance: nothing is reported that is not there, and under 1 % is missed."""
    rng = random.Random(12)
    vocabulary = [f"v{min(int(rng.paretovariate(0.9)), 400)}" for _ in range(600)]
    passages = [[rng.choice(vocabulary) for _ in range(n)] for n in (1, 2, 3, 4, 5, 6, 9, 10, 14, 15, 20, 33) for _ in range(4)]
    texts = []
    for _ in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        for p in rng.sample(passages, 3):
            at = rng.randint(0, len(words))
            words[at:at] = edited(rng, p, rng.randint(0, len(p) // 5))
        texts.append(words)
    index = decontaminate.PassageIndex([(i, " ".join(p).encode()) for i, p in enumerate(passages)], 0.2, decontaminate.REPETITIONS)
    h, bounds = WordHasher(decontaminate.SEPARATORS).hashes([" ".join(t).encode() for t in texts])
    found = {(d, p) for d, p, *_ in index.leaks(index.symbols(h), bounds)}

    def nearest(pattern, text):
        row = [0] * (len(text) + 1)
        for i, x in enumerate(pattern, 1):
            new = [i]
            for j, y in enumerate(text, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return min(row)

    true = {(d, p) for d, t in enumerate(texts) for p, w in enumerate(passages) if nearest(w, t) <= len(w) // 5}
    assert found <= true and len(found) >= 0.99 * len(true)
    assert {x for x in true if len(passages[x[1]]) < 5} <= found


@given(st.lists(st.binary(max_size=3000), max_size=5))
@settings(max_examples=40, deadline=None)
def test_media_round_trip(payloads):
    padded = [media.pad64(p) for p in payloads]
    files = media.encode_block(padded)
    assert [d[0] for d in media.decode_block(files)] == padded
    for f in files:
        assert f[:4] == b"RIFF" and int.from_bytes(f[4:8], "little") == len(f) - 8


def test_media_extremes_and_errors():
    data = media.pad64(b"\x00\xff" * 700 + bytes(range(256)) * 5)
    (file,) = media.encode_block([data])
    assert media.decode_block([file])[0][0] == data
    with pytest.raises(ValueError):
        media.read_avi(b"no file")
    with pytest.raises(ValueError):
        media.decode_frames([b"\xff\xd8\xff\xc0\x00\x0b" + b"\x08\x00\x10\x00\x40\x01\x01\x11\x00"])


def test_frames_with_another_table():
    """A decoder that only knew its own header would not read this one."""
    frame = media.encode_lines(np.arange(media.FRAME, dtype=np.uint8).reshape(media.HEIGHT, media.WIDTH))[0]
    comment = b"\xff\xfe\x00\x06abcd"
    assert (media.decode_frames([frame[:2] + comment + frame[2:]]) == np.arange(media.FRAME, dtype=np.uint8).reshape(media.HEIGHT, media.WIDTH)).all()


def test_shots():
    dark, light = np.zeros((5, media.FRAME), np.uint8), np.full((4, media.FRAME), 200, np.uint8)
    assert media.find_shots(np.concatenate([dark, light, dark])) == [0, 5, 9]
    assert media.find_shots(np.zeros((0, media.FRAME), np.uint8)) == []


def brute_targets(sizes, weights, repeats):
    targets, fixed = [0.0] * len(sizes), set()
    while True:
        left = sum(sizes) - sum(repeats * sizes[i] for i in fixed)
        free = [i for i in range(len(sizes)) if i not in fixed]
        total = sum(weights[i] for i in free)
        targets = [float(repeats * sizes[i]) if i in fixed else left * weights[i] / total for i in range(len(sizes))]
        over = {i for i in free if targets[i] > repeats * sizes[i]}
        if not over:
            return targets
        fixed |= over


@given(st.lists(st.integers(0, 10**9), min_size=1, max_size=12))
@settings(max_examples=200, deadline=None)
def test_targets(sizes):
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    got = mixing.targets_of(sizes, weights, 3)
    assert got == pytest.approx(brute_targets(sizes, weights, 3))
    assert sum(got) == pytest.approx(sum(sizes))


@given(st.lists(st.tuples(st.integers(0, 6), st.sets(st.integers(0, 2), min_size=1)), min_size=1, max_size=4), st.lists(st.integers(0, 12), min_size=3, max_size=3))
@settings(max_examples=150, deadline=None)
def test_flow_is_largest_and_cheapest(patterns, quota):
    supply, members = [n for n, _ in patterns], [sorted(m) for _, m in patterns]
    given_ = mixing.min_cost_flow(supply, members, quota, 3)

    def possible(words):  # Hall's condition over sets of sources
        return all(sum(w for w, m in zip(words, members, strict=True) if set(m) <= s) <= sum(quota[i] for i in s) for s in ({0}, {1}, {2}, {0, 1}, {0, 2}, {1, 2}, {0, 1, 2}))

    def cost(words):
        return sum(c * max(0, min(n, w - c * n)) for w, n in zip(words, supply, strict=True) for c in range(3))

    assert possible(given_) and all(0 <= w <= 3 * n for w, n in zip(given_, supply, strict=True))
    most, cheapest = 0, None

    def search(i, words):
        nonlocal most, cheapest
        if i == len(supply):
            if possible(words) and (sum(words), -cost(words)) > (most, -(cheapest if cheapest is not None else 10**9)):
                most, cheapest = sum(words), cost(words)
            return
        for w in range(3 * supply[i] + 1):
            search(i + 1, [*words, w])

    if np.prod([3 * n + 1 for n in supply]) < 30_000:
        search(0, [])
        assert sum(given_) == most
        assert cost(given_) == (cheapest or 0)


def packed(head, pieces):
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return b"".join(packer.compress(p) for p in (head, *pieces, b"\r\n\r\n")) + packer.flush()


@given(st.binary(max_size=200_000), st.booleans(), st.sampled_from([1, 700, 3_000_000]))
@settings(max_examples=15, deadline=None)
def test_warc_stream(payload, revisit, size):
    url = "http://x/\r\ny" + "u" * size
    raw = packed(warc.record_head("urn:page:1", url, len(payload), "urn:page:2" if revisit else None, "D"), [] if revisit else [payload])
    found = [(f, n, b"".join(p)) for f, n, p in warc.read_records(io.BytesIO(raw * 3))]
    assert len(found) == 3
    for fields, n, data in found:
        assert data == (b"" if revisit else payload) and n == len(data)
        assert fields["warc-type"] == ("revisit" if revisit else "response")
        assert fields["warc-target-uri"] == url.replace("\r\n", "%0D%0A")
    with pytest.raises((ValueError, zlib.error)):
        for _, _, p in warc.read_records(io.BytesIO(raw[:-12])):
            list(p)


def test_archive_writer_checks_payloads(tmp_path):
    writer = warc.ArchiveWriter(str(tmp_path), "a")
    digest = base64.b32encode(hashlib.sha1(b"abc").digest()).decode()
    writer.begin(warc.record_head("urn:page:1", None, 3, None, digest), 3, digest)
    writer.piece(b"ab")
    writer.piece(b"c")
    writer.end()
    writer.close()
    with open(writer.done[0][0], "rb") as f:
        assert [b"".join(p) for _, _, p in warc.read_records(f)] == [b"abc"]
    for data in (b"abd", b"ab"):
        writer.begin(warc.record_head("urn:page:1", None, 3, None, digest), 3, digest)
        writer.piece(data)
        with pytest.raises(ValueError):
            writer.end()


def test_base32():
    digest = hashlib.sha1(b"").digest()
    assert warc.base32_sha1(digest) == base64.b32encode(digest).decode() == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"


def test_digest_array_tells_collisions_apart(tmp_path):
    array = url_filters.DigestArray(np.full(3, 7), np.array([0, 1, 2, 4]), np.array([1, 2, 3]), np.frombuffer(b"abcd", np.uint8))
    (tmp_path / "x").write_bytes(b"".join(p.tobytes() for p in array.parts()))
    for own in (array, url_filters.DigestArray.mapped(str(tmp_path / "x"))):
        assert own.find([b"a", b"b", b"cd", b"c"], np.full(4, 7)).tolist() == [1, 2, 3, -1]
        assert own.find([b"a"], np.array([8])).tolist() == [-1] and own.find([], np.empty(0, np.int64)).tolist() == []


def test_language_families():
    rng = random.Random(1)
    words = {"en": "the and ing tion", "de": "der und keit schen", "fr": "les des eaux ment", "es": "los que ado ción", "xx": "zyx qwk vvv kkj"}
    rows = [(lang, " ".join(rng.choices(w.split(), k=20))) for lang, w in words.items() for _ in range(30)]
    model = language_id.LanguageModel(language_id.trigram_rows([t for _, t in rows]), [lang for lang, _ in rows])
    assert model.families == ["germanic", "romance", "xx"]
    assert set(model.pairs) == {("de", "en"), ("es", "fr")}
    got, score = model.predict(language_id.trigram_rows([t for _, t in rows]))
    assert got == [lang for lang, _ in rows] and ((0 <= score) & (score <= 1)).all()
    assert language_id.LanguageModel(language_id.trigram_rows(["abc abc"]), ["en"]).predict(language_id.trigram_rows(["x", ""]))[0] == ["en", "en"]


def test_odd_sketch_bound():
    rng = np.random.default_rng(0)
    a, b = near_dedup.samplers(160)
    limit, passed, far = near_dedup.most_bits(160, 512, 0.8), 0, 0
    for i in range(300):
        common = rng.integers(0, 2**63, 400, dtype=np.uint64)
        extra = rng.integers(0, 2**63, 400, dtype=np.uint64)
        x, y = np.unique(np.r_[common, extra[:50]]), np.unique(np.r_[common, extra[50:100]])  # 400 / 500
        z = np.unique(extra)
        sketches = [near_dedup.odd_sketch(near_dedup.min_hashes(s, a, b), 512) for s in (x, y, z)]
        bits = lambda p, q: sum(bin(int(v) & (2**64 - 1)).count("1") for v in p ^ q)
        passed += bits(sketches[0], sketches[1]) <= limit
        far += bits(sketches[0], sketches[2]) <= limit
    assert passed == 300 and far == 0


def test_html_blocks():
    page = "<title>T</title><script>var t='</p>'</script><nav><a href=x>a</a></nav><article><h1>H &amp; h</h1><p>one\n two<br>three<p><b>four</article><!-- x --><ul><li>l1<li>l2</ul>tail"
    assert [t for _, t, _ in html_extract.leaf_blocks(page)] == ["T", "a", "H & h", "one two three", "four", "l1", "l2", "tail"]
    assert html_extract.leaf_blocks("") == html_extract.leaf_blocks("<p") == html_extract.leaf_blocks("<p title='x>y") == []


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("<p class=x'y>Hello</p><p class='a>b'>two", ["Hello", "two"]),
        ('<p a="1"b=\'2\'c=3/d = 4 =e "f>one</p>', ["one"]),
        ("<!-->a<!--->b<!--c--!>d<!-- e <p> -->f<!-- g", ["abdf"]),
        ("<!doctype html><?php x ?>a</ b>c</>d<>e", ["acd<>e"]),
        ("<title>a <b> &amp; c</title><p>x<textarea><p>y</textarea>z", ["a <b> & c", "x", "<p>y", "z"]),
        ("<iframe><p>no</iframe>a<script>b</scripty></script>c<style>d", ["ac"]),
        ("5 < 6 and 7<8 <3 > 2", ["5 < 6 and 7<8 <3 > 2"]),
        ("<div><span>a</div>b</span>c</p>d", ["a", "bc", "d"]),
        ("a<br/>b<img src=x>c<hr>d", ["a bc", "d"]),
        ("<P>x<UL><LI>y<LI>z</UL>w", ["x", "y", "z", "w"]),
    ],
)
def test_html_tokens(page, texts):
    assert [t for _, t, _ in html_extract.leaf_blocks(page)] == texts


@pytest.mark.parametrize("page", ['<a "' * 60_000, "<p title='" * 30_000, "<!--" * 60_000, "<div>x" * 30_000, "<b>" * 30_000 + "</div>" * 30_000, "<u><div>" + "<b>" * 30_000 + "</u>" * 30_000, "<blockquote><p>y" * 20_000, "<title>" * 50_000, "<" * 200_000, "<a b" * 60_000, "<p a = " * 40_000, "&amp" * 60_000, '<p class="' + "k " * 90_000 + '">z'])
def test_html_takes_linear_time(page):
    """Quadratic work on pages of this size would take minutes."""
    field, began = html_extract.default_field(), time.perf_counter()
    field.decode([field.score(html_extract.leaf_blocks(page))])
    assert time.perf_counter() - began < 6


def test_field_on_unseen_pages():
    field = html_extract.default_field()
    wrong = total = 0
    for page, main in html_extract.make_pages(150, seed=5):
        blocks = html_extract.leaf_blocks(page)
        (labels,) = field.decode([field.score(blocks)])
        wrong += sum(bool(y) != (t in main) for (_, t, _), y in zip(blocks, labels, strict=True))
        total += len(blocks)
    assert wrong <= 0.02 * total


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(2)
    field = html_extract.BlockField({}, np.zeros(0), rng.normal(size=(2, 2)), rng.normal(size=2))
    pages = [rng.normal(size=n) for n in (0, 3, 7, 1, 7, 2)]
    for scores, labels in zip(pages, field.decode(pages), strict=True):
        paths = [[(k >> i) & 1 for i in range(len(scores))] for k in range(1 << len(scores))]
        value = lambda y: sum(s * v for s, v in zip(scores, y, strict=True)) + (field.first[y[0]] + sum(field.steps[a, b] for a, b in zip(y, y[1:], strict=False)) if y else 0)  # noqa: E731, B023
        assert list(labels) == max(paths, key=value)


def test_license_anchors_are_in_every_match():
    sized = [(n, license_scan.bigrams(license_scan.normalised(t))) for n, t in license_scan.TEMPLATES]
    words = license_scan.anchors(sized, 0.8 / 1.2)
    rng = random.Random(4)
    for name, text in license_scan.TEMPLATES:
        base = license_scan.normalised(text)
        for _ in range(40):
            own = [w for w in base if rng.random() > 0.08]
            grams = set(license_scan.bigrams(own))
            template = set(license_scan.bigrams(base))
            if grams and 2 * len(grams & template) / (len(grams) + len(template)) >= 0.8:
                assert any(w in own for w in words), name


def test_logistic_and_dictionaries():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2))
    y = (x[:, 0] - 2 * x[:, 1] + 0.3 * rng.normal(size=400) > 0.2).astype(float)
    w = quality.fit_logistic(x, y)
    assert (((x @ w[:-1] + w[-1]) > 0) == (y > 0)).mean() > 0.93
    c = quality.Compressors(b"spam eggs " * 300, b"fair words " * 300)
    assert c.features(b"spam eggs spam eggs")[0] < c.features(b"fair words fair words")[0]
    assert html_lib.escape("<") == "&lt;" and len(c.features(b"")) == 5
