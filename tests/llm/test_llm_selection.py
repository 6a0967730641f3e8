"""Importance resampling, toxicity and centroid clustering: against brute force, on held-out rows, and in odd cases. The session without a shared folder."""

import hashlib
import math
import os
import random
import re
import subprocess
import sys
import tracemalloc
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import centroids, html_extract, importance, registry, toxicity
from test_llm_operators import empty_docs, odd_docs

SMALL, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"
here = pytest.mark.skipif(not os.path.isdir(LARGER), reason="the tables are not here")


# ---- importance resampling


def features_of(text, longest):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def resampled(docs, target, percent, buckets, longest, least, seed):
    """One document after the other, with dictionaries."""
    count = lambda texts: {b: n for b, n in zip(*np.unique([zlib.crc32(f.encode()) % buckets for t in texts for f in features_of(t, longest)[1]] or [-1], return_counts=True), strict=True) if b >= 0}
    own, other = count([t for _, t in docs]), count(target)
    s_all, t_all = sum(own.values()), sum(other.values())
    out = []
    for key, text in docs:
        words, found = features_of(text, longest)
        weight = sum(math.floor(1000 * math.log((other.get(b, 0) + 1) * (s_all + buckets) / ((own.get(b, 0) + 1) * (t_all + buckets)))) for b in (zlib.crc32(f.encode()) % buckets for f in found))
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(found), int(weight), int(weight) + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words)])
    order = sorted((i for i, r in enumerate(out) if r[4] >= least), key=lambda i: (-out[i][3], out[i][0] is None, out[i][0] or 0))
    ranks = {i: n + 1 for n, i in enumerate(order[: len(order) * percent // 100])}
    return sorted((str((*r[:4], ranks.get(i))) for i, r in enumerate(out)))


@pytest.mark.parametrize(("longest", "percent", "least"), [(1, 10, 20), (2, 50, 3), (3, 100, 0)])
def test_resampling(spark, longest, percent, least):
    rng = random.Random(longest)
    words = [*(f"w{i}" for i in range(200)), "Ärger", "ÉTÉ", "x_y", "a-b", "日本", "Q" * 70]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.choice((0, 1, 2, 19, 20, 60))))) for i in range(150)] + [(500, None), (501, " .,; "), (502, " ".join(f"n{i}" for i in range(9000)))]
    target = [" ".join(rng.choice(words[:20]) for _ in range(30)) for _ in range(5)] + [None, ""]
    got = importance.resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame([(t,) for t in target], "text string"), percent, 997, longest, least, 7)
    assert sorted(str(tuple(r)) for r in got.collect()) == resampled(docs, target, percent, 997, longest, least, 7)


def test_resampling_of_odd_rows(spark):
    docs, target = odd_docs(spark), spark.createDataFrame([("again two words",)], "text string")
    got = importance.resample(docs, target, percent=50, least_words=2).collect()
    assert len(got) == docs.count() and sorted(r.rank for r in got if r.rank) == [1, 2, 3]
    assert all(r.weight == 0 for r in got if not r.n_features) and {r.n_features for r in got if r.doc_id in (1, 2, 3)} == {0}
    twice = [r for r in got if r.doc_id == 8]
    assert len(twice) == 2 and twice[0].score == twice[1].score
    assert importance.resample(empty_docs(spark), target).count() == 0
    assert importance.resample(docs, target.where("false")).count() == docs.count()
    with pytest.raises(ValueError):
        importance.resample(docs, target, buckets=1 << 17)


def test_crc_of_many_words():
    rng = random.Random(3)
    texts = [None, b"", b"Hello World", b"y" * 200 + b" zz", b"a" * 2_500_000 + b" b", " ".join(f"wörd{rng.randrange(999)}" for _ in range(200_000)).encode()]
    found, n, words = importance.bucket_stream(texts, 60_000, 1)
    want = [[zlib.crc32(f.encode()) % 60_000 for f in features_of((t or b"").decode(), 1)[1]] for t in texts]
    assert n.tolist() == words.tolist() == [len(w) for w in want] and found.tolist() == sum(want, [])


# ---- toxicity


@here
def test_toxicity_of_held_out_rows(spark):
    got = {r.doc_id: r for r in registry.QUERIES["op12_toxicity"](spark, LARGER).collect()}
    labelled = duckdb.sql(f"SELECT doc_id, toxic FROM '{LARGER}/labels.parquet' WHERE toxic IN (0, 1)").fetchall()
    assert len(got) == duckdb.sql(f"SELECT count(*) FROM '{LARGER}/documents.parquet'").fetchall()[0][0]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    toxic = [got[d].predicted for d, t in labelled if t and got[d].held_out]
    clean = [got[d].predicted for d, t in labelled if not t and got[d].held_out]
    assert len(toxic) > 100 and sum(toxic) / len(toxic) >= 0.8 and sum(clean) / len(clean) <= 0.005


def toxic_docs(spark, n=240):
    rng = random.Random(4)
    words = [f"v{i}" for i in range(300)]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(20, 200))]
        if i % 3 == 0:
            text[rng.randrange(len(text))] = rng.choice(("Blorg!", "(blorg)", "you sir blorg"))
        rows.append((i, " ".join(text), int(i % 3 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxicity_by_words(spark):
    docs = toxic_docs(spark)
    model = toxicity.fit_toxicity_model(docs.drop("toxic"), docs.drop("text"))
    assert 0 < len(model.hashes) < 50 and (np.diff(model.hashes.astype(np.int64)) > 0).all()
    filler = " ".join(f"v{i % 300}" for i in range(400_000))
    texts = [(1, "a fine BLORG it is"), (2, "a fine day it is"), (3, filler), (4, f"{filler} blorg"), (5, None), (6, ""), (7, " ,;"), (None, "blorg"), (1, "a fine BLORG it is")]
    got = toxicity.score_toxicity(spark.createDataFrame([(*t, "x", 9.0) for t in texts], "doc_id long, text string, predicted string, score double"), model).collect()
    assert [r.predicted for r in sorted(got, key=lambda r: (r.doc_id is None, r.doc_id))] == [1, 1, 0, 0, 1, 0, 0, 0, 1]
    assert len({r.score for r in got if r.doc_id in (5, 6, 7)}) == 1


def test_toxicity_of_odd_rows(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(5, 1), (6, 0), (8, 1), (9, 0), (None, 1), (4, None), (99, 1), (2, 1)], "doc_id long, toxic int")
    assert len(toxicity.score_toxicity(docs, toxicity.fit_toxicity_model(docs, labels)).collect()) == docs.count()
    for unusable in (labels.where("false"), labels.where("toxic = 1"), labels.where("doc_id = 2")):
        none = toxicity.fit_toxicity_model(docs, unusable)
        assert none is None and {(r.score, r.predicted) for r in toxicity.score_toxicity(docs, none).collect()} == {(0.5, 0)}
    assert toxicity.score_toxicity(empty_docs(spark), None).count() == 0


def test_features_in_parts_of_any_size(monkeypatch):
    """Words that go on in further parts have the same features, and pairs reach across parts."""
    texts = [b"one longerword, " + b"x" * 100 + b" and then " + b"yz" * 40 + b"!", None, b"", b"w" * 64, b" \n a b c " + b"q" * 31, b"last words of all"]

    def found():
        return {(int(i), int(h)) for of, hashes in toxicity.Features().of_texts(texts) for i, h in zip(of, hashes, strict=True)}

    want = found()
    assert {i for i, _ in want} == {0, 3, 4, 5}
    for size in (1, 7, 16, 32, 50, 64, 1000):
        monkeypatch.setattr(toxicity, "BLOCK", size)
        assert found() == want, size
        parts = [h for _, h in toxicity.Features().of_texts(texts)]
        assert toxicity.distinct(parts, np.uint32).tolist() == sorted({h for _, h in want})


def test_memory_of_features_does_not_grow_with_a_word():
    text, features = b"x" * (24 << 20) + b" end", toxicity.Features()
    tracemalloc.start()
    try:
        assert len(toxicity.distinct((h for _, h in features.of_texts([text])), np.uint32)) == 2 + 5 + 1
        assert tracemalloc.get_traced_memory()[1] < 150e6
    finally:
        tracemalloc.stop()


def test_ftrl_by_hand():
    """The first steps of the published update rule, for one coordinate and the bias."""
    own = toxicity.Ftrl(1, alpha=0.5, beta=1.0, l1=0.1, l2=0.0)
    own.step(np.array([0]), 1.0)  # w = 0, so g = -0.5: z = -0.5, n = 0.25
    assert np.allclose(own.z, -0.5) and np.allclose(own.n, 0.25)
    assert np.allclose(own.weights(np.array([0, 1])), [(0.5 - 0.1) / ((1 + 0.5) / 0.5), 0.5 / ((1 + 0.5) / 0.5)])


# ---- centroids


def clustered(rows, k, rounds, seed, scale, dimensions):
    """Lloyd's rounds with every distance, in Python's integers."""
    kept = [(key, [math.floor(Fraction(x) * scale) for x in v]) for key, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    means = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(means))
    for _ in range(rounds):
        held = [[v for _, v in kept if nearest(v)[1] == j] for j in range(len(means))]
        means = [[sum(x) // len(own) for x in zip(*own, strict=True)] if own else c for own, c in zip(held, means, strict=True)]
    found = [(key, *nearest(v)) for key, v in kept]
    sums = {j: sum(d for _, d, i in found if i == j) for j in range(len(means))}
    return sorted(str((key, j, d, sums[j], sum(sums.values()), hashlib.sha256(",".join(map(str, means[j])).encode()).hexdigest())) for key, d, j in found)


@pytest.mark.parametrize(("seed", "n", "k", "rounds", "spread"), [(1, 400, 16, 3, 1.0), (2, 300, 5, 6, 0.05), (3, 200, 12, 0, 1.0), (4, 7, 16, 3, 1.0), (5, 300, 8, 4, 30_000.0)])
def test_clusters(spark, seed, n, k, rounds, spread):
    """Coarse vectors, so that many tie, with repeats; some far apart."""
    rng = random.Random(seed)
    middles = [[rng.uniform(-spread, spread) for _ in range(6)] for _ in range(4)]
    rows = [(i, [m + rng.choice((-0.25, 0.0, 0.25)) * min(spread, 1) for m in rng.choice(middles)]) for i in range(n)]
    rows += [(n + i, list(rows[i][1])) for i in range(0, n, 3)] + [(None, rows[0][1]), (0, rows[0][1])]
    broken = [(9001, None), (9002, [1.0] * 5), (9003, [1.0] * 7), (9004, [1.0] * 5 + [None]), (9005, [float("nan")] * 6), (9006, [float("inf")] + [0.0] * 5), (9007, [])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows + broken], "vec_id long, embedding array<double>, cluster string, v int").repartition(5)
    got = centroids.cluster_vectors(df, k, rounds, seed=3, scale=8, dimensions=6)
    assert sorted(str(tuple(r)) for r in got.collect()) == clustered(rows + broken, k, rounds, 3, 8, 6)


def test_clusters_of_nothing(spark):
    empty = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert centroids.cluster_vectors(empty).count() == 0
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster_vectors(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<float>")).collect()


def test_bounds_spare_distances():
    """Far groups: after the first round hardly a distance is computed, and every bound holds."""
    rng = np.random.default_rng(5)
    x = (rng.integers(-900, 900, (12, 8))[rng.integers(0, 12, 5000)] + rng.integers(-5, 5, (5000, 8))).astype(np.int64)
    means = x[:12].copy()
    own = centroids.Elkan(means)
    state = own.assign(x, *own.bounds(len(x)))
    assert state[3] < 5000 * 12
    for _ in range(3):
        after = np.array([x[state[0] == j].sum(axis=0) // max(1, (state[0] == j).sum()) if (state[0] == j).any() else means[j] for j in range(12)])
        state = centroids.Elkan(after, means).assign(x, *state[:3])
        means = after
        exact = np.sqrt(((x[:, None] - means) ** 2).sum(axis=2))
        assert (state[2] <= exact).all() and (state[1] >= exact[np.arange(len(x)), state[0]]).all()
        assert (exact.argmin(axis=1) == state[0]).all()
    assert state[3] < 5000 * 3


# ---- the shared folder

PROBE = """
import sys
import tracemalloc
from lodestar.session import make_session
from lodestar.llm import registry
spark = make_session("local[2]", 2)
assert spark.conf.get("spark.checkpoint.dir", None) is None
for name in ("op2_mix_sources", "op3_warc_records", "op6_url_filters", "op7_minhash_near_dedup", "op9_quality_classifier", "op13_centroid_clusters"):
    print(name, registry.QUERIES[name](spark, "/root/testdata/sf0.001").count())
from lodestar.llm import common
print(*common._folders, sep="\\n")
"""


@here
def test_without_a_shared_folder(tmp_path):
    """A session that says nothing of spark.checkpoint.dir: the operators work, and what they wrote is gone when Python ends."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": root}
    done = subprocess.run([sys.executable, "-c", PROBE], env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    *counts, folder = done.stdout.split("\n")[:-1]
    assert len(counts) == 6 and all(int(c.split()[1]) > 0 for c in counts)
    assert folder.startswith("file:") and not os.path.exists(folder[5:])


# ---- pages of few signs

PROSE = "This is a long paragraph of an article that says quite a lot about its matter. It goes on for some sentences, and then it ends. "
MENU = "<ul><li><a href=/>Home</a></li><li><a href=/a>About us</a></li><li><a href=/n>News</a></li></ul>"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (PROSE * 2, (PROSE * 2).strip()),
        ("Just some words here", "Just some words here"),
        ("<body>Just body text here.</body>", "Just body text here."),
        (f"<html><body>{MENU}<div>{PROSE}</div><div>Second. {PROSE}</div><footer>Copyright 2020</footer></body></html>", f"{PROSE.strip()}\nSecond. {PROSE.strip()}"),
        (f"<html><body><nav>{MENU}</nav><div>{PROSE}</div><div>Second. {PROSE}</div><div class=footer>Copyright 2020</div></body></html>", f"{PROSE.strip()}\nSecond. {PROSE.strip()}"),
        ('<main><p>Text one is here.</p><div class="user-reviews"><p>I liked it a lot.</p><p>Me too, thanks.</p></div></main>', "Text one is here."),
        ('<article><p>Seen text here.</p><p style="display:none">Hidden one.</p><p hidden>Hidden two.</p></article>', "Seen text here."),
        ("<article><h1>A title</h1><p>Seen text here.</p><p hidden>Hidden one.</p><p>Seen again.</p></article>", "A title\nSeen text here.\nSeen again."),
        (f"<html><body><table><tr><td>{MENU}</td><td><p>{PROSE}</p><p>Second. {PROSE}</p></td></tr></table></body></html>", f"{PROSE.strip()}\nSecond. {PROSE.strip()}"),
        (f"<html><head><title>T</title></head><body><h1>The head line</h1><p>{PROSE}<p>Second. {PROSE}<hr><p>&copy; 2021 All rights reserved</body></html>", f"The head line\n{PROSE.strip()}\nSecond. {PROSE.strip()}"),
    ],
)
def test_pages_of_few_signs(page, want):
    """By hand, of another make than those that the field is trained on."""
    field, blocks = html_extract.default_field(), html_extract.leaf_blocks(page)
    assert "\n".join(t for (_, t, _), ok in zip(blocks, field.decode([field.score(blocks)])[0], strict=True) if ok) == want
