"""Toxicity: logistic regression over hashed word n-grams and skip-grams, fitted by FTRL-proximal.

Words are lower-cased runs of anything but white space and ASCII punctuation. Features of a text are its words, the beginnings of 4 to 8 bytes of longer words (so that forms of one
stem share what is learned), pairs of neighbours, and pairs with one or two words between, each hashed to 32 bits and counted once in a text. FTRL gives each
feature a learning rate of its own and keeps those that say little at exactly 0, so that the model is a short sorted array of hashes with their weights.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import byte_values, drop_written, id_remainder, in_blocks, small_batches, written
from lodestar.llm.sampling import bounded_sample
from lodestar.llm.wordhash import SPACES

#: Rows of each label that the model is fitted on, at most about; features that it is fitted on, those in most of the rows; rows that must hold one.
ROWS_PER_LABEL, COLUMNS, LEAST_ROWS = 4000, 1 << 18, 3
#: Bytes of text that are hashed at a time.
BLOCK = 1 << 20
#: The threshold of `predicted`.
THRESHOLD = 0.7
STEMS = (4, 5, 6, 7, 8)
#: FTRL: learning rate, its smoothing, both penalties, passes over the rows; chosen on folds of the training rows of the tables at hand.
ALPHA, BETA, L1, L2, EPOCHS = 2.0, 1.0, 4.0, 0.2, 6

SEPARATORS = SPACES + bytes(b for b in range(33, 127) if not chr(b).isalnum())
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


class Features:
    """32-bit hashes of the features of texts. A run of bytes c has the hash sum(code[c_i] * base ** i) modulo 2 ** 64, mixed."""

    def __init__(self):
        self.separator = np.zeros(256, bool)
        self.separator[list(SEPARATORS)] = True
        self.code = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.code[self.separator] = 0
        self.powers = self.inverse = np.empty(0, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            size = 1 << (n - 1).bit_length()
            series = lambda base: np.cumprod(np.r_[np.uint64(1), np.full(size - 1, base, np.uint64)])
            self.powers, self.inverse = series(_M1), series(np.uint64(pow(int(_M1), -1, 2**64)))

    def _words(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and sums of the runs of bytes between separators."""
        edge = np.diff(np.r_[False, ~self.separator[b], False].view(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self._grow(max(len(b), STEMS[-1]))
        total = np.r_[np.uint64(0), np.cumsum(self.code[b] * self.powers[: len(b)])]
        return starts, ends, (total[ends] - total[starts]) * self.inverse[starts]

    def _stems(self, joined: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each size of STEMS the places of the longer words, and the sums of their beginnings."""
        longer, stem, done = np.arange(len(starts)), np.zeros(len(starts), np.uint64), 0
        for n in STEMS:
            more = np.flatnonzero(sizes[longer] > n)
            longer, stem = longer[more], stem[more]
            for i in range(done, n):
                stem += self.code[joined[starts[longer] + i]] * self.powers[i]
            done = n
            yield longer, stem

    def of_texts(self, texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The features of all texts, in parts of BLOCK bytes: text numbers and hashes. A word that goes on in the next part, however long, is finished there, so that
        memory beside the texts does not grow with them; the last three words before a part meet its first, so that no pair is missed."""
        joined = np.frombuffer(b"\n".join(t or b"" for t in texts), np.uint8)
        begin = np.r_[0, np.cumsum([len(t or b"") + 1 for t in texts])][:-1]
        short = lambda h: (h >> np.uint64(32)).astype(np.uint32)
        open_at, open_sum = np.empty(0, np.int64), np.empty(0, np.uint64)  # the word that goes on, if any
        of_before, before = np.empty(0, np.int64), np.empty(0, np.uint64)
        for at in range(0, len(joined), BLOCK):
            b = joined[at : at + BLOCK]
            starts, ends, sums = self._words(b)
            starts, ends = starts + at, ends + at
            if len(open_at) and not self.separator[b[0]]:
                starts[:1], sums[:1] = open_at, open_sum + sums[:1] * np.uint64(pow(int(_M1), at - int(open_at[0]), 2**64))
            elif len(open_at):
                starts, ends, sums = np.r_[open_at, starts], np.r_[at, ends], np.r_[open_sum, sums]
            whole = len(starts) - int(at + BLOCK < len(joined) and not self.separator[b[-1]])
            open_at, open_sum = starts[whole:], sums[whole:]
            starts, ends, sums = starts[:whole], ends[:whole], sums[:whole]
            if not whole:
                continue
            of, words = np.searchsorted(begin, starts, side="right") - 1, _mixed(sums)
            yield of, short(words)
            for n, (longer, stem) in zip(STEMS, self._stems(joined, starts, ends - starts), strict=True):
                yield of[longer], short(_mixed(_mixed(stem) + np.uint64(n)))
            of, words = np.r_[of_before, of], np.r_[before, words]
            for gap in (1, 2, 3):
                same = np.flatnonzero(of[:-gap] == of[gap:])
                yield of[same], short(_mixed(words[same] * _M1 + words[same + gap] * _M2 + np.uint64(gap)))
            of_before, before = of[-3:], words[-3:]


def distinct(parts: Iterable[np.ndarray], kind: type) -> np.ndarray:
    """The different values of all parts, sorted; what comes twice is dropped on the way."""
    held, new, n = np.empty(0, kind), [], 0
    for part in parts:
        new.append(part)
        n += len(part)
        if n > max(BLOCK, len(held)):
            held, new, n = np.unique(np.concatenate([held, *new])), [], 0
    return np.unique(np.concatenate([held, *new]))


class ToxicityModel:
    """Hashes of the features that count, sorted, and their weights. Texts with none of them have the score of the bias."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bias: float):
        self.hashes, self.weights, self.bias = hashes, weights, bias

    def margins(self, features: Features, texts: list[bytes | None], likely: np.ndarray) -> np.ndarray:
        """likely: for each value of the low 22 bits whether a hash of the model has it."""
        out = np.full(len(texts), self.bias)

        def cells() -> Iterator[np.ndarray]:
            for of, h in features.of_texts(texts):
                maybe = np.flatnonzero(likely[h & np.uint32((1 << 22) - 1)])
                place = np.searchsorted(self.hashes, h[maybe])
                there = self.hashes[np.minimum(place, len(self.hashes) - 1)] == h[maybe]
                yield of[maybe[there]] * len(self.hashes) + place[there]

        if len(self.hashes):
            held = distinct(cells(), np.int64)
            np.add.at(out, held // len(self.hashes), self.weights[held % len(self.hashes)])
        return out

    def likely(self) -> np.ndarray:
        out = np.zeros(1 << 22, bool)
        out[self.hashes & np.uint32((1 << 22) - 1)] = True
        return out


class Ftrl:
    """FTRL-proximal: per coordinate a sum of squared gradients, which sets its rate, and z, from which its weight follows: 0 as long as |z| <= l1."""

    def __init__(self, n: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(n + 1), np.zeros(n + 1)  # the last is the bias, without penalties

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, l1 = self.z[at], np.where(at < len(self.z) - 1, self.l1, 0.0)
        l2 = np.where(at < len(self.z) - 1, self.l2, 0.0)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + l2))

    def step(self, held: np.ndarray, y: float) -> None:
        at = np.r_[held, len(self.z) - 1]
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def fit_ftrl(rows: list[np.ndarray], y: np.ndarray, n: int, epochs: int = EPOCHS, **settings) -> Ftrl:
    own = Ftrl(n, **settings)
    for _ in range(epochs):
        for held, label in zip(rows, y.tolist(), strict=True):
            own.step(held, label)
    return own


def fit_toxicity_model(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", label_key: str = "doc_id", rows_per_label: int = ROWS_PER_LABEL, columns: int = COLUMNS, least_rows: int = LEAST_ROWS, **settings) -> ToxicityModel | None:
    """Fitted on a sample of the labelled documents, about rows_per_label of each label, in the order of a hash.

    The sampled ids are broadcast to find their texts; their features are counted by Spark, and the `columns` features that most rows hold (at least `least_rows`) are
    kept. Only the numbers of the kept features come to the driver. None unless both labels occur.
    """
    usable = labels.select(F.col(label_key).alias("key"), F.col(label).cast("int").alias("label")).where("key is not null and label in (0, 1)")
    sampled = bounded_sample(usable, "label", "key", rows_per_label, seed=12)
    known = small_batches(docs).select(F.col(key).alias("key"), F.col(text).alias("text")).where("text <> ''")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            texts = byte_values(batch, "text")
            for i, t in enumerate(texts):
                held = distinct((h for _, h in features.of_texts([t])), np.uint32)
                yield pa.RecordBatch.from_arrays([batch.column("label").slice(i, 1), batch.column("_hash").slice(i, 1), pa.array([held.astype(np.int64)], pa.list_(pa.int64()))], ["label", "_hash", "held"])

    lowered = known.join(F.broadcast(sampled.select("key", "label", "_hash")), "key").select("label", "_hash", F.lower("text").alias("text"))
    rows = written(lowered.mapInArrow(hashed, "label int, _hash long, held array<long>"), "hashed")
    counted = rows.select(F.explode("held").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_rows)
    kept = np.sort(counted.orderBy(F.desc("n"), "h").select("h").limit(columns).toArrow().column("h").to_numpy())
    shared = rows.sparkSession.sparkContext.broadcast(kept)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            out = []
            for held in batch.column("held"):
                h = held.values.to_numpy()
                place = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
                out.append((place[known[place] == h] if len(known) else place[:0]).astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("_hash"), pa.array(out, pa.binary())], ["label", "_hash", "held"])

    found = rows.mapInArrow(numbered, "label int, _hash long, held binary").orderBy("_hash", "label", "held").toArrow()
    drop_written(rows)
    y = found.column("label").to_numpy().astype(float)
    if len(set(y.tolist())) < 2:
        return None
    own = fit_ftrl([np.frombuffer(held.as_buffer(), "<i4") for held in found.column("held")], y, len(kept), **settings)
    weights = own.weights(np.arange(len(kept)))
    used = np.flatnonzero(weights)
    bias = float(own.weights(np.array([len(kept)]))[0])
    return ToxicityModel(kept[used].astype(np.uint32), weights[used], bias)


def score_toxicity(df: DataFrame, model: ToxicityModel | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df with score (0 to 1) and predicted (1 if score >= threshold, else 0); older columns with these names are replaced.

    Null and empty texts and those without a word have the score of a text that nothing is known of. Without a model every score is 0.5. Whole texts are used;
    repeated rows and null ids are rows like others; an empty table gives an empty result. No shuffle.
    """
    source = small_batches(df).drop("score", "predicted").withColumn("_lowered", F.lower(F.col(text)))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, features = shared.value, Features()
        likely = own.likely() if own else None
        for batch in batches:
            texts = byte_values(batch, "_lowered")
            score = np.full(len(texts), 0.5)
            for start, end in in_blocks(texts, BLOCK // 2) if own else ():
                score[start:end] = 1 / (1 + np.exp(-np.clip(own.margins(features, texts[start:end], likely), -30, 30)))
            rest = batch.drop_columns(["_lowered"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*rest.schema.names, "score", "predicted"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "_lowered")
    return source.mapInArrow(scored, f"{kinds}, score double, predicted int")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(id_remainder(F.col("doc_id"), 3) != 1)
    model = fit_toxicity_model(docs, labels)
    return score_toxicity(docs.select("doc_id", (id_remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "text"), model).select("doc_id", "held_out", "score", "predicted")
