"""Language identification in two levels: first the family, then one-versus-one linear support vector machines within it.

A text is its distribution over hashed trigrams of UTF-8 bytes, with everything but letters as white space. One linear support vector
machine for each family (against all others) chooses the family; one for each pair of its languages votes on the language.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import id_remainder, in_blocks, small_batches
from lodestar.llm.sampling import bounded_sample

DIMENSIONS = 4096
#: Rows of each language that the machines are fitted on, at most about.
ROWS_PER_LANGUAGE = 400

# Families of languages by ISO 639-1 code. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"],
    "romance": ["ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "baltic": ["lt", "lv"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "ky", "tk", "tr", "uz"],
    "indo-iranian": ["bn", "fa", "gu", "hi", "ku", "mr", "ne", "pa", "ps", "sd", "ur"],
    "semitic": ["am", "ar", "he", "mt"],
    "dravidian": ["kn", "ml", "ta", "te"],
    "malayo-polynesian": ["id", "jv", "mg", "ms", "su", "tl"],
}
FAMILY_OF = {language: family for family, languages in FAMILIES.items() for language in languages}

_TO_SPACE = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def has_letter(c: Column) -> Column:
    """Whether a text has a character of Unicode's category L; digits, fractions, circled and Roman numerals are none."""
    return F.coalesce(c.rlike(r"\p{L}"), F.lit(False))


def trigram_rows(texts: list[str | None]) -> np.ndarray:
    """L2-normalised square roots of trigram shares, one row for each text; zeros for texts without three bytes."""
    cleaned = [b"  " + (t or "").lower().encode("utf-8", "surrogatepass").translate(_TO_SPACE) + b"  " for t in texts]
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    ends = np.cumsum([len(c) for c in cleaned])
    b = np.frombuffer(b"".join(cleaned), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return out
    h = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA6B) + b[2:] * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(15)
    h = (h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - 12)
    blank = (b[:-2] == 32) & (b[1:-1] == 32) & (b[2:] == 32)
    h = np.where(blank, DIMENSIONS, h)  # runs of white space do not count
    start = 0
    for i, end in enumerate(ends):
        out[i] = np.bincount(h[start : max(start, end - 2)], minlength=DIMENSIONS + 1)[:DIMENSIONS]
        start = end
    np.sqrt(out, out=out)
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
    return out


def fit_machine(x: np.ndarray, positive: np.ndarray, ridge: float = 1e-3, rounds: int = 150) -> tuple[np.ndarray, float]:
    """A linear support vector machine of squared hinge loss, classes weighted alike, by accelerated gradient steps."""
    y = np.where(positive, 1.0, -1.0).astype(np.float32)
    c = np.where(positive, 0.5 / max(1, positive.sum()), 0.5 / max(1, (~positive).sum())).astype(np.float32)
    z = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
    w = look = np.zeros(z.shape[1], np.float32)
    step = 1.0 / (2 * 2.0 + ridge)  # rows have a squared norm of 2
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (z @ look))
        gradient = -2 * ((c * slack * y) @ z) + ridge * np.r_[look[:-1], np.float32(0)]
        after = look - step * gradient
        look = after + (k / (k + 3)) * (after - w)
        w = after
    return w[:-1].astype(np.float32), float(w[-1])


class LanguageModel:
    """Machines for families and for pairs of languages within each."""

    def __init__(self, x: np.ndarray, languages: list[str]):
        self.languages = sorted(set(languages))
        self.family_of = {v: FAMILY_OF.get(v, v) for v in self.languages}
        self.families = sorted(set(self.family_of.values()))
        own = np.array(languages)
        family = np.array([self.family_of[v] for v in languages])
        machines = [fit_machine(x, family == f) for f in self.families] if len(self.families) > 1 else []
        self.pairs = [(a, b) for f in self.families for a, b in combinations([v for v in self.languages if self.family_of[v] == f], 2)]
        for a, b in self.pairs:
            rows = (own == a) | (own == b)
            machines.append(fit_machine(x[rows], own[rows] == a))
        self.weights = np.array([w for w, _ in machines], np.float32).reshape(-1, DIMENSIONS).T
        self.biases = np.array([b for _, b in machines], np.float32)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The language of each row, and a score from 0 to 1: the squashed margins of the family and of the votes that chose it."""
        margins = x @ self.weights + self.biases
        n = len(self.families) if len(self.families) > 1 else 0
        family = margins[:, :n].argmax(axis=1) if n else np.zeros(len(x), int)
        if n:
            ordered = np.sort(margins[:, :n], axis=1)
            score = 1 / (1 + np.exp(-2 * (ordered[:, -1] - ordered[:, -2])))
        else:
            score = np.ones(len(x))
        out: list[str] = [""] * len(x)
        for f, name in enumerate(self.families):
            rows = np.flatnonzero(family == f)
            own = [v for v in self.languages if self.family_of[v] == name]
            votes, sums = np.zeros((len(rows), len(own))), np.zeros((len(rows), len(own)))
            for k, (a, b) in enumerate(self.pairs):
                if self.family_of[a] == name:
                    m = margins[rows, n + k]
                    i, j = own.index(a), own.index(b)
                    votes[:, i] += m > 0
                    votes[:, j] += m <= 0
                    sums[:, i] += m
                    sums[:, j] -= m
            best = (votes + np.tanh(sums) / 3).argmax(axis=1) if len(own) > 1 else np.zeros(len(rows), int)
            if len(own) > 1:
                score[rows] *= 1 / (1 + np.exp(-4 * sums[np.arange(len(rows)), best] / (len(own) - 1)))
            for r, k in zip(rows, best, strict=True):
                out[r] = own[k]
        return out, score


def fit_language_model(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows_per_language: int = ROWS_PER_LANGUAGE) -> LanguageModel | None:
    """Fitted on a sample of df's rows with text and lang; the driver gets their trigram distributions, not their texts. None without rows."""
    labelled = small_batches(df).select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text")).where(has_letter(F.col("text")))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for start, end in in_blocks(texts, 1 << 20):
                x = trigram_rows(texts[start:end])
                yield pa.RecordBatch.from_arrays([batch.column("lang").slice(start, end - start), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "x"])

    sample = bounded_sample(labelled, "lang", "key", rows_per_language).select("lang", "text").mapInArrow(rows, "lang string, x binary").collect()
    if not sample:
        return None
    return LanguageModel(np.array([np.frombuffer(r.x, np.float32) for r in sample]), [r.lang for r in sample])


def identify_languages(df: DataFrame, model: LanguageModel | None, text: str = "text") -> DataFrame:
    """df with lang_pred and score. The columns are put at the end; of older columns with these names the new ones take the place.

    `und` with score 0: null texts, texts without a letter, and all texts where there is no model. Whole texts are used.
    Repeated rows and null ids are rows like others; an empty table gives an empty result. No shuffle.
    """
    source = small_batches(df).drop("lang_pred", "score").withColumn("_lettered", has_letter(F.col(text)))
    model = df.sparkSession.sparkContext.broadcast(model)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            texts, letters = batch.column(text).to_pylist(), batch.column("_lettered").to_pylist()
            batch = batch.drop_columns(["_lettered"])
            for start, end in in_blocks(texts, 1 << 20):
                part, lettered = texts[start:end], letters[start:end]
                found, scores = own.predict(trigram_rows(part)) if own else ([None] * len(part), np.zeros(len(part)))
                ok = [l and own is not None for l in lettered]
                rows = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array([v if o else "und" for v, o in zip(found, ok, strict=True)], pa.string()), pa.array([float(s) if o else 0.0 for s, o in zip(scores, ok, strict=True)], pa.float64())],
                    [*rows.schema.names, "lang_pred", "score"],
                )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "_lettered")
    return source.mapInArrow(predicted, f"{kinds}, lang_pred string, score double")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = id_remainder(F.col("doc_id"), 4) == 2
    model = fit_language_model(docs.where(~held_out))
    return identify_languages(docs.select("doc_id", held_out.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
