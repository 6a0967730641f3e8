"""Benchmark decontamination by CGK walks, bit sampling and exact edit distance.

A passage leaks if a document has a stretch of words within `max_ratio` of the passage's words in edit distance. CGK's random walk maps
edit distance to Hamming distance: step j emits the word under a pointer, and a random bit of (j, word) says whether the pointer
moves on, so that two walks fall back into step after an edit. Every word of a document lies in windows as long as a passage, one for
each place that the word can have in it. A repetition draws a walk, three of its steps, and for each passage the place where the walk
begins, among the rarer words of the passage. Windows that agree with a passage in all three steps are candidates, whose exact
distance Myers' bit-parallel algorithm then computes.

Passages are put into classes by length. A class walks half as many steps as its shortest passage has words: the pointer cannot leave the
passage in so many steps, so a walk never depends on what follows the window. Words outside the benchmark's vocabulary are one
symbol, since none of them equals a word of a passage. The first step is step 0, so that most windows end with one look-up. Passages so short that
no edit is allowed are looked up as they are, by the hash of their words.

Candidates are verified many at a time: the distance of passages of up to 64 words by Myers' algorithm over arrays of 64-bit words, a candidate
in each; longer ones must hold as many words of the passage as the allowed edits leave. Only what passes is looked at one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import byte_values, in_blocks, small_batches
from lodestar.llm.wordhash import SPACES, WordHasher

#: Shortest passages of the classes that are sampled; shorter ones are looked up whole.
CLASSES = (5, 8, 16, 32)
SAMPLES = 3
#: tests/llm measure the recall that these give: over 99 % with 10 % of the words edited, over 95 % with 20 %.
REPETITIONS = 14
MAX_RATIO = 0.2
#: Passages are held by the driver and the executors in blocks of at most so many rows and bytes; each block is a pass over the documents. The index
#: takes about 24 bytes for each row and repetition and 4 for each distinct word and repetition: 40 MB and, if no word came twice, 100 MB.
BLOCK_ROWS, BLOCK_BYTES = 100_000, 8 << 20
#: Cells of words that are looked at together when candidates are counted.
CELLS = 1 << 20

SEPARATORS = SPACES + bytes(c for c in range(33, 127) if not chr(c).isalnum())


def edit_distance_within(pattern_bits: dict[int, int], n: int, text: list[int]) -> tuple[int, int]:
    """The least edit distance of a pattern of n symbols to any stretch of text, and where the first such stretch ends."""
    mask, top = (1 << n) - 1, 1 << (n - 1)
    vp, vn, score, best, at = mask, 0, n, n, 0
    for i, symbol in enumerate(text, 1):
        eq = pattern_bits.get(symbol, 0)
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & mask
        hp, hn = vn | ~(d0 | vp) & mask, d0 & vp
        score += bool(hp & top) - bool(hn & top)
        hp, hn = (hp << 1) & mask, (hn << 1) & mask
        vp, vn = hn | ~(d0 | hp) & mask, d0 & hp
        if score < best:
            best, at = score, i
    return best, at


def bits_of(symbols) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, s in enumerate(symbols):
        out[s] = out.get(s, 0) | 1 << i
    return out


def _keys(symbols: np.ndarray, n: int) -> np.ndarray:
    """A number for each row of symbols below n; rows that differ may share one only if n ** columns exceeds 2 ** 64."""
    key = np.zeros(len(symbols), np.uint64)
    for s in range(symbols.shape[1]):
        key = key * np.uint64(n) + symbols[:, s].astype(np.uint64)
    return key


class PassageIndex:
    """Sampled walks of passages, to be looked up by the windows of documents."""

    def __init__(self, passages: list[tuple[int, bytes]], max_ratio: float, repetitions: int, seed: int = 11):
        hasher = WordHasher(SEPARATORS)
        hashed, bounds = hasher.hashes([t for _, t in passages])
        self.vocabulary = np.unique(hashed)
        ids = (np.searchsorted(self.vocabulary, hashed) + 1).astype(np.int32)  # 0: any other word
        self.n = len(self.vocabulary) + 1
        self.passages = [(item, ids[bounds[i] : bounds[i + 1]]) for i, (item, _) in enumerate(passages) if bounds[i + 1] > bounds[i]]
        self.most = np.array([int(len(w) * max_ratio) for _, w in self.passages], np.int64)
        self.sizes = np.array([len(w) for _, w in self.passages], np.int64)
        # (passage, word) pairs, and for passages of up to 64 words the places of the word as bits
        pairs = np.concatenate([i * self.n + w.astype(np.int64) for i, (_, w) in enumerate(self.passages)]) if self.passages else np.empty(0, np.int64)
        self.held, pair = np.unique(pairs, return_inverse=True)
        place = np.concatenate([np.arange(len(w)) for _, w in self.passages]) if self.passages else np.empty(0, np.int64)
        self.bits = np.zeros(len(self.held), np.uint64)
        np.bitwise_or.at(self.bits, pair[place < 64], np.uint64(1) << place[place < 64].astype(np.uint64))
        counts = np.bincount(ids, minlength=self.n)
        self.whole = self._whole_passages()
        classes = [(max(SAMPLES, low // 2), [i for i, (_, w) in enumerate(self.passages) if low <= len(w) < high]) for low, high in zip(CLASSES, (*CLASSES[1:], 1 << 62), strict=True)]
        self.depth = max(depth for depth, _ in classes)
        rng = np.random.default_rng(seed)
        self.repetitions = []
        for _ in range(repetitions if self.passages else 0):
            moves = rng.integers(0, 1 << 16, self.n, np.uint16)  # bit j: whether the pointer moves on at step j
            known = np.zeros(self.n, np.uint16)  # bit 3 * class + s: whether the class has a walk with this word at sample s
            own = []
            for number, (depth, members) in enumerate(classes):
                if not members:
                    continue
                cut = 1 + (depth - 1) // 2
                steps = [0, int(rng.integers(1, cut + 1 if cut == 1 else cut)), int(rng.integers(max(cut, 2), depth))]
                offsets = []
                for i in members:
                    places = self.passages[i][1][: len(self.passages[i][1]) - depth + 1]
                    rarest = np.argsort(counts[places], kind="stable")[: max(3, len(places) // 2)]
                    offsets.append(int(rarest[rng.integers(len(rarest))]))
                walks = np.array([self._walk(self.passages[i][1][o : o + depth], moves, depth)[steps] for i, o in zip(members, offsets, strict=True)])
                order = np.lexsort(walks.T[::-1])
                keys = _keys(walks[order], self.n)
                for s in range(SAMPLES):
                    known[walks[:, s]] |= np.uint16(1 << (SAMPLES * number + s))
                first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
                own.append((number, steps, keys[first], np.r_[first, len(keys)].astype(np.int32), np.array(members, np.int32)[order], np.array(offsets, np.int32)[order]))
            self.repetitions.append((moves, known, own))

    def _whole_passages(self) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each length of passages that are looked up whole: the length, the sorted keys, where each key's passages begin, and the passages."""
        out = []
        for n in range(1, CLASSES[0]):
            own = np.flatnonzero(self.sizes == n)
            if len(own):
                keys = _keys(np.array([self.passages[i][1] for i in own]), self.n)
                order = np.argsort(keys, kind="stable")
                first = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]])
                out.append((n, keys[order][first], np.r_[first, len(own)], own[order]))
        return out

    @staticmethod
    def _walk(words: np.ndarray, moves: np.ndarray, depth: int) -> np.ndarray:
        out, at = np.empty(depth, np.int64), 0
        for j in range(depth):
            out[j] = words[at]
            at += int(moves[words[at]]) >> j & 1
        return out

    def symbols(self, hashed: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(hashed), np.int32)
        at = np.minimum(np.searchsorted(self.vocabulary, hashed), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashed, at + 1, 0).astype(np.int32)

    @staticmethod
    def _matches(key: np.ndarray, keys: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the keys looked up, those that are there: the number of the look-up and the place of each entry of the key."""
        k = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = np.flatnonzero(keys[k] == key)
        first, n = firsts[k[hit]].astype(np.int64), (firsts[k[hit] + 1] - firsts[k[hit]]).astype(np.int64)
        return np.repeat(hit, n), np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(hit) else np.empty(0, np.int64)

    def candidates(self, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Distinct (passage, document, start of the window, where the walk began), in order, that hold enough words of the passage; a start may lie
        before the document."""
        padded = np.r_[words, np.zeros(self.depth + 1, np.int32)]
        found = [np.empty((0, 3), np.int64)]
        for moves, known, classes in self.repetitions:
            marks = known[words]
            for number, steps, keys, firsts, which, offsets in classes:
                begin = np.flatnonzero(marks & (1 << (SAMPLES * number)))
                at, sampled = begin, []
                for j in range(steps[-1] + 1):
                    symbol = padded[at]
                    if j in steps:
                        sampled.append(symbol)
                        kept = np.flatnonzero(known[symbol] & (1 << (SAMPLES * number + len(sampled) - 1)))
                        begin, at, symbol, sampled = begin[kept], at[kept], symbol[kept], [s[kept] for s in sampled]
                    at = at + (moves[symbol] >> j & 1)
                if len(begin):
                    hit, entry = self._matches(_keys(np.stack(sampled, axis=1), self.n), keys, firsts)
                    found.append(np.stack([which[entry].astype(np.int64), begin[hit] - offsets[entry], begin[hit]], axis=1))
        rows = self._distinct(np.concatenate(found), len(words))
        rows = np.insert(rows, 1, np.searchsorted(bounds, rows[:, 2], "right") - 1, axis=1)  # the document of the word where the walk began
        rows = rows[:, [0, 1, 3, 2]]
        return rows[self._near(words, bounds, rows)]

    def _distinct(self, rows: np.ndarray, n: int) -> np.ndarray:
        """Rows of (passage, start, begin), each once and in order, with begin before start; by one number for each row where that is large enough."""
        longest = int(self.sizes.max(initial=1))
        if len(self.passages) * (n + longest) * (longest + 1) >= 1 << 62:
            return np.unique(rows, axis=0)[:, [0, 2, 1]]
        key = np.unique((rows[:, 0] * (n + longest) + rows[:, 1] + longest) * (longest + 1) + rows[:, 2] - rows[:, 1])
        key, offset = np.divmod(key, longest + 1)
        passage, start = np.divmod(key, n + longest)
        return np.stack([passage, start - longest + offset, start - longest], axis=1)

    def _near(self, words: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Whether the stretch around each candidate may hold the passage within the allowed edits: certainly so for passages of up to 64 words."""
        out = np.zeros(len(rows), bool)
        most, size = self.most[rows[:, 0]], self.sizes[rows[:, 0]]
        low = np.maximum(bounds[rows[:, 1]], rows[:, 2] - most)
        length = np.maximum(np.minimum(bounds[rows[:, 1] + 1], rows[:, 2] + size + most) - low, 0)
        order, i = np.argsort(length, kind="stable"), 0
        while i < len(order):  # candidates of like length together, so that cells are bounded
            own = order[i : i + 16384]
            own = own[: max(1, CELLS // max(1, int(length[own[-1]])))]
            i += len(own)
            passage, left = rows[own, 0], size[own] - most[own]
            there, score, best = np.zeros(len(own), np.int64), size[own].copy(), size[own].copy()
            top = np.uint64(1) << np.minimum(size[own] - 1, 63).astype(np.uint64)
            vp, vn = np.full(len(own), np.iinfo(np.uint64).max), np.zeros(len(own), np.uint64)
            for j in range(int(length[own[-1]])):
                alive = j < length[own]
                symbol = words[np.minimum(low[own] + j, len(words) - 1)]
                key = passage * self.n + symbol
                at = np.minimum(np.searchsorted(self.held, key), len(self.held) - 1)
                same = alive & (self.held[at] == key) & (symbol > 0)
                there += same
                eq = np.where(same, self.bits[at], np.uint64(0))
                d0 = (((eq & vp) + vp) ^ vp) | eq | vn
                hp, hn = vn | ~(d0 | vp), d0 & vp
                score += ((hp & top) != 0).astype(np.int64) - ((hn & top) != 0)
                hp, hn = hp << np.uint64(1), hn << np.uint64(1)
                vp, vn = hn | ~(d0 | hp), d0 & hp
                best = np.where(alive, np.minimum(best, score), best)
            out[own] = np.where(size[own] <= 64, best <= most[own], there >= left)
        return out

    def leaks(self, words: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(document, passage, first word, number of words, edits) of every stretch, for documents that lie from bounds[i] to bounds[i + 1]. A passage's
        stretches in a document do not overlap."""
        out, last, covered, bits, back = self._whole(words, bounds), None, -1, {}, {}
        for passage, doc, start, seen in self.candidates(words, bounds).tolist():
            if (passage, doc) != last:
                last, covered = (passage, doc), -1
            if seen < covered:
                continue
            if passage not in bits:
                pattern = self.passages[passage][1]
                bits = {passage: bits_of(pattern.tolist())}
                back = {passage: bits_of(pattern[::-1].tolist())}
            n, most = int(self.sizes[passage]), int(self.most[passage])
            low = max(int(bounds[doc]), covered, start - most)
            stretch = words[low : min(int(bounds[doc + 1]), start + n + most)].tolist()
            edits, end = edit_distance_within(bits[passage], n, stretch)
            if edits <= most:
                _, size = edit_distance_within(back[passage], n, stretch[:end][::-1])
                out.append((doc, passage, low + end - size - int(bounds[doc]), size, edits))
                covered = low + end
        return out

    def _whole(self, words: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """The stretches that equal a passage of which no word may be edited."""
        out = []
        for n, keys, firsts, which in self.whole:
            if len(words) < n:
                continue
            begin = np.arange(len(words) - n + 1)
            begin = begin[np.logical_and.reduce([words[begin + i] > 0 for i in range(n)])]
            doc = np.searchsorted(bounds, begin, "right") - 1
            inside = begin + n <= bounds[doc + 1]
            begin, doc = begin[inside], doc[inside]
            hit, entry = self._matches(_keys(np.stack([words[begin + i] for i in range(n)], axis=1), self.n), keys, firsts)
            ends: dict[tuple[int, int], int] = {}
            for p, d, b in zip(which[entry].tolist(), doc[hit].tolist(), begin[hit].tolist(), strict=True):
                if b >= ends.get((p, d), -1) and (words[b : b + n] == self.passages[p][1]).all():
                    ends[p, d] = b + n
                    out.append((d, p, b - int(bounds[d]), n, 0))
        return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", max_ratio: float = MAX_RATIO, repetitions: int = REPETITIONS, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each stretch of a document that repeats a passage: doc_id, item_id, first_word (from 0), n_words, edits, item_words.

    Words are lower-cased and parted by white space and ASCII punctuation; edits insert, drop or replace one word. A passage of n words
    leaks with at most int(max_ratio * n) edits, so that one of under five words leaks as it is or not at all. Passages without a word, null ones and
    null texts match nothing; rows that repeat an item or a document are reported each; a null id is passed on. Extra columns are ignored,
    whatever their names. Documents are read whole, with no shuffle: only the passages travel, in blocks of a checked size. Empty tables
    give an empty result.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_key).cast("long").alias("item"), F.lower(item_text).alias("passage")).where("passage is not null")
    n, size = items.agg(F.count(F.lit(1)), F.sum(F.octet_length("passage"))).first()
    blocks = max(1, -(-n // block_rows), -(-(size or 0) // block_bytes))
    source = small_batches(docs).select(F.col(key).cast("long").alias("doc_id"), F.lower(text).alias("text"))
    out = None
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item", "passage"), F.lit(blocks)) == block) if blocks > 1 else items
        index = spark.sparkContext.broadcast(PassageIndex([(r.item, r.passage.encode()) for r in part.collect()], max_ratio, repetitions))

        def scanned(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            hasher, own = WordHasher(SEPARATORS), index.value
            for batch in batches:
                texts = byte_values(batch, "text")
                for start, end in in_blocks(texts, 1 << 20):
                    hashed, bounds = hasher.hashes(texts[start:end])
                    found = own.leaks(own.symbols(hashed), bounds) if own.passages else []
                    if found:
                        doc, passage, first, n_words, edits = zip(*found, strict=True)
                        items = [own.passages[p][0] for p in passage]
                        yield pa.RecordBatch.from_arrays(
                            [batch.column("doc_id").take(pa.array([start + d for d in doc])), *(pa.array(x, pa.int64()) for x in (items, first, n_words, edits, own.sizes[list(passage)]))],
                            ["doc_id", "item_id", "first_word", "n_words", "edits", "item_words"],
                        )

        found = source.mapInArrow(scanned, "doc_id long, item_id long, first_word long, n_words long, edits long, item_words long")
        out = found if out is None else out.union(found)
    return out


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
