"""64-bit hashes of all words of a block of texts, without a Python object for each word."""

from __future__ import annotations

import numpy as np

#: The six ASCII separators of words.
SPACES = b" \t\n\x0b\x0c\r"
_CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15


class WordHasher:
    """Hashes the words of texts, which `separators` (bytes) part. A word of bytes c has the hash sum(code[c_i] * base ** i) modulo 2 ** 64, mixed."""

    def __init__(self, separators: bytes = SPACES):
        self.is_separator = np.zeros(256, bool)
        self.is_separator[list(separators)] = True
        self.code = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.code[self.is_separator] = 0
        self.powers = self.inverse = np.empty(0, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            size = 1 << (n - 1).bit_length()
            series = lambda base: np.cumprod(np.r_[np.uint64(1), np.full(size - 1, base, np.uint64)])
            self.powers, self.inverse = series(np.uint64(_BASE)), series(np.uint64(pow(_BASE, -1, 2**64)))

    def _chunk(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the words of bytes that no word overlaps at either end."""
        inside = ~self.is_separator[b]
        edge = np.diff(np.r_[False, inside, False].view(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self._grow(len(b))
        total = np.cumsum(self.code[b] * self.powers[: len(b)])
        before = np.where(starts > 0, total[starts - 1], np.uint64(0)) if len(starts) else np.empty(0, np.uint64)
        h = (total[ends - 1] - before) * self.inverse[starts] if len(starts) else before
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x94D049BB133111EB)
        return starts, h ^ (h >> np.uint64(29))

    def hashes(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of all texts in a row, and bounds: text i has those from bounds[i] to bounds[i + 1]."""
        sizes = np.array([len(t) if t else 0 for t in texts], np.int64)
        joined = np.frombuffer(b"\n".join(t or b"" for t in texts), np.uint8)  # a line break is a separator everywhere
        starts, found, at = [], [], 0
        while at < len(joined):
            end = min(at + _CHUNK, len(joined))
            if end < len(joined):  # to the last separator; further on where there is none
                cut = np.flatnonzero(self.is_separator[joined[at:end]])
                while not len(cut) and end < len(joined):
                    more = np.flatnonzero(self.is_separator[joined[end : end + _CHUNK]])
                    cut, end = (more[:1] + (end - at), end + _CHUNK)
                end = at + int(cut[-1]) + 1 if len(cut) else len(joined)
            s, h = self._chunk(joined[at:end])
            starts.append(s + at), found.append(h)
            at = end
        begin = np.r_[0, np.cumsum(sizes + 1)]
        where = np.concatenate(starts) if starts else np.empty(0, np.int64)
        return (np.concatenate(found) if found else np.empty(0, np.uint64)), np.searchsorted(where, begin)
