"""Media columns: AVI files of motion-JPEG frames.

Samples are 8-bit grey levels in frames of 64 x 16. Frames are lossless JPEG (ITU-T T.81, process 14: SOF3, predictor 1, one Huffman
table), so that what is stored comes back as it was. Each line is a restart interval: lines depend on nothing before them, and the codec
handles all lines of a block of files at once, one sample of each line per step.

The files are RIFF AVI: header list, an INFO list with the payload's length (the last frame is filled with zeros), the frames, and the
index idx1 that readers use to find them.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import byte_values, in_blocks, small_batches

WIDTH, HEIGHT, FPS = 64, 16, 25
FRAME = WIDTH * HEIGHT
#: Bytes of payload handled at once.
BLOCK = 1 << 20

# Codes of the categories 0 to 8 of a difference: (length, code), a canonical prefix code.
LENGTHS = [5, 5, 5, 4, 4, 3, 2, 2, 3]


def _canonical(lengths: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Counts for each length 1 to 16, symbols in order, and the code of each symbol."""
    order = sorted(range(len(lengths)), key=lambda s: (lengths[s], s))
    codes, code, last = [0] * len(lengths), 0, 0
    for s in order:
        code <<= lengths[s] - last
        codes[s], last = code, lengths[s]
        code += 1
    return [lengths.count(n) for n in range(1, 17)], order, codes


COUNTS, SYMBOLS, CODES = _canonical(LENGTHS)
JPEG_HEAD = b"".join((
    b"\xff\xd8",
    b"\xff\xc4", struct.pack(">HB", 19 + len(SYMBOLS), 0), bytes(COUNTS), bytes(SYMBOLS),
    b"\xff\xc3", struct.pack(">HBHHB", 11, 8, HEIGHT, WIDTH, 1), bytes((1, 0x11, 0)),
    b"\xff\xdd", struct.pack(">HH", 4, WIDTH),
    b"\xff\xda", struct.pack(">HB", 8, 1), bytes((1, 0, 1, 0, 0)),
))


def _difference_codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits and number of bits for each difference from -255 to 255, at difference + 255."""
    values, lengths = np.zeros(511, np.uint64), np.zeros(511, np.int32)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        values[d + 255] = CODES[size] << size | (d - (d < 0)) & ((1 << size) - 1)
        lengths[d + 255] = LENGTHS[size] + size
    return values, lengths


VALUES, BITS = _difference_codes()


def encode_lines(samples: np.ndarray) -> list[bytes]:
    """JPEG frames of samples, shaped (frames * HEIGHT, WIDTH)."""
    n = len(samples)
    columns = np.ascontiguousarray(samples.T).astype(np.int16)
    columns[1:] -= columns[:-1].copy()
    columns[0] -= 128
    columns += 255
    stride = WIDTH * int(BITS.max()) // 32 + 2
    words = np.zeros(n * stride, np.uint32)
    begin, at = np.arange(n) * stride, np.zeros(n, np.int32)
    for j in range(WIDTH):
        bits = BITS[columns[j]]
        wide = VALUES[columns[j]] << (64 - (at & 31) - bits).astype(np.uint64)
        word = begin + (at >> 5)
        words[word] |= (wide >> np.uint64(32)).astype(np.uint32)
        words[word + 1] |= wide.astype(np.uint32)
        at += bits
    line_bytes = (at + 7) // 8
    ends = np.cumsum(line_bytes)
    packed = words.byteswap().view(np.uint8).reshape(n, 4 * stride)[np.arange(4 * stride) < line_bytes[:, None]]
    packed[ends - 1] |= ((1 << (8 * line_bytes - at)) - 1).astype(np.uint8)  # ones fill the last byte
    # a zero follows each FF, and a restart marker each line but the last of a frame
    stuffed = packed == 255
    after = np.cumsum(stuffed)[ends - 1]  # zeros put in up to the end of each line
    marked = np.arange(n) % HEIGHT != HEIGHT - 1
    marks = np.cumsum(2 * marked) - 2 * marked
    inserted = np.insert(packed, np.flatnonzero(stuffed) + 1, 0)
    ending = ends + after + marks
    out = np.empty(len(inserted) + 2 * int(marked.sum()), np.uint8)
    keep = np.ones(len(out), bool)
    keep[ending[marked]] = keep[ending[marked] + 1] = False
    out[keep] = inserted
    out[ending[marked]] = 255
    out[ending[marked] + 1] = 0xD0 + (np.arange(n) % HEIGHT % 8)[marked]
    flat, cuts = out.tobytes(), np.r_[0, ending[HEIGHT - 1 :: HEIGHT]]
    return [JPEG_HEAD + flat[a:b] + b"\xff\xd9" for a, b in zip(cuts, cuts[1:], strict=False)]


def _scan(frame: bytes) -> tuple[bytes, tuple[int, int, int, tuple[int, ...], tuple[int, ...]]]:
    """The entropy-coded bytes of a frame, and (width, height, restart interval, code counts, symbols)."""
    if frame.startswith(JPEG_HEAD):
        return frame[len(JPEG_HEAD) : -2], (WIDTH, HEIGHT, WIDTH, tuple(COUNTS), tuple(SYMBOLS))
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    at, width, height, interval, counts, symbols = 2, 0, 0, 0, (), ()
    while True:
        marker, size = struct.unpack_from(">HH", frame, at)
        body = frame[at + 4 : at + 2 + size]
        if marker == 0xFFC4:
            counts, symbols = tuple(body[1:17]), tuple(body[17:])
        elif marker == 0xFFC3:
            precision, height, width, parts = struct.unpack_from(">BHHB", body)
            if (precision, parts) != (8, 1):
                raise ValueError("only 8-bit grey frames are read")
        elif marker == 0xFFDD:
            (interval,) = struct.unpack(">H", body)
        elif marker == 0xFFDA:
            if body[3] != 1 or interval != width:
                raise ValueError("only predictor 1 with a restart interval for each line is read")
            return frame[at + 2 + size : frame.rindex(b"\xff\xd9")], (width, height, interval, counts, symbols)
        elif marker >> 8 != 0xFF or 0xFFC0 <= marker <= 0xFFCF and marker != 0xFFC8:
            raise ValueError(f"frame of another kind: marker {marker:04x}")
        at += 2 + size


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """Samples of frames of one format, shaped (lines, width)."""
    scans = [_scan(f) for f in frames]
    if not scans:
        return np.empty((0, WIDTH), np.uint8)
    formats = {f for _, f in scans}
    if len(formats) > 1:
        raise ValueError("frames of several formats")
    width, height, _, counts, symbols = formats.pop()
    # a marker between frames too, then markers part lines everywhere
    raw = np.frombuffer(b"\xff\xd0".join(s for s, _ in scans), np.uint8)
    after_ff = np.r_[False, raw[:-1] == 255]
    marker = after_ff & (raw >= 0xD0) & (raw <= 0xD7)
    drop = marker | np.r_[marker[1:], False] | (after_ff & (raw == 0))
    clean = raw[~drop]
    starts = np.r_[0, (np.cumsum(~drop))[np.flatnonzero(marker)]]
    if len(starts) != len(scans) * height:
        raise ValueError("lines are missing")
    # all codes by their first 16 bits
    look_symbol, look_length, code, k = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32), 0, 0
    for length, count in enumerate(counts, 1):
        for _ in range(count):
            a = code << (16 - length)
            look_symbol[a : a + (1 << (16 - length))], look_length[a : a + (1 << (16 - length))] = symbols[k], length
            code, k = code + 1, k + 1
        code <<= 1
    padded = np.r_[clean, np.full(8, 255, np.uint8)].astype(np.uint32)
    words = (padded[:-3] << 24) | (padded[1:-2] << 16) | (padded[2:-1] << 8) | padded[3:]
    at = starts.astype(np.int64) * 8
    value = np.full(len(starts), 128, np.int32)
    out = np.empty((width, len(starts)), np.uint8)
    for j in range(width):
        window = words[at >> 3] << (at & 7).astype(np.uint32)
        top = window >> np.uint32(16)
        size, length = look_symbol[top], look_length[top]
        extra = ((window << length.astype(np.uint32)).astype(np.uint64) >> (32 - size).astype(np.uint64)).astype(np.int32)
        half = (1 << size) >> 1
        value = value + np.where(extra < half, extra - (1 << size) + 1, extra)
        out[j] = value
        at += length + size
    return out.T


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(frames: list[bytes], payload_bytes: int) -> bytes:
    largest = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, len(frames), 0, 1, largest, WIDTH, HEIGHT, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<10I4H", 0, 0, 0, 1, FPS, 0, len(frames), largest, 0xFFFFFFFF, FRAME, 0, 0, WIDTH, HEIGHT)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", b"payload bytes: %d\0" % payload_bytes))
    movi, index, at = [], [], 4
    for f in frames:
        movi.append(_chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(movi[-1])
    body = b"AVI " + head + info + _chunk(b"LIST", b"movi" + b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_avi(media: bytes) -> tuple[list[bytes], int, float]:
    """Frames by the index, payload length, and seconds a frame."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, movi, index, payload, seconds = 12, 0, b"", None, 1 / FPS
    while at + 8 <= len(media):
        name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        kind = media[at + 8 : at + 12] if name == b"LIST" else name
        if kind == b"hdrl":
            k = media.index(b"avih", at, at + 8 + size)
            seconds = int.from_bytes(media[k + 8 : k + 12], "little") / 1e6
        elif kind == b"INFO" and (m := re.search(rb"payload bytes: (\d+)", media[at : at + 8 + size])):
            payload = int(m[1])
        elif kind == b"movi":
            movi = at + 8
        elif kind == b"idx1":
            index = media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    frames = [media[movi + offset + 8 : movi + offset + 8 + size] for name, _, offset, size in struct.iter_unpack("<4sIII", index) if name == b"00dc"]
    return frames, payload if payload is not None else len(frames) * FRAME, seconds


def find_shots(frames: np.ndarray, bins: int = 16, window: int = 8, factor: float = 3.0, least: float = 0.25) -> list[int]:
    """First frames of shots, for frames shaped (frames, samples).

    A cut lies where the histogram differs from the last frame's by at least `least` of all samples and by more than the mean of up to
    `window` differences before it plus `factor` times their deviation.
    """
    if not len(frames):
        return []
    levels = (frames >> (8 - bins.bit_length() + 1)).astype(np.int64) + bins * np.arange(len(frames))[:, None]
    histograms = np.bincount(levels.ravel(), minlength=bins * len(frames)).reshape(len(frames), bins)
    change = np.abs(np.diff(histograms, axis=0)).sum(axis=1) / (2 * frames.shape[1])
    shots = [0]
    for i in np.flatnonzero(change >= least):
        before = change[max(0, i - window, shots[-1]) : i]
        if not len(before) or change[i] > before.mean() + factor * before.std():
            shots.append(int(i) + 1)
    return shots


def pad64(data: bytes) -> bytes:
    return data + b"\0" * (64 - len(data) % 64 if len(data) % 64 or not data else 0)


def encode_block(payloads: list[bytes]) -> list[bytes]:
    counts = [-(-len(p) // FRAME) for p in payloads]
    joined = b"".join(p + b"\0" * (n * FRAME - len(p)) for p, n in zip(payloads, counts, strict=True))
    frames, at, out = encode_lines(np.frombuffer(joined, np.uint8).reshape(-1, WIDTH)), 0, []
    for p, n in zip(payloads, counts, strict=True):
        out.append(write_avi(frames[at : at + n], len(p)))
        at += n
    return out


def decode_block(files: list[bytes]) -> list[tuple[bytes, np.ndarray, float]]:
    """Payload, frames (frames, samples) and seconds a frame of each file."""
    read = [read_avi(f) for f in files]
    samples = np.ascontiguousarray(decode_frames([f for frames, _, _ in read for f in frames])).reshape(-1, FRAME)
    out, at = [], 0
    for frames, size, seconds in read:
        own = samples[at : at + len(frames)]
        out.append((own.tobytes()[:size], own, seconds))
        at += len(frames)
    return out


def encode_media(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes and media: each text (null: empty), padded with zeros to a positive multiple of 64 bytes, as an AVI file.

    One row per input row, also for null and repeated keys; other columns are dropped, whatever their names; an empty table gives an empty result. A text is a cell of a row, so its file is
    too; beyond that, memory is bounded by BLOCK.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_values(batch, "text")
            for start, end in in_blocks(texts, BLOCK):
                own = [t or b"" for t in texts[start:end]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(start, end - start), pa.array(map(len, own), pa.int64()), pa.array(encode_block([pad64(t) for t in own]), pa.binary())], ["doc_id", "n_bytes", "media"]
                )

    return small_batches(df).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(encoded, "doc_id long, n_bytes long, media binary")


def _over_files(df: DataFrame, row: Callable, kinds: str, names: tuple[str, ...]) -> DataFrame:
    """The rows that row() makes of each file, with the other columns repeated; of older columns with the new names the new ones take the place. A null is no file."""
    df = df.drop(*names).where("media is not null")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = batch.column("media").to_pylist()
            kept = batch.drop_columns(["media"])
            for start, end in in_blocks(files, 2 * BLOCK):
                rows = [(i, *r) for i, (f, d) in enumerate(zip(files[start:end], decode_block(files[start:end]), strict=True), start) for r in row(f, *d)]
                if rows:
                    at, *columns = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([*kept.take(pa.array(at)).columns, *map(pa.array, columns)], [*kept.schema.names, *names])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "media")
    return df.mapInArrow(read, f"{own}, {kinds}")


def clip_rows(df: DataFrame) -> DataFrame:
    """A row for each shot of each file of the column `media`: clip (from 0), start_s, end_s, n_frames, mean_level; other columns are repeated.

    Null media have no row, repeated rows their own each; an empty table gives an empty result. Older columns with these names are replaced. A file that is not an AVI of
    this kind, or is cut short, is an error."""

    def clips(_, payload: bytes, frames: np.ndarray, seconds: float) -> list[tuple]:
        shots = [*find_shots(frames), len(frames)]
        return [(i, a * seconds, b * seconds, b - a, float(frames[a:b].mean())) for i, (a, b) in enumerate(zip(shots, shots[1:], strict=False))]

    return _over_files(df, clips, "clip long, start_s double, end_s double, n_frames long, mean_level double", ("clip", "start_s", "end_s", "n_frames", "mean_level"))


def media_features(df: DataFrame) -> DataFrame:
    """Per file of the column `media`: payload_bytes, payload_sha256, tail_crc32 (of the payload's last 64 bytes), media_bytes, media_sha256
    and feature: the number of frames, then each clip as start-end in seconds and its mean level. Equal files have equal values. Null
    media, repeats, empty tables, clashing names and broken files are as in clip_rows()."""

    def features(media: bytes, payload: bytes, frames: np.ndarray, seconds: float) -> list[tuple]:
        shots = [*find_shots(frames), len(frames)]
        clips = " ".join(f"{a * seconds:.2f}-{b * seconds:.2f}:{frames[a:b].mean():.2f}" for a, b in zip(shots, shots[1:], strict=False))
        return [(len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), f"{len(frames)} {clips}")]

    names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    return _over_files(df, features, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", names)


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(encode_media(spark.read.parquet(f"{sf_dir}/documents.parquet")))
