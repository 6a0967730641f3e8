"""WARC archives and the chunked record table.

Archives are WARC/1.1 files of one gzip member a record. They are written and read as streams. On both sides a record is a run of chunk rows: its id,
the chunk's number and at most CHUNK bytes. Writers get rows that the JVM cuts from the payload, and check its SHA-1 as the pieces pass; reading
gives one row for each piece, with the length and SHA-1 of the payload so far. Records are never put together, so a worker's memory does not grow
with their size; the last row of a record has the digest of it all.

Archives lie in a folder that driver and executors share. Each attempt of a task writes files of its own name; only those named by the
manifest, a written table, count, so that attempts that were lost leave nothing behind in the results.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import BROADCAST_IDS, drop_written, filesystem, shared_folder, small_batches, written

CHUNK = 1 << 20
#: A writer begins another archive after so many compressed bytes.
ARCHIVE_BYTES = 128 << 20
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _line(value: str) -> bytes:
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value).encode()


def record_head(record_id: str, url: str | None, length: int, refers_to: str | None, digest: str) -> bytes:
    """All of a record that comes before its payload. A revisit has no payload, only its digest and length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    lines = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"),
        b"WARC-Record-ID: <" + _line(record_id) + b">",
        b"WARC-Date: " + DATE.encode(),
        b"WARC-Payload-Digest: sha1:" + digest.encode(),
        b"WARC-Payload-Length: %d" % length,
        b"Content-Type: application/http;msgtype=response",
        b"Content-Length: %d" % (len(http) + (length if refers_to is None else 0)),
    ]
    if url is not None:
        lines.append(b"WARC-Target-URI: " + _line(url))
    if refers_to is not None:
        lines += [b"WARC-Refers-To: <" + _line(refers_to) + b">", b"WARC-Profile: " + REVISIT.encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + http


class ArchiveWriter:
    def __init__(self, folder: str, name: str):
        self.files, self.root = filesystem(folder)
        self.name, self.n, self.out, self.done = name, 0, None, []
        self.files.create_dir(self.root, recursive=True)

    def _open(self) -> None:
        self.path, self.records, self.size = f"{self.root}/{self.name}-{self.n:05d}.warc.gz", 0, 0
        self.out = self.files.open_output_stream(self.path, compression=None)
        self.n += 1
        info = b"software: lodestar\r\nformat: WARC File Format 1.1\r\n"
        self._member([b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:%s>\r\nWARC-Date: %s\r\nContent-Type: application/warc-fields\r\nContent-Length: %d\r\n\r\n" % (str(uuid.uuid5(uuid.NAMESPACE_URL, self.path)).encode(), DATE.encode(), len(info)), info, b"\r\n\r\n"])

    def _member(self, parts) -> None:
        self._begin()
        for part in parts:
            self._pack(part)
        self._end()

    def _begin(self) -> None:
        self.packer = zlib.compressobj(1, zlib.DEFLATED, 31)

    def _pack(self, part) -> None:
        if data := self.packer.compress(part):
            self.out.write(data)
            self.size += len(data)

    def _end(self) -> None:
        data = self.packer.flush()
        self.out.write(data)
        self.size += len(data)

    def begin(self, head: bytes, length: int, digest: str) -> None:
        """Starts a record, whose payload piece() then adds to. `length` and `digest` are those of the pieces to come."""
        if self.out is None:
            self._open()
        self._begin()
        self._pack(head)
        self.left, self.sha1, self.digest = length, hashlib.sha1(), digest

    def piece(self, data) -> None:
        self.left -= len(data)
        self.sha1.update(data)
        self._pack(data)

    def end(self) -> None:
        if self.left or (self.digest and base32_sha1(self.sha1.digest()) != self.digest):
            raise ValueError("a payload is not what its header says")
        self._pack(b"\r\n\r\n")
        self._end()
        self.records += 1
        if self.size >= ARCHIVE_BYTES:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.path, self.records, self.size))
            self.out = None


def chunk_rows(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The rows of a record, in order and one after the other: record_id, url (with the first chunk), digest, refers_to, bytes (of the whole payload),
    chunk_no and chunk. The JVM cuts the payload, so that no batch holds more than a few chunks of it; a revisit has one empty chunk."""
    own = records.select("record_id", "url", "digest", "refers_to", F.coalesce(F.col("payload").cast("binary"), F.lit(b"")).alias("payload"))
    full = F.col("refers_to").isNull()
    last = F.when(full, F.greatest(F.ceil(F.octet_length("payload") / chunk) - 1, F.lit(0))).otherwise(0).cast("int")
    cut = own.select("*", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    piece = F.when(full, F.substring("payload", F.col("chunk_no") * chunk + 1, F.lit(chunk))).otherwise(F.lit(b""))
    return cut.select("record_id", F.when(F.col("chunk_no") == 0, F.col("url")).alias("url"), "digest", "refers_to", F.octet_length("payload").cast("long").alias("bytes"), "chunk_no", piece.alias("chunk"))


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Writes a record for each row of record_id, url, payload (string or binary; null: empty), digest and refers_to (null: response), and
    returns the manifest, a written table of path, records and bytes. Other columns are ignored; without rows there is no archive."""

    def archived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        writer = ArchiveWriter(folder, f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}")
        begun = False
        for batch in batches:
            ids, urls, digests, refers, sizes, numbers, pieces = (batch.column(i) for i in range(7))
            for i, number in enumerate(numbers.to_pylist()):
                if number == 0:
                    if begun:
                        writer.end()
                    size, to, digest = sizes[i].as_py(), refers[i].as_py(), digests[i].as_py()
                    writer.begin(record_head(ids[i].as_py(), urls[i].as_py(), size, to, digest), size if to is None else 0, digest if to is None else "")
                    begun = True
                writer.piece(pieces[i].as_buffer())
        if begun:
            writer.end()
        writer.close()
        if writer.done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*writer.done, strict=True)], ["path", "records", "bytes"])

    return written(chunk_rows(small_batches(records)).mapInArrow(archived, "path string, records long, bytes long"), "manifest")


class RecordStream:
    """The bytes of an archive's records, one gzip member after the other, in bounded pieces."""

    def __init__(self, stream):
        self.stream, self.packed, self.plain, self.unpacker = stream, b"", bytearray(), None

    def fill(self) -> bool:
        """More plain bytes; False at the end."""
        while True:
            if self.unpacker is None or self.unpacker.eof:
                self.packed = self.unpacker.unused_data if self.unpacker is not None else self.packed
                if not self.packed:
                    self.packed = self.stream.read(CHUNK)
                    if not self.packed:
                        return False
                self.unpacker = zlib.decompressobj(31)
            else:
                self.packed = self.unpacker.unconsumed_tail or self.stream.read(CHUNK)
            data = self.unpacker.decompress(self.packed, CHUNK)
            if not data and not self.packed and not self.unpacker.eof:
                raise ValueError("the archive ends inside a record")
            if data:
                self.plain += data
                return True

    def until(self, mark: bytes) -> bytes | None:
        """What comes before the mark, however long; None at the end."""
        seen = 0
        while (at := self.plain.find(mark, max(0, seen - len(mark) + 1))) < 0:
            seen = len(self.plain)
            if not self.fill():
                if self.plain.strip():
                    raise ValueError("the archive ends inside a header")
                return None
        head = bytes(self.plain[:at])
        del self.plain[: at + len(mark)]
        return head

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.plain and not self.fill():
                raise ValueError("the archive ends inside a block")
            piece = bytes(self.plain[:n])
            del self.plain[: len(piece)]
            n -= len(piece)
            yield piece


def read_records(stream) -> Iterator[tuple[dict[str, str], int, Iterator[bytes]]]:
    """Header fields, length of the payload in the record, and the payload in pieces, of each response and revisit record."""
    source = RecordStream(stream)
    while (head := source.until(b"\r\n\r\n")) is not None:
        version, *lines = head.decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(fields["content-length"])
        if fields["warc-type"] in ("response", "revisit"):
            http = source.until(b"\r\n\r\n")
            size -= len(http) + 4
            pieces = source.take(size)
            yield fields, size, pieces
            for _ in pieces:  # what the caller has left
                pass
        else:
            for _ in source.take(size):
                pass
        for _ in source.take(4):
            pass


CHUNK_COLUMNS = "record_id string, url string, record_type string, refers_to string, header_digest string, header_bytes long, chunk_no long, chunk binary, bytes_so_far long, sha1_so_far string, is_last boolean"


def chunk_table(manifest: DataFrame, payloads: bool = True, chunk: int = CHUNK) -> DataFrame:
    """The chunked record table of the archives of a manifest: CHUNK_COLUMNS, chunk_no from 0. An empty payload and a revisit have one row with
    an empty chunk. Without `payloads` chunks are null: lengths and digests stay. Each archive is read as a stream by one task."""
    n = max(1, manifest.count())

    def chunks(fields: dict, size: int, pieces: Iterator[bytes]) -> Iterator[tuple]:
        refers = fields.get("warc-refers-to")
        head = (fields["warc-record-id"][1:-1], fields.get("warc-target-uri"), fields["warc-type"], refers and refers[1:-1], fields["warc-payload-digest"].partition(":")[2], int(fields.get("warc-payload-length", size)))
        digest, total, number, held = hashlib.sha1(), 0, 0, b""
        for piece in pieces:
            held += piece
            while len(held) > chunk:
                own, held = held[:chunk], held[chunk:]
                digest.update(own)
                total += len(own)
                yield (*head, number, own if payloads else None, total, base32_sha1(digest.digest()), False)
                number += 1
        digest.update(held)
        yield (*head, number, held if payloads else None, total + len(held), base32_sha1(digest.digest()), True)

    names = [c.split()[0] for c in CHUNK_COLUMNS.split(", ")]
    kinds = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}
    types = [kinds[c.split()[1]] for c in CHUNK_COLUMNS.split(", ")]

    def rows(paths: Iterator[str]) -> Iterator[tuple]:
        for path in paths:
            files, at = filesystem(path)
            with files.open_input_stream(at, compression=None) as stream:
                for record in read_records(stream):
                    yield from chunks(*record)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), types, strict=True)], names)
        for row in rows(p for b in batches for p in b.column("path").to_pylist()):
            held.append(row)
            size += len(row[7] or b"")
            if size >= 8 * CHUNK or len(held) >= 5000:
                yield batch()
                held, size = [], 0
        if held:
            yield batch()

    return manifest.select("path").repartition(n).mapInArrow(read, CHUNK_COLUMNS)


def page_records(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> tuple[DataFrame, list[DataFrame]]:
    """record_id, url, payload, hex (SHA-1) and refers_to for write_archives(), and the written tables to drop once the archives are there.

    Of pages with equal payloads of at least `least` bytes, the one with the largest key is written in full and the others revisit it. Null keys
    are smaller than any, and null payloads are empty. Rows that repeat that key are written in full each; rows that repeat any key get record ids
    that a number tells apart, after the id that revisits refer to. Other columns are ignored, whatever their names.

    Payloads do not move: digests are counted from a narrow table, and only those that several pages share come back to them, broadcast up
    to BROADCAST_IDS and by a join that Spark can split beyond.
    """
    name = F.concat(F.lit("urn:page:"), F.coalesce(F.col("key").cast("string"), F.lit("")))
    own = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    own = own.select(name.alias("name"), "key", "url", "payload", F.sha1(F.col("payload").cast("binary")).alias("hex"))
    narrow = written(own.select("name", "key", "hex", (F.octet_length("payload") >= least).alias("counts")), "digests")
    shared = narrow.where("counts").groupBy("hex").agg(F.max("key").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("hex", "first")
    shared = written(shared.withColumn("of_first", F.concat(F.lit("urn:page:"), F.coalesce(F.col("first").cast("string"), F.lit("")))), "shared")
    repeated = written(narrow.groupBy("name").count().where("count > 1").select("name", F.lit(True).alias("again")), "repeated")
    sized = lambda df: F.broadcast(df) if df.count() <= BROADCAST_IDS else df.hint("merge")
    joined = own.join(sized(shared), "hex", "left").join(sized(repeated), "name", "left")
    refers = F.when((F.octet_length("payload") >= least) & F.col("of_first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first")), F.col("of_first"))
    unique = F.when(F.col("again"), F.concat("name", F.lit("#"), F.monotonically_increasing_id())).otherwise(F.col("name"))
    return joined.select(unique.alias("record_id"), "url", "payload", "hex", refers.alias("refers_to")), [narrow, shared, repeated]


def page_of(c: str) -> F.Column:
    """The key in a record id of page_records(); null for a null id and a null key."""
    return F.nullif(F.substring_index(F.substring_index(F.col(c), ":", -1), "#", 1), F.lit(""))


def to_base32(hex_column: str) -> F.Column:
    """A SHA-1 as 40 hex digits in base32: each 5 hex digits are 4 base32 digits."""
    from functools import reduce

    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    group = lambda i: F.conv(F.substring(hex_column, i * 5 + 1, 5), 16, 10).cast("int")
    digit = lambda v, s: F.substring(F.lit(alphabet), F.shiftright(v, s).bitwiseAND(F.lit(31)) + 1, F.lit(1))
    return reduce(F.concat, [digit(group(i), s) for i in range(8) for s in (15, 10, 5, 0)])


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes WARC archives of pages and returns the manifest; an empty one for an empty table."""
    at = folder or f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    records, tables = page_records(pages)
    manifest = write_archives(records.withColumn("digest", to_base32("hex")), at)
    for table in tables:
        drop_written(table)
    return manifest


def op3_warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page, from the archives: what the last chunk of its record says. A revisit has its length and digest from its header."""
    read = chunk_table(archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")), payloads=False).where("is_last")
    revisit = F.col("record_type") == "revisit"
    return read.select(
        page_of("record_id").cast("long").alias("page_id"),
        F.when(revisit, F.col("header_bytes")).otherwise(F.col("bytes_so_far")).alias("payload_bytes"),
        F.when(revisit, F.col("header_digest")).otherwise(F.col("sha1_so_far")).alias("payload_digest"),
        "record_type",
        page_of("refers_to").cast("long").alias("refers_to"),
    )
