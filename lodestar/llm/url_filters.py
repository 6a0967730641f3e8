"""URL filters over a sorted digest array.

A list of keys becomes flat files: sorted 64-bit xxhash digests, the offsets of each key's full string, a number per key, and those strings. Spark
sorts the list into ranges of digests and writes a file for each, so that a list of any size is built without the driver. Executors map
the files into memory, probe all candidate keys of a batch by one vectorised binary search in each file and compare the full strings of the hits,
so that two keys with one digest cannot be mixed up.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import byte_values, drop_written, filesystem, lower_ascii, shared_folder, written

# The rules of the contract as (action, host, path prefix).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

# Words of host names that are blocked where no rule fits and the caller brings no list: advertising, adult, gambling, drugs, fraud.
BLOCKED_WORDS = (
    "ad ads adserver advert adverts banners popunder popup "
    "adult cams escort escorts hentai nude porn porno sex webcam xxx "
    "bet bets betting bingo bookmaker casino casinos gambling jackpot lottery poker roulette slots "
    "cialis drugs pharmacy pill pills steroids viagra "
    "crack keygen malware phishing scam scams spam torrent torrents warez"
).split()

#: Keys in a file.
FILE_KEYS = 1 << 21
#: Spark's xxhash64() is xxHash64 with this seed.
SEED = 42
#: The number of keys that come from a list; rules have their place among the rules.
LISTED = 1 << 40
PREFIXES = {"rule": "R", "word": "W", "host": "H", "url": "U"}


def digest_of(key: bytes) -> int:
    return xxhash.xxh64_intdigest(key, seed=SEED)


class DigestArray:
    """Keys with a number each, sorted by digest (as signed longs). find() gives the number of each probe, or -1."""

    def __init__(self, keys, offsets, values, strings):
        self.keys, self.offsets, self.values, self.strings = keys, offsets, values, strings

    def parts(self) -> list[np.ndarray]:
        """What a file holds, in order."""
        return [np.array([len(self.keys)], np.int64), self.keys, self.offsets, self.values, self.strings]

    @classmethod
    def mapped(cls, path: str) -> DigestArray:
        raw = np.memmap(path, np.uint8, "r")
        n = int(raw[:8].view(np.int64)[0])
        ends = np.cumsum([8, 8 * n, 8 * (n + 1), 8 * n])
        keys, offsets, values = (raw[a:b].view(np.int64) for a, b in zip(ends, ends[1:], strict=False))
        return cls(keys, offsets, values, raw[ends[-1] :])

    def find(self, probes: list[bytes], digests: np.ndarray) -> np.ndarray:
        out = np.full(len(probes), -1, np.int64)
        if not len(probes) or not len(self.keys):
            return out
        at = np.searchsorted(self.keys, digests)
        hits = np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == digests))
        for i in hits:  # few: only probes whose digest is listed
            k = at[i]
            while k < len(self.keys) and self.keys[k] == digests[i]:
                if self.strings[self.offsets[k] : self.offsets[k + 1]].tobytes() == probes[i]:
                    out[i] = self.values[k]
                    break
                k += 1
        return out


def build_digests(entries: DataFrame, file_keys: int = FILE_KEYS) -> list[tuple[str, int]]:
    """Writes entries(key string, value long) into files of the shared folder, each a range of digests, and gives (path, lowest digest) of each.

    Null keys are left out; of a key given twice the smallest number counts. One row for each file reaches the driver.
    """
    folder = f"{shared_folder(entries.sparkSession)}/digests-{uuid.uuid4().hex}"
    single = written(entries.where("key is not null").groupBy("key").agg(F.min("value").cast("long").alias("value")).withColumn("digest", F.xxhash64("key")), "keys")
    files = max(1, -(-single.count() // file_keys))

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests, values, sizes, strings = [], [], [], []
        for batch in batches:
            keys = byte_values(batch, "key")
            digests.append(batch.column("digest").to_numpy())
            values.append(batch.column("value").to_numpy())
            sizes += map(len, keys)
            strings.append(b"".join(keys))
        if not sizes:
            return
        files, root = filesystem(folder)
        files.create_dir(root, recursive=True)
        array = DigestArray(np.concatenate(digests), np.cumsum([0, *sizes], dtype=np.int64), np.concatenate(values), np.frombuffer(b"".join(strings), np.uint8))
        name = f"{uuid.uuid4().hex}.digests"
        with files.open_output_stream(f"{root}/{name}", compression=None) as out:
            for part in array.parts():
                out.write(part.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([int(array.keys[0])])], ["path", "low"])

    ranged = single.repartitionByRange(files, "digest").sortWithinPartitions("digest", "key").select("key", "digest", "value")
    manifest = written(ranged.mapInArrow(filed, "path string, low long"), "manifest")
    found = [tuple(r) for r in manifest.orderBy("low").collect()]
    for table in (single, manifest):
        drop_written(table)
    return found


class DigestFiles:
    """The files of a list, sent to every executor, also to those that start later, and mapped into memory where they are probed."""

    def __init__(self, spark: SparkSession, entries: DataFrame, file_keys: int = FILE_KEYS):
        found = build_digests(entries, file_keys)
        for path, _ in found:
            spark.sparkContext.addFile(path)
        self.names = [path.rpartition("/")[2] for path, _ in found]
        self.lows = np.array([low for _, low in found], np.int64)

    def mapped(self) -> None:
        self.arrays = [DigestArray.mapped(SparkFiles.get(name)) for name in self.names]

    def find(self, probes: list[bytes]) -> np.ndarray:
        out = np.full(len(probes), -1, np.int64)
        digests = np.fromiter(map(digest_of, probes), np.uint64, len(probes)).view(np.int64)
        place = np.searchsorted(self.lows, digests, "right") - 1
        for p in np.unique(place[place >= 0]):
            mine = np.flatnonzero(place == p)
            out[mine] = self.arrays[p].find([probes[i] for i in mine], digests[mine])
        return out


def host_and_path(url: str) -> tuple:
    """Columns: host (A-Z lower-cased) and path of a url column; both empty for null and for urls without ://."""
    part = lambda n: F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)([^?#]*)", n), F.lit(""))
    return lower_ascii(part(1)), part(2)


def suffixes(host: str) -> list[str]:
    return [host, *(host[m.end() :] for m in re.finditer(r"\.", host))] if host else []


def default_list(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("word", w) for w in BLOCKED_WORDS], "kind string, value string")


def judge_urls(df: DataFrame, url: str = "url", keep: tuple[str, ...] = ("page_id",), rules=tuple(RULES), listed: DataFrame | None = None, file_keys: int = FILE_KEYS) -> DataFrame:
    """One row per input row: the columns of `keep`, host, path, rule and verdict.

    A rule (action, host, path) fits its host and all subdomains if the path starts with the rule's. Of those that fit, the
    longest host plus path wins, of equal ones the one with the longer host. Without a rule a url is blocked if it is in the list, a table of any
    size of kind and value: `host` (and its subdomains), `url` (host and path, without scheme) or `word` (a run of a-z and 0-9 in the host); by
    default BLOCKED_WORDS. Every other url is allowed. Null, empty and malformed urls have empty host and path, no rule, and are allowed; entries of
    the list that are null or of another kind mean nothing. Repeated rows are judged each; empty tables give empty results; other columns are
    not touched. The rows judged do not move.
    """
    spark = df.sparkSession
    own = spark.createDataFrame([(f"R{host}{path}", i) for i, (_, host, path) in enumerate(rules)], "key string, value long")
    kinds = F.create_map(*(F.lit(x) for kind, prefix in PREFIXES.items() if kind != "rule" for x in (kind, prefix)))
    given = (default_list(spark) if listed is None else listed).select(F.concat(kinds[F.col("kind")], F.col("value")).alias("key"), F.lit(LISTED).alias("value"))
    files, path_sizes = DigestFiles(spark, own.union(given), file_keys), sorted({len(p) for _, _, p in rules})
    host, path = host_and_path(url)
    source = df.select(*keep, host.alias("host"), path.alias("path"))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files.mapped()
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            probes: dict[bytes, int] = {}  # distinct keys of the batch
            probe = lambda key: probes.setdefault(key.encode(), len(probes))  # noqa: B023, E731
            ruled: list[list[tuple[int, int, int]]] = []
            of_host: dict[str, list[int]] = {}
            urls = []
            for h, p in zip(hosts, paths, strict=True):
                ends = suffixes(h)
                ruled.append([(len(s) + n, len(s), probe(f"R{s}{p[:n]}")) for s in ends for n in path_sizes if len(p) >= n])
                if h not in of_host:
                    of_host[h] = [*(probe(f"H{s}") for s in ends), *(probe(f"W{w}") for w in re.findall("[a-z0-9]+", h))]
                urls.append(probe(f"U{h}{p}") if h else None)
            got = files.find(list(probes))
            rule_of, verdicts = [], []
            for h, found, u in zip(hosts, ruled, urls, strict=True):
                best = max(((size, n, got[k]) for size, n, k in found if got[k] >= 0), default=None)
                in_list = (u is not None and got[u] >= 0) or any(got[k] >= 0 for k in of_host[h])
                action, rule_host, rule_path = rules[best[2]] if best else ("block" if in_list else "allow", "", "")
                rule_of.append(f"{rule_host}{rule_path}" if best else None)
                verdicts.append(action)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule_of, pa.string()), pa.array(verdicts, pa.string())], [*batch.schema.names, "rule", "verdict"])

    kinds_of = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema)
    return source.mapInArrow(judged, f"{kinds_of}, rule string, verdict string")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


# written out, not taken from the lists above, so that a slip there shows
ORACLE = r"""
WITH p AS (
  SELECT page_id, row_number() OVER () AS n,
         translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
r(action, rh, rp) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
best AS (
  SELECT p.n, arg_max(rh || rp, (length(rh || rp), length(rh))) AS rule, arg_max(action, (length(rh || rp), length(rh))) AS action
  FROM p JOIN r ON (p.host = rh OR ends_with(p.host, '.' || rh)) AND starts_with(p.path, rp) GROUP BY p.n)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN regexp_matches(host, '(^|[^a-z0-9])(ad|ads|adserver|advert|adverts|banners|popunder|popup'
  || '|adult|cams|escort|escorts|hentai|nude|porn|porno|sex|webcam|xxx|bet|bets|betting|bingo|bookmaker|casino|casinos|gambling|jackpot|lottery|poker|roulette|slots'
  || '|cialis|drugs|pharmacy|pill|pills|steroids|viagra|crack|keygen|malware|phishing|scam|scams|spam|torrent|torrents|warez)([^a-z0-9]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN best USING (n)
"""
