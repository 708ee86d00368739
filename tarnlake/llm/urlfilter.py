"""URL filters: host and path rules, then Bloom filter cascades over the corpus's hosts.

A cascade's first filter holds the listed hosts; the second the unlisted hosts of the corpus that the first lets through by mistake; the
third the listed ones that the second lets through; and so on until no mistake is left. Since the levels know the corpus's whole key
universe, a walk down them is exact for every host of the corpus, and no page row is joined or shuffled.

Hosts are dealt into buckets of about BUCKET_HOSTS by their hash, and each bucket gets a cascade of its own, built by one task. Pages are
judged against blocks of buckets whose filters take at most BLOCK_BYTES; only a block is ever on the driver or broadcast. A longer list means
more blocks, each a further pass over the pages' URLs, and nothing else changes. Hosts are told apart by 128 bits of hash.

Nulls: a null URL, or one without ``://``, has an empty host and path, fits no rule and is allowed unless the empty host is listed; a null
page_id stays; a null listed host is none. Repeated rows each give a row, repeated or unknown listed hosts count once or not at all. Very long
URLs are read whole. Of rules of equal length the one that stands first wins. Empty tables give empty results, an empty list allows all that
no rule blocks; columns other than page_id and url are left aside, whatever they are called.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tarnlake.llm import common as C

#: Verdict, host and path of each rule.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: A host is listed if one of these is among its labels.
LISTED_LABELS = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
HASHES, MOST_LEVELS = 7, 100
BUCKET_HOSTS, BLOCK_BYTES = 200_000, 32 << 20


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A to Z in lower case."""
    return C.ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct<verdict, rule> of the longest rule that fits, or null."""
    chain = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        what = F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))
        chain = F.when(fits, what) if chain is None else chain.when(fits, what)
    return chain


def _keys(host: Column) -> list[Column]:
    """128 bits of hash, as two longs that tell hosts apart, and the bucket's."""
    return [F.xxhash64(host).alias("h1"), F.xxhash64(host, F.lit(1)).alias("h2"), F.xxhash64(host, F.lit(2)).alias("h3")]


def _mixed(h: np.ndarray, level: int) -> np.ndarray:
    """A hash of its own for each level."""
    h = (h ^ np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x165667B19E3779F9)
    return h ^ (h >> np.uint64(32))


def _places(h1: np.ndarray, h2: np.ndarray, level: int, bits: np.ndarray | np.uint64) -> list[np.ndarray]:
    """The bits of keys in a level's filter of so many bits."""
    a, b = _mixed(h1, level) >> np.uint64(1), _mixed(h2, level) >> np.uint64(33) | np.uint64(1)
    return [(a + b * np.uint64(i)) % bits for i in range(HASHES)]


def build(h1: np.ndarray, h2: np.ndarray, listed: np.ndarray) -> list[np.ndarray]:
    """The levels of a bucket's cascade, as 32-bit words."""
    levels: list[np.ndarray] = []
    inside, outside = np.flatnonzero(listed), np.flatnonzero(~listed)
    while len(inside):
        if len(levels) == MOST_LEVELS:
            raise RuntimeError("two hosts have the same 128 bits of hash")
        level, bits = len(levels), np.uint64(32 * max(2, int(np.ceil(len(inside) * HASHES / np.log(2) / 32))))
        words = np.zeros(int(bits) // 32, np.uint32)
        for p in _places(h1[inside], h2[inside], level, bits):
            np.bitwise_or.at(words, (p >> np.uint64(5)).astype(np.int64), np.uint32(1) << (p & np.uint64(31)).astype(np.uint32))
        levels.append(words)
        found = np.ones(len(outside), bool)
        for p in _places(h1[outside], h2[outside], level, bits):
            found &= _bit(words, p)
        inside, outside = outside[found], inside
    return levels


def _bit(words: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (words[(places >> np.uint64(5)).astype(np.int64)] >> (places & np.uint64(31)).astype(np.uint32) & np.uint32(1)).astype(bool)


class Block:
    """The cascades of some buckets: all levels' words in a row, and where each bucket's levels begin."""

    def __init__(self, cascades: dict[int, list[bytes]]):
        self.buckets = np.array(sorted(cascades), np.int64)
        levels = [cascades[b] for b in self.buckets.tolist()]
        self.depth = np.array([len(x) for x in levels], np.int64)
        sizes = np.zeros((len(levels), max(self.depth, default=0)), np.int64)
        for i, own in enumerate(levels):
            sizes[i, : len(own)] = [len(x) // 4 for x in own]
        flat = sizes.ravel()
        self.sizes, self.begin = sizes, (np.cumsum(flat) - flat).reshape(sizes.shape)
        self.words = np.frombuffer(b"".join(x for own in levels for x in own), np.uint32)

    def listed(self, bucket: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Whether keys of the universe are listed: the first level that doesn't hold a key tells."""
        own = np.searchsorted(self.buckets, bucket)
        out = self.depth[own] % 2 == 1
        rest = np.arange(len(bucket))
        for level in range(self.sizes.shape[1]):
            rest = rest[self.depth[own[rest]] > level]
            row = own[rest]
            held = np.ones(len(rest), bool)
            for p in _places(h1[rest], h2[rest], level, 32 * self.sizes[row, level].astype(np.uint64)):
                held &= _bit(self.words, p + 32 * self.begin[row, level].astype(np.uint64))
            out[rest[~held]] = level % 2 == 1
            rest = rest[held]
        return out


def cascades(hosts: DataFrame, listed: DataFrame, bucket_hosts: int = BUCKET_HOSTS) -> tuple[DataFrame, int]:
    """bucket, levels (arrays of bytes) of the cascades for the listed hosts (column host) over the corpus's (column host), and the number of
    buckets. Buckets without a listed host have no levels."""
    every = hosts.select("host", F.lit(True).alias("there"), F.lit(False).alias("in_list")).unionByName(
        listed.filter(F.col("host").isNotNull()).select("host", F.lit(False).alias("there"), F.lit(True).alias("in_list"))
    )
    universe = C.written(every.groupBy("host").agg(F.max("there").alias("there"), F.max("in_list").alias("in_list")).filter("there").select(*_keys(F.col("host")), "in_list"), "hosts")
    n = max(1, -(-universe.count() // bucket_hosts))

    def solve(key: tuple, rows: pa.Table) -> pa.Table:
        h1, h2 = (rows.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
        levels = build(h1, h2, rows.column("in_list").to_numpy(zero_copy_only=False).astype(bool))
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int64()), "levels": pa.array([[w.tobytes() for w in levels]], pa.list_(pa.binary()))})

    dealt = universe.select("h1", "h2", "in_list", F.pmod("h3", F.lit(n)).alias("bucket"))
    return C.written(dealt.groupBy("bucket").applyInArrow(solve, "bucket long, levels array<binary>"), "cascades"), n


def member(spark: SparkSession, block: Block, buckets: int) -> Column:
    """Whether column ``host``, of the universe and of a bucket of this block, is listed."""
    #: Plain arrays: a broadcast value is read before the worker knows this package's path.
    shared = spark.sparkContext.broadcast(vars(block))

    @F.pandas_udf("boolean")
    def test(bucket: pd.Series, h1: pd.Series, h2: pd.Series) -> pd.Series:
        own = Block({})
        vars(own).update(shared.value)
        return pd.Series(own.listed(bucket.to_numpy(np.int64), h1.to_numpy(np.int64).view(np.uint64), h2.to_numpy(np.int64).view(np.uint64)))

    h1, h2, h3 = _keys(F.col("host"))
    return test(F.pmod(h3, F.lit(buckets)), h1, h2)


def with_listed(rows: DataFrame, listed: DataFrame, bucket_hosts: int = BUCKET_HOSTS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows (with a column host) and ``listed``: whether the list (a column host) has their host."""
    spark = rows.sparkSession
    built, n = cascades(rows.select("host"), listed, bucket_hosts)
    size = F.coalesce(F.aggregate("levels", F.lit(0), lambda acc, x: acc + F.octet_length(x)), F.lit(0))
    #: One number for each BUCKET_HOSTS hosts; the filters themselves come to the driver a block at a time.
    sizes = {r.bucket: r.size for r in built.select("bucket", size.alias("size")).collect()}
    blocks, room = [], 0
    for bucket in range(n):
        room -= sizes.get(bucket, 0)
        if room < 0 or not blocks:
            blocks.append(bucket)
            room = block_bytes - sizes.get(bucket, 0)
    own, out = F.pmod(_keys(F.col("host"))[2], F.lit(n)), []
    for begin, end in zip(blocks, [*blocks[1:], n]):
        held = {b: [] for b in range(begin, end)} | {r.bucket: list(map(bytes, r.levels)) for r in built.filter(F.col("bucket").between(begin, end - 1)).toLocalIterator()}
        part = rows if len(blocks) == 1 else rows.filter(own.between(begin, end - 1))
        out.append(part.withColumn("listed", member(spark, Block(held), n)))
    return reduce(DataFrame.unionByName, out)


def listed_hosts(pages: DataFrame, labels=LISTED_LABELS) -> DataFrame:
    """The list of op6: hosts of the pages that have one of the labels."""
    return pages.select(host_of(F.col("url")).alias("host")).filter(F.arrays_overlap(F.split("host", r"\."), F.array(*map(F.lit, labels)))).distinct()


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, bucket_hosts: int = BUCKET_HOSTS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """page_id, host, path, rule, verdict, and listed: whether the list (a column host, in lower case) has the host."""
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    found = with_listed(split, listed, bucket_hosts, block_bytes)
    rule = found.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    return rule.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce(F.col("r.verdict"), F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page's URL."""
    pages = C.table(spark, sf_dir, "pages")
    return judge(pages, listed_hosts(pages))
