"""URL filters (6): Bloom filter cascade over the corpus's complete key universe.

A key is a domain and a path's beginning. Level 1 encodes the listed keys; level 2 the keys of the corpus that
level 1 takes in error; level 3 the listed keys that level 2 takes; and so on until a level has no errors. Each key
of the universe then gets its exact answer from the levels alone: a key is listed if the first level that refuses it
has an even number. The levels are broadcast, so the table of urls isn't joined or shuffled. Their size is known
from counts: keys are dealt by hash to as many cascades as keep each level within max_bits, used one after another.

url null or without "://": host and path are empty, and no rule fits. Repeated rows come out once each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.shared import one_name, scratch, with_id

#: Verdict, host, path; a rule holds for its host and all subdomains, for paths that start with its own.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Hosts that are blocked, with their subdomains, where no rule fits.
LISTED = tuple(f"{name}.example.{top}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))
_SEP = "\x00"
#: Bytes of a level that tasks send as one piece.
PIECE = 4096


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def keys(host: str, path: str, labels: frozenset[int], lengths: frozenset[int]) -> list[str]:
    """The url's own keys that could be listed: domains of as many labels, paths' beginnings as long, as any listed key."""
    parts = host.split(".")
    return [f"{'.'.join(parts[-n:])}{_SEP}{path[:m]}" for n in labels if n <= len(parts) for m in lengths if m <= len(path)]


class Level:
    """A Bloom filter; its hash function is its number's."""

    def __init__(self, number: int, bits: np.ndarray, probes: int) -> None:
        self.number, self.bits, self.probes = number, bits, probes

    @staticmethod
    def places(key: str, number: int, size: int, probes: int) -> list[int]:
        h = xxhash.xxh3_128_intdigest(key.encode("utf-8", "surrogatepass"), seed=number)
        a, b = h >> 64, h & 0xFFFFFFFFFFFFFFFF | 1
        return [(a + i * b) % size for i in range(probes)]

    def takes(self, key: str) -> bool:
        return all(self.bits[p >> 3] >> (p & 7) & 1 for p in self.places(key, self.number, len(self.bits) * 8, self.probes))


def listed_by(levels: Sequence[Level], key: str) -> bool:
    for level in levels:
        if not level.takes(key):
            return level.number % 2 == 0
    return len(levels) % 2 == 1


def level_of(members: DataFrame, count: int, number: int, rate: float) -> Level:
    """Encodes the keys; tasks send the pieces of the level that they set bits in, Spark adds them up, and the driver gets size / 8 bytes."""
    size = bits_for(count, rate)
    probes = max(1, round(size / max(1, count) * math.log(2)))

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            at = np.unique(np.array([p for k in b["key"] for p in Level.places(k, number, size, probes)], np.int64))
            pieces, first = np.unique(at // (8 * PIECE), return_index=True)
            for piece, places in zip(pieces.tolist(), np.split(at % (8 * PIECE), first[1:]), strict=True):
                own = held.setdefault(piece, np.zeros(8 * PIECE, bool))
                own[places] = True
        yield pd.DataFrame({"piece": list(held), "bits": [np.packbits(x, bitorder="little").tobytes() for x in held.values()]})

    def either(b: pd.DataFrame) -> pd.DataFrame:
        whole = np.bitwise_or.reduce(np.stack([np.frombuffer(x, np.uint8) for x in b["bits"]]))
        return pd.DataFrame({"piece": b["piece"].iloc[:1], "bits": [whole.tobytes()]})

    out = np.zeros(-(-size // (8 * PIECE)) * PIECE, np.uint8)
    for r in members.mapInPandas(bits, "piece int, bits binary").groupBy("piece").applyInPandas(either, "piece int, bits binary").toLocalIterator():
        out[r["piece"] * PIECE : (r["piece"] + 1) * PIECE] = np.frombuffer(r["bits"], np.uint8)
    return Level(number, out[: size // 8], probes)


def bits_for(count: int, rate: float) -> int:
    return max(64, -(-math.ceil(-count * math.log(rate) / math.log(2) ** 2) // 64) * 64)


def cascade(universe: DataFrame, listed: DataFrame, rate: float = 0.01) -> list[Level]:
    """Levels that tell listed(key) from all other keys of universe(key)."""

    def taken(level: Level, frame: DataFrame) -> DataFrame:
        held = frame.sparkSession.sparkContext.broadcast(level)

        def only(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield b[[held.value.takes(k) for k in b["key"]]]

        return scratch(frame.mapInPandas(only, "key string"), "taken")

    inside, outside = listed.select("key"), universe.select("key").join(listed, "key", "left_anti")
    levels: list[Level] = []
    while n := inside.count():
        levels.append(level_of(inside, n, len(levels) + 1, rate))
        inside, outside = taken(levels[-1], outside), inside
    return levels


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, listed: Sequence[str] | DataFrame = LISTED, rate: float = 0.01, max_bits: int = 1 << 28) -> DataFrame:
    """One row a page: page_id, host, path, rule (host and path of the longest that fits, or null), verdict.

    listed: hosts, or a table of any size whose first column has them. The longest rule has the most characters; of
    equal ones the first by name. Without a rule, block if the host or a domain above it is listed, else allow.
    """
    spark: SparkSession = pages.sparkSession
    d = one_name(pages, {"page_id": id_col, "url": url_col})
    d = d.select("page_id", *[c.alias(n) for n, c in zip(("host", "path"), host_and_path(F.col("url")), strict=True)])
    verdicts = {h + _SEP + p: (v, h + p) for v, h, p in rules}
    if not isinstance(listed, DataFrame):
        listed = spark.createDataFrame([(h,) for h in listed], "host string")
    hosts = listed.select(F.lower(F.col(f"`{listed.columns[0]}`")).alias("host")).where("host <> ''")
    ruled = spark.createDataFrame([(k,) for k in verdicts], "key string")
    known = scratch(hosts.select(F.concat("host", F.lit(_SEP)).alias("key")).union(ruled).distinct(), "listed")
    shape = known.select(F.size(F.split(F.substring_index("key", _SEP, 1), r"\.")).alias("labels")).distinct()  # a host has 127 labels at most
    labels = frozenset(r["labels"] for r in shape.collect())
    lengths = frozenset(len(k.partition(_SEP)[2]) for k in verdicts) | {0}

    def of_url(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"key": list({k for h, p in zip(b["host"], b["path"], strict=True) for k in keys(h, p, labels, lengths)})}, dtype=object)

    universe = scratch(d.select("host", "path").mapInPandas(of_url, "key string").distinct(), "universe")
    # the first two levels are the largest: of the listed keys, and of the others that the first takes in error
    shards = -(-bits_for(max(known.count(), math.ceil(universe.count() * rate)), rate) // max_bits)
    d = d.withColumn("hits", F.array().cast("array<string>"))
    for shard in range(shards):
        own = F.pmod(F.xxhash64("key"), F.lit(shards)) == shard
        d = _looked_up(d, cascade(universe.where(own), known.where(own), rate), shard, shards, labels, lengths)
        d = scratch(d, "urls") if shards > 1 else d

    def verdict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rule, said = [], []
            for hits in b["hits"]:
                fit = min((k for k in hits if k in verdicts), key=lambda k: (-len(verdicts[k][1]), verdicts[k][1]), default=None)
                rule.append(verdicts[fit][1] if fit else None)
                said.append(verdicts[fit][0] if fit else "block" if len(hits) else "allow")
            yield b[["page_id", "host", "path"]].assign(rule=pd.Series(rule, dtype=object, index=b.index), verdict=said)

    return with_id(d, verdict, "page_id long, host string, path string, rule string, verdict string", "page_id")


def _looked_up(d: DataFrame, levels: list[Level], shard: int, shards: int, labels: frozenset[int], lengths: frozenset[int]) -> DataFrame:
    """d(page_id, host, path, hits) with the url's listed keys of the shard among the hits."""
    shared = d.sparkSession.sparkContext.broadcast(levels)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[str, bool] = {}
        for b in batches:
            memo = {} if len(memo) > 100_000 else memo
            out = []
            for h, p, hits in zip(b["host"], b["path"], b["hits"], strict=True):
                found = list(hits)
                for k in keys(h, p, labels, lengths):
                    if k not in memo:
                        memo[k] = in_shard(k, shard, shards) and listed_by(shared.value, k)
                    if memo[k]:
                        found.append(k)
                out.append(found)
            yield b.assign(hits=out)

    return with_id(d, look, "page_id long, host string, path string, hits array<string>", "page_id")


def in_shard(key: str, shard: int, shards: int) -> bool:
    """As pmod(xxhash64(key), shards) = shard."""
    if shards == 1:
        return True
    h = xxhash.xxh64_intdigest(key.encode("utf-8", "surrogatepass"), seed=42)
    return (h - (h >> 63 << 64)) % shards == shard
