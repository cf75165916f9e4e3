"""Phrase collocations (12): prefix-free parsing of the corpus, n-grams counted inside its dictionary.

Texts are cut where their content says so: a new chunk begins at each window of LONGEST - 1 words whose hash is one in
ONE_IN, and the chunk before it runs on to that window's end. Copies and passages that documents share are therefore cut
alike, whatever stands around them, and the dictionary holds each distinct chunk once, with the number of times that the
parse has it. N-grams are counted inside distinct chunks, times that number; one that lies in an overlap belongs to the
chunk in which it starts. So no count needs two chunks, and none is made twice. A chunk without a cut ends after LONGEST_CHUNK words.

A phrase is frequent only if all within it is. Numbers of 64-bit hashes, which are never below the phrase's own, find
what may be frequent: words, then pairs of such words, then longer phrases of such pairs. What a pass has found goes to the
next as a bitmap of at most 2^MOST_BITS bits: where it is too full it leaves out less, and the result is the same. The last
pass counts the phrases themselves. All further arithmetic is exact (decimals).

Null or empty text: no words. A null language is UNKNOWN's. Repeated rows count each. Languages without a frequent phrase,
and empty tables, give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.shared import _WORD, chunks, drop, mix, one_name, prefix_sums, scratch, span_hash

LONGEST = 4
UNKNOWN = "und"
#: One window in so many begins a chunk; a chunk has at most so many words of its own.
ONE_IN, LONGEST_CHUNK = 64, 4096
#: Bytes of chunks that are counted at once: workers keep the powers for so many.
BLOCK_BYTES = 900_000
#: Bits of a pass's bitmap: so many a key, at most 2^MOST_BITS.
BITS_A_KEY, MOST_BITS = 16, 27
#: Bits of a piece of the bitmap, as a power of two.
PIECE = 15
#: A language's phrases are ranked in so many parts first.
SALTS = 64
BASE2 = 0x27D4EB2F165667C5
_STOPS = b".,;:!?\n\v\f\r"
#: A-Z to a-z, what ends a piece to a line feed, tab to a space.
_CLEAN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + _STOPS + b"\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * len(_STOPS) + b" ")
_SPACE, _STOP = 0x20, 0x0A


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end byte of each word."""
    inside = np.concatenate([[False], (data != _SPACE) & (data != _STOP), [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def parse(texts: list[bytes], one_in: int = ONE_IN, longest: int = LONGEST_CHUNK) -> list[tuple[int, int, bytes]]:
    """(index of the text, number of own words, bytes) of each chunk; the words of the overlap are not its own."""
    joined = b"\n".join(texts).translate(_CLEAN)
    data = np.frombuffer(joined, np.uint8)
    start, end = words_of(data)
    if not len(start):
        return []
    ends = np.cumsum([len(t) + 1 for t in texts])
    of = np.searchsorted(ends, start, side="right")
    h = span_hash(prefix_sums(data), start, end)
    lap = LONGEST - 1
    first = np.concatenate([[True], of[1:] != of[:-1]])
    cut = first.copy()
    if len(h) >= lap:
        window = h[: len(h) - lap + 1]
        for i in range(1, lap):
            window = mix(window * _WORD + h[i : len(h) - lap + 1 + i])
        cut[: len(window)] |= (window % np.uint64(one_in) == 0) & (of[: len(window)] == of[lap - 1 :])
    at = np.flatnonzero(cut)
    size = np.diff(np.append(at, len(h)))
    if size.max() > longest:
        at = np.concatenate([np.arange(a, a + n, longest) for a, n in zip(at.tolist(), size.tolist(), strict=True)])
    stop = np.append(at[1:], len(h))
    text_end = np.append(np.flatnonzero(first)[1:], len(h))[np.searchsorted(np.flatnonzero(first), at, side="right") - 1]
    last = np.minimum(stop + lap, text_end)
    return [(t, n, joined[i:j]) for t, n, i, j in zip(of[at].tolist(), (stop - at).tolist(), start[at].tolist(), end[last - 1].tolist(), strict=True)]


def dictionary(docs: DataFrame, one_in: int = ONE_IN, longest: int = LONGEST_CHUNK) -> DataFrame:
    """docs(lang, text) -> a written table of distinct chunks: lang, own (words), chunk, n (how often the parse has it)."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            langs = b["lang"].to_numpy()
            for i, _, texts in chunks(b["text"]):
                found = parse(texts, one_in, longest)
                if found:
                    of, own, chunk = zip(*found, strict=True)
                    yield pd.DataFrame({"lang": langs[i + np.array(of)], "own": own, "chunk": chunk})

    return scratch(docs.mapInPandas(cut, "lang string, own int, chunk binary").groupBy("lang", "own", "chunk").agg(F.count("*").alias("n")), "chunks")


class Bitmap:
    """Of sorted or unsorted 64-bit hashes, which first bits any of them has."""

    def __init__(self, power: int, bits: np.ndarray) -> None:
        self.shift, self.bits = np.uint64(64 - power), bits

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h >> self.shift
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def bitmap(keys: DataFrame) -> Bitmap:
    """Of keys(h long), by pieces; the driver gets 2^MOST_BITS / 8 bytes at most."""
    power = int(np.clip(int(BITS_A_KEY * keys.count()).bit_length(), PIECE + 1, MOST_BITS))
    at = F.shiftrightunsigned("h", 64 - power)
    pieces = keys.select(F.shiftright(at, PIECE).alias("piece"), at.bitwiseAND(F.lit((1 << PIECE) - 1)).cast("int").alias("bit"))
    bits = np.zeros((1 << power) // 8, np.uint8)
    for r in pieces.groupBy("piece").agg(F.collect_set("bit").alias("bits")).toLocalIterator():
        own = np.zeros(1 << PIECE, bool)
        own[r["bits"]] = True
        size = (1 << PIECE) // 8
        bits[r["piece"] * size : (r["piece"] + 1) * size] = np.packbits(own, bitorder="little")
    return Bitmap(power, bits)


class Block:
    """Words of some chunks, and the n-grams that start in each chunk's own words."""

    def __init__(self, lang: list[str], own: np.ndarray, chunk: list[bytes], n: np.ndarray) -> None:
        self.bytes = b"\n".join(chunk)
        data = np.frombuffer(self.bytes, np.uint8)
        self.start, self.end = words_of(data)
        ends = np.cumsum([len(c) + 1 for c in chunk])
        of = np.searchsorted(ends, self.start, side="right")
        place = np.arange(len(of)) - np.searchsorted(of, np.arange(len(chunk)))[of]
        self.of, self.mine, self.weight, self.lang = of, place < own[of], n[of], lang
        seeds = {x: np.uint64(xxhash.xxh64_intdigest(x)) for x in set(lang)}
        self.seed = np.array([seeds[x] for x in lang], np.uint64)[of]
        self.data = data
        stops = np.concatenate([[0], np.cumsum(data == _STOP)])
        self.joined = stops[self.start[1:]] == stops[self.end[:-1]]  # nothing ends the piece before the next word
        self.g = self._hashes()
        self.second: np.ndarray | None = None

    def _hashes(self) -> list[np.ndarray]:
        """Hash of the n-gram at each word, by n - 1; the language is part of it."""
        h = span_hash(prefix_sums(self.data), self.start, self.end)
        out = [mix(h ^ self.seed)]
        for n in range(2, LONGEST + 1):
            out.append(mix(out[-1][: max(0, len(h) - n + 1)] * _WORD + h[n - 1 :]))
        return out

    def distinct(self, n: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the n-grams at some words, one place of each that is distinct in 128 bits, and how often it stands."""
        if self.second is None:
            self.second = span_hash(prefix_sums(self.data, BASE2), self.start, self.end, BASE2)
        other = self.second[at] ^ self.seed[at]
        for i in range(1, n):
            other = mix(other * _WORD + self.second[at + i])
        order = np.argsort(self.g[n - 1][at], kind="stable")
        a, b = self.g[n - 1][at][order], other[order]
        new = a[1:] != a[:-1]
        if (~new & (b[1:] != b[:-1])).any():  # two of one 64-bit hash
            order = np.lexsort((other, self.g[n - 1][at]))
            a, b = self.g[n - 1][at][order], other[order]
            new = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        edge = np.flatnonzero(np.concatenate([[True], new]))[: len(at)]
        return at[order[edge]], np.add.reduceat(self.weight[at][order], edge) if len(edge) else edge

    def starts(self, n: int) -> np.ndarray:
        """Whether an n-gram starts at each of the words that have n - 1 behind them, in a chunk's own words."""
        ok = self.mine[: len(self.g[n - 1])].copy()
        for i in range(n - 1):
            ok &= self.joined[i : i + len(ok)]
        return ok

    def possible(self, n: int, seen: list[Bitmap | None]) -> np.ndarray:
        """Where an n-gram starts of which each part with a bitmap, by n - 1, may be frequent."""
        ok = self.starts(n)
        at = np.flatnonzero(ok)
        for m in range(1, n + 1):
            if m <= len(seen) and seen[m - 1] is not None:
                for i in range(n - m + 1):
                    at = at[seen[m - 1].has(self.g[m - 1][at + i])]
        return at


def _blocks(batches: Iterator[pd.DataFrame], limit: int) -> Iterator[Block]:
    held: list[pd.DataFrame] = []
    size = 0
    for b in batches:
        total = np.concatenate([[0], np.cumsum(b["chunk"].str.len().to_numpy(np.int64))])
        at = 0
        while at < len(b):
            end = max(at + 1, int(np.searchsorted(total, total[at] + limit - size)) - 1)
            held.append(b.iloc[at:end])
            size += total[end] - total[at]
            at = end
            if size >= limit:
                yield _block(held)
                held, size = [], 0
    if size:
        yield _block(held)


def _block(held: list[pd.DataFrame]) -> Block:
    b = pd.concat(held, ignore_index=True)
    return Block(list(b["lang"]), b["own"].to_numpy(), list(b["chunk"]), b["n"].to_numpy())


def _frequent_hashes(table: DataFrame, sizes: tuple[int, ...], seen: list[Bitmap | None], least: int, block_bytes: int) -> DataFrame:
    """A written table of the hashes h of n-grams of the sizes that stand `least` times at least."""
    shared = table.sparkSession.sparkContext.broadcast(seen)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in _blocks(batches, block_bytes):
            for n in sizes:
                at = block.possible(n, shared.value)
                h, back = np.unique(block.g[n - 1][at], return_inverse=True)
                yield pd.DataFrame({"h": h.view(np.int64), "n": np.bincount(back, block.weight[at], len(h)).astype(np.int64)})

    return scratch(table.mapInPandas(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("h"), "frequent")


def frequencies(table: DataFrame, least: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A written table of all n-grams that stand `least` times at least: lang, size, phrase, f."""
    seen: list[Bitmap | None] = []
    for sizes in ((1,), (2,), tuple(range(3, LONGEST + 1))):
        found = _frequent_hashes(table, sizes, seen, least, block_bytes)
        seen = [*seen, *[bitmap(found)] * len(sizes)]
        drop(found)
    shared = table.sparkSession.sparkContext.broadcast(seen)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in _blocks(batches, block_bytes):
            for n in range(1, LONGEST + 1):
                first, f = block.distinct(n, block.possible(n, shared.value))
                if not len(first):
                    continue
                phrases = [block.bytes[i:j] for i, j in zip(block.start[first].tolist(), block.end[first + n - 1].tolist(), strict=True)]
                phrases = [(b" ".join(filter(None, p.split(b" "))) if b"  " in p else p).decode() for p in phrases]
                yield pd.DataFrame({"lang": [block.lang[i] for i in block.of[first].tolist()], "size": n, "phrase": phrases, "f": f})

    every = table.mapInPandas(count, "lang string, size int, phrase string, f long").groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f"))
    return scratch(every.where(F.col("f") >= least), "phrases")


def _wide(name: str) -> str:
    return f"cast({name} as decimal(20, 0))"


def scored(freq: DataFrame, scale: int) -> DataFrame:
    """Candidates with the cut of the lowest score: lang, size, phrase, a, l, r, score."""
    cuts = freq.where("size > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "size", "phrase", F.col("f").alias("a"), "k", F.expr("substring_index(phrase, ' ', k)").alias("left"), F.expr("substring_index(phrase, ' ', k - size)").alias("right"))
    part = lambda side, f: freq.select(F.col("lang").alias(f"{side}_lang"), F.col("phrase").alias(f"{side}_phrase"), F.col("f").alias(f))
    both = cuts.join(part("l", "l"), (F.col("lang") == F.col("l_lang")) & (F.col("left") == F.col("l_phrase")))
    both = both.join(part("r", "r"), (F.col("lang") == F.col("r_lang")) & (F.col("right") == F.col("r_phrase")))
    both = both.withColumn("score", F.expr(f"({_wide('a')} * {scale}) div ({_wide('l')} + {_wide('r')})"))
    best = F.min(F.struct("score", "k", "l", "r")).alias("best")
    return both.groupBy("lang", "size", "phrase", "a").agg(best).select("lang", "size", "phrase", "a", "best.l", "best.r", "best.score")


def covered(freq: DataFrame) -> DataFrame:
    """The largest count among longer candidates that hold a phrase: lang, phrase, longer."""
    inner = ", ".join(f"CASE WHEN size > {m} THEN transform(sequence(1, size - {m - 1}), i -> concat_ws(' ', slice(w, i, {m}))) END" for m in range(2, LONGEST))
    longer = freq.where("size > 2").withColumn("w", F.split("phrase", " ", -1))
    each = longer.select("lang", F.col("f"), F.explode(F.expr(f"flatten(filter(array({inner}), x -> x IS NOT NULL))")).alias("phrase"))
    return each.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, top: int = 2000, scale: int = 2_000_000, percent: int = 80, one_in: int = ONE_IN, longest_chunk: int = LONGEST_CHUNK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Each language's first phrases of 2 to LONGEST words: lang, rank, phrase, a, l, r, n, score.

    A phrase goes if a longer candidate that holds it has `percent` of its count or more.
    """
    d = one_name(docs, {"lang": lang_col, "text": text_col})
    table = dictionary(d.where("text is not null").select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text"), one_in, longest_chunk)
    total = table.groupBy("lang").agg(F.sum(F.col("own") * F.col("n")).alias("n"))
    freq = frequencies(table, least, block_bytes)
    held = covered(freq).select(F.col("lang").alias("c_lang"), F.col("phrase").alias("c_phrase"), "longer")
    found = scored(freq, scale).join(held, (F.col("lang") == F.col("c_lang")) & (F.col("phrase") == F.col("c_phrase")), "left")
    found = found.where(F.expr(f"longer is null or 100 * {_wide('longer')} < {percent} * {_wide('a')}"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    found = found.withColumn("rank", F.row_number().over(W.partitionBy("lang", salt).orderBy(*order))).where(F.col("rank") <= top)
    found = found.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return found.join(total.withColumnRenamed("lang", "n_lang"), F.col("lang") == F.col("n_lang")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
