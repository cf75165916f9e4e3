"""Suffix-array dedup (9): distributed difference-cover algorithm, cut off at the length that counts.

Of all suffixes only the order by their first `length` bytes matters, so it is:

1. Sort sampled tuples: positions whose residue modulo v is in a perfect difference set D (v = q*q+q+1, |D| = q+1)
   are named by their first length-v+1 bytes and sorted by name. Any two positions i, j have a d < v with
   both i+d and j+d sampled, so of two equal strings of `length` bytes two sampled tuples are equal neighbours.
2. Recurse on names: a repeated tuple is named again with what stands around it, by PARTS ranges of d: by the
   bytes that all strings with such a d share (narrow), and by the bytes that all of them cover (wide). Sorted by
   both: a narrow name that nobody else has rules its starts out; a wide name that two have proves them repeated;
   starts between (at the ends of matches) stay open.
3. Merge the remaining suffixes: open starts, and one holder of each proven name beside them, sampled or
   not, are named by all `length` bytes and sorted.
4. Compare adjacent prefixes: an open start without an equal neighbour is single; all others are repeated.

What proves a repeat is equal in 128 bits. Exact copies are one text from the start: each of `length` bytes or more
is removed whole. All texts are shuffled once, those with a repeated tuple are then kept in a table. A key that
very many rows hold comes to its task once a block (see held_twice). No text, null or a text shorter than
`length`: nothing is removed. Rows with equal or null doc_id are separate documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import blocks, free, held_twice, mix, one_name, prefix_sums, scratch, span_hash, utf8, with_id

#: A second base, for the other half of a 128-bit name.
BASE2 = 0x27D4EB2F165667C5
#: Ranges of d that a repeated tuple is named again by.
PARTS = 4
NONE, OPEN, HOLDER = range(3)


@cache
def difference_cover(q: int) -> tuple[int, np.ndarray]:
    """v and a set of q+1 residues in which every difference modulo v = q*q+q+1 occurs; q is a prime.

    Singer's construction: powers of a root of x^3 = a x^2 + b x + c over the field of q numbers, as points of
    the projective plane; those on a line are the set.
    """
    v = q * q + q + 1
    for a, b, c in product(range(q), range(q), range(1, q)):
        point, seen, line = (0, 0, 1), set(), []
        for k in range(v):
            lead = next(x for x in point if x)
            seen.add(tuple(x * pow(lead, -1, q) % q for x in point))
            if len(seen) <= k:
                break
            if not point[0]:
                line.append(k)
            x2, x1, x0 = point
            point = ((x1 + a * x2) % q, (x0 + b * x2) % q, c * x2 % q)
        else:
            return v, np.array(line)
    raise ValueError("q must be a prime")


def cover_for(length: int) -> tuple[int, np.ndarray]:
    """The largest cover of primes whose v leaves tuples of about a fifth of the length."""
    fit = [q for q in (2, 3, 5, 7, 11, 13, 17, 19, 23) if q * q + q + 1 <= max(7, length * 0.78)]
    return difference_cover(fit[-1])


def sampled(n: int, width: int, v: int, residues: np.ndarray) -> np.ndarray:
    """Sampled positions with `width` bytes to their right in n bytes."""
    at = (np.arange(0, max(0, n - width) + 1, v)[:, None] + residues[None, :]).ravel()
    return at[at <= n - width]


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edge[::2], edge[1::2]


def parts_of(length: int, v: int, n: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For repeated tuples at `at`: part number, and the first and last start of each part with any start in n bytes.

    Part k has the starts at-d, d from k*g to k*g+g-1. Its code is at * PARTS + k.
    """
    g = -(-v // PARTS)
    k = np.tile(np.arange(PARTS), len(at))
    at = np.repeat(at, PARTS)
    last, first = at - k * g, at - np.minimum(k * g + g, v) + 1
    some = (last >= 0) & (first + length <= n)
    return (at * PARTS + k)[some], first[some], last[some]


def _around(length: int, v: int, tid: int, text: bytes, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Narrow name, id, code and wide name of each part; where a wide name would pass the ends of the text, one of its own."""
    sums = prefix_sums(np.frombuffer(text, np.uint8))
    code, first, last = parts_of(length, v, len(text), at)
    narrow = mix(span_hash(sums, last, first + length) + (code % PARTS + 1).astype(np.uint64))
    inside = (first >= 0) & (last + length <= len(text))
    wide = span_hash(sums, np.where(inside, first, 0), np.where(inside, last + length, 0))
    own = mix(code.astype(np.uint64) ^ mix(np.full(len(code), tid).view(np.uint64)))
    return narrow, np.full(len(code), tid), code, np.where(inside, wide, own)


def _states(rows: DataFrame) -> DataFrame:
    """Parts (a, b) that aren't proven, and one proven holder of each name beside them: state NONE, OPEN or HOLDER."""

    def judge(batch: pd.DataFrame) -> pd.DataFrame:
        slot, key, known = (batch[c].to_numpy() for c in ("slot", "key", "known"))
        name = np.concatenate([[True], slot[1:] != slot[:-1]])
        first = np.flatnonzero(name | np.concatenate([[True], key[1:] != key[:-1]]))
        proven = (np.diff(np.append(first, len(slot))) > 1) | np.logical_or.reduceat(known, first)
        group = np.cumsum(name)[first] - 1
        several = np.bincount(group)[group] > 1
        state = np.where(several, np.where(proven, HOLDER, OPEN), NONE)
        keep = several | ~proven
        return batch.iloc[first[keep]][["a", "b"]].assign(state=state[keep].astype(np.int32))

    def groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail = None
        for batch in batches:
            if not len(batch):
                continue
            batch = batch if tail is None else pd.concat([tail, batch], ignore_index=True)
            slot = batch["slot"].to_numpy()
            cut = int(np.searchsorted(slot, slot[-1]))
            tail = batch.iloc[cut:]
            if cut:
                yield judge(batch.iloc[:cut])
        if tail is not None:
            yield judge(tail)

    return rows.repartition("slot").sortWithinPartitions("slot", "key").mapInPandas(groups, "a long, b long, state int")


def _repeated_tuples(docs: DataFrame, length: int) -> DataFrame:
    """(tid, at): the repeated sampled tuples of each text."""
    v, residues = cover_for(length)
    width = length - v + 1

    def tuples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def named() -> Iterator[tuple[np.ndarray, ...]]:
            for batch in batches:
                for tid, text in zip(batch["tid"].to_numpy(), map(utf8, batch["text"]), strict=True):
                    at = sampled(len(text), width, v, residues)
                    yield span_hash(prefix_sums(np.frombuffer(text, np.uint8)), at, at + width), np.full(len(at), tid), at

        return blocks(named())

    rows = docs.select("tid", "text").mapInPandas(tuples, "slot long, a long, b long, known boolean")
    return scratch(held_twice(rows).groupBy(F.col("a").alias("tid")).agg(F.collect_set("b").alias("at")), "tuples")


def _narrow(docs: DataFrame, texts: DataFrame, found: DataFrame) -> DataFrame:
    """(single, tid, text, at) of the texts that have a repeated tuple. single: no other document has the text."""
    found = found.join(texts.select("tid", "rep", (F.col("copies") == 1).alias("single")), "tid")
    joined = docs.select("rep", "tid", F.col("text").cast("binary").alias("text")).join(found, ["rep", "tid"])
    return scratch(joined.dropDuplicates(["rep", "tid"]).drop("rep"), "narrow")


def _judged(narrow: DataFrame, length: int) -> DataFrame:
    """(tid, none, open, holder): codes of parts."""
    v, _ = cover_for(length)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return blocks((_around(length, v, tid, text, np.sort(at)) for b in batches for tid, text, at in zip(b["tid"], b["text"], b["at"], strict=True)), dedupe=True)

    states = _states(narrow.select("tid", "text", "at").mapInPandas(rows, "slot long, key long, a long, b long, known boolean"))
    of = {"none": NONE, "open": OPEN, "holder": HOLDER}
    return scratch(states.groupBy(F.col("a").alias("tid")).agg(*[F.collect_list(F.when(F.col("state") == n, F.col("b"))).alias(c) for c, n in of.items()]), "judged")


def _starts(length: int, v: int, n: int, at: np.ndarray, none: np.ndarray, open_: np.ndarray, holder: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each start: is it proven; open; to be named."""
    code, first, last = parts_of(length, v, n, np.sort(at))
    first, last = np.maximum(first, 0), np.minimum(last, n - length)
    marks = []
    for which in (~np.isin(code, np.concatenate([none, open_])), np.isin(code, open_), np.isin(code, holder)):
        edge = np.bincount(first[which], minlength=n - length + 2) - np.bincount(last[which] + 1, minlength=n - length + 2)
        marks.append(np.cumsum(edge[: n - length + 1]) > 0)
    proven, opened, held = marks
    return proven, opened & ~proven, opened | held  # what is proven elsewhere may be all that an open start equals


def _codes(x: object) -> np.ndarray:
    return np.zeros(0, np.int64) if x is None else np.asarray(x, np.int64)


def _singles(narrow: DataFrame, judged: DataFrame, length: int) -> DataFrame:
    """(tid, single): open starts that no other start equals."""
    v, _ = cover_for(length)

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def windows() -> Iterator[tuple[np.ndarray, ...]]:
            for batch in batches:
                for tid, text, *codes in zip(*(batch[c] for c in ("tid", "text", "at", "none", "open", "holder")), strict=True):
                    data = np.frombuffer(text, np.uint8)
                    at = np.flatnonzero(_starts(length, v, len(text), *map(_codes, codes))[2])
                    yield span_hash(prefix_sums(data), at, at + length), np.full(len(at), tid), at, span_hash(prefix_sums(data, BASE2), at, at + length, BASE2)

        return blocks(windows(), once=True)

    rows = narrow.drop("single").join(judged.where("size(open) > 0 or size(holder) > 0"), "tid").mapInPandas(named, "slot long, key long, a long, b long, known boolean")
    return scratch(held_twice(rows, once=True).groupBy(F.col("a").alias("tid")).agg(F.collect_set("b").alias("single")), "singles")


def repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, starts, ends (removed byte spans), kept (bytes that are left)."""
    v, _ = cover_for(length)
    rep = F.coalesce("doc_id", F.lit(-(2**63))).alias("rep")
    docs = docs.select("doc_id", rep, F.coalesce("text", F.lit("")).alias("text")).withColumn("tid", F.xxhash64("text"))
    sha = F.sha2("text", 256).alias("sha")
    long = docs.where(F.octet_length("text") >= length)
    texts = scratch(long.select("rep", "tid", sha).groupBy("tid", "sha").agg(F.min("rep").alias("rep"), F.count("*").alias("copies")), "texts")
    found = _repeated_tuples(long, length)
    free(docs.sparkSession)
    narrow = _narrow(long, texts, found)
    free(docs.sparkSession)
    judged = _judged(narrow, length)
    free(docs.sparkSession)
    singles = _singles(narrow, judged, length)
    free(docs.sparkSession)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for tid, text, *codes, single in zip(*(batch[c] for c in ("tid", "text", "at", "none", "open", "holder", "single")), strict=True):
                proven, opened, _ = _starts(length, v, len(text), *map(_codes, codes))
                opened[_codes(single)[opened[_codes(single)]]] = False
                i, j = runs(proven | opened)
                if len(i):
                    edge = np.bincount(i, minlength=len(text) + 1) - np.bincount(j - 1 + length, minlength=len(text) + 1)
                    s, e = runs(np.cumsum(edge)[: len(text)] > 0)
                    out.append((tid, hashlib.sha256(text).hexdigest(), s.astype(np.int64), e.astype(np.int64)))
            if out:
                yield pd.DataFrame(out, columns=["tid", "sha", "starts", "ends"])

    spans = narrow.where("single").drop("single").join(judged, "tid", "left").join(singles, "tid", "left").mapInPandas(cut, "tid long, sha string, starts array<long>, ends array<long>")
    whole = texts.where("copies > 1").select("tid", "sha", F.lit(None).cast("array<long>").alias("starts"), F.lit(None).cast("array<long>").alias("ends"))
    # one row a text: of the documents that share a text, however many, Spark can split the join
    gone = scratch(spans.union(whole).withColumn("some", F.lit(True)), "spans")

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                b = batch.iloc[at : at + 1000]
                n, spans, kept = [], [], []
                for text, some, starts, ends in zip(b["text"], b["some"], b["starts"], b["ends"], strict=True):
                    n.append(len(text))
                    cuts = ([], []) if some is not True else ([0], [len(text)]) if starts is None else (starts, ends)
                    spans.append(cuts)
                    kept.append(b"".join(text[i:j] for i, j in zip([0, *cuts[1]], [*cuts[0], len(text)], strict=True)))
                yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy(), "n_bytes": n, "starts": [s for s, _ in spans], "ends": [e for _, e in spans], "kept": kept})

    rows = docs.select("doc_id", "tid", sha, F.col("text").cast("binary").alias("text")).join(gone, ["tid", "sha"], "left")
    return with_id(rows.select("doc_id", "text", "some", "starts", "ends"), keep, "doc_id long, n_bytes long, starts array<long>, ends array<long>, kept binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400) -> DataFrame:
    """repeats() over the named columns. No documents: no rows."""
    return repeats(one_name(docs, {"doc_id": id_col, "text": text_col}), length)


def digest(found: DataFrame) -> DataFrame:
    """The outcome by number; n_kept and text are what is left, with a mark where a cut went through a character."""
    removed = F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda x, y: x + y)
    left = (F.octet_length("kept").cast("long").alias("n_kept"), F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), *left)
