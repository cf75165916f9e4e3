"""Pieces that several operators share: scratch tables, word shingles as numbers, keys held by two rows."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that end a word: space and \t \n \v \f \r.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, all other bytes as they are; safe within UTF-8.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_ODD = 0x9E3779B97F4A7C15
_WORD = np.uint64(_ODD)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of each 64-bit number over all bits (one to one)."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


#: A random-looking odd number for each byte value, the same on every worker.
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _WORD) | np.uint64(1)
#: Spark's setting for the bytes of a batch, and the value where it is unset.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20)
#: Rows that a task holds against one another before it sends them on.
BLOCK = 1_000_000
#: Bytes of a chunk of texts; powers of the bases are kept by workers up to so many.
CHUNK, KEPT_POWERS = 500_000, 1 << 20
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = 1099511628211) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i = 0..n, grown by doubling; those of a very long text aren't kept."""
    have = _tables.get(base)
    if have is None or len(have[0]) <= n:
        size = 1 << max(16, int(n).bit_length())
        have = tuple(np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(size, b, np.uint64))]) for b in (base, pow(base, -1, 2**64)))
        if size <= KEPT_POWERS:
            _tables[base] = have
    return have


def prefix_sums(data: np.ndarray, base: int = 1099511628211) -> np.ndarray:
    """Sums from which span_hash() takes the hash of any span of the bytes."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * powers(len(data), base)[0][: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = 1099511628211) -> np.ndarray:
    """Hash of bytes start..end, the same wherever they stand."""
    return mix((sums[end] - sums[start]) * powers(len(sums), base)[1][start] + (end - start).astype(np.uint64) * _WORD)


def word_shingles(texts: list[bytes], k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text: (index of the text, hash), ordered by both.

    Words are runs of bytes that aren't white space, A-Z lower-cased. A text of 1 to k-1 words has its
    whole sequence as its one shingle, a text without words has none.
    """
    joined = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    ends_of_text = np.cumsum([len(t) + 1 for t in texts])
    inside = np.concatenate([[False], ~SPACE[joined], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word = span_hash(prefix_sums(joined), start, end)
    text = np.searchsorted(ends_of_text, start, side="right")
    n = np.bincount(text, minlength=len(texts))
    first = np.cumsum(n) - n
    h = np.full(max(0, len(word) - k + 1), np.uint64(k))
    for i in range(k):
        h = mix(h + word[i : i + len(h)] * _WORD) if i else h + word[: len(h)]
    whole = text[: len(h)] == text[k - 1 :] if len(h) else np.zeros(0, bool)
    of, got = text[: len(h)][whole], h[whole]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        s = n[short].astype(np.uint64)
        for i in range(k - 1):
            has = n[short] > i
            s = np.where(has, mix(s + word[np.minimum(first[short] + i, len(word) - 1)] * _WORD), s)
        of, got = np.concatenate([of, short]), np.concatenate([got, s])
    order = np.lexsort((got, of))
    of, got = of[order], got[order]
    keep = np.ones(len(of), bool)
    keep[1:] = (of[1:] != of[:-1]) | (got[1:] != got[:-1])
    return of[keep], got[keep]


def utf8(text: object) -> bytes:
    """UTF-8 of a text; null is empty."""
    return b"" if text is None or text is pd.NA or text != text else text.encode("utf-8", "surrogatepass")


def chunks(texts: Iterable[object], size: int = CHUNK) -> Iterator[tuple[int, int, list[bytes]]]:
    """Ranges of a column with the UTF-8 of their texts, of about so many bytes, so that the arrays of a chunk stay small; a longer text is alone."""
    at, total, held = 0, 0, []
    for i, t in enumerate(texts):
        t = t if isinstance(t, bytes) else utf8(t)
        if total and total + len(t) > size:
            yield at, i, held
            at, total, held = i, 0, []
        held.append(t)
        total += len(t)
    if held:
        yield at, at + len(held), held


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches that texts go to Python in by their bytes, unless the session does: 10,000 rows of texts are much memory."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; only where it is unset and all is one machine, as in tests, an own one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir isn't set: executors need a folder that all share")
        base = tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return base


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows to a new table in the shared folder and reads it: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def sized(df: DataFrame, rows: int, per_task: int = 200_000) -> DataFrame:
    """The same rows for a table of at most so many, in no more tasks and files than they are worth; at least eight."""
    return df.coalesce(max(8, -(-rows // per_task)))


def drop(*tables: DataFrame | None) -> None:
    """Deletes tables of scratch() that nothing reads any more: what was made of them is written."""
    for t in tables:
        if t is not None:
            spark = t.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(t.scratch_path)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def held_twice(rows: DataFrame, once: bool = False) -> DataFrame:
    """Of rows (slot long, key long, a long, b long, known boolean), those whose key two different (a, b) hold.

    once: the others. Blocks made by block_rows() have found the keys that are repeated within them: these rows
    are known, and are dealt out by a number of their own (with once they stay away); only one row a key and
    block comes here by its key. So the rows of a key that meet in one task are as many as there are blocks,
    however many rows hold the key. Rows are compared with their neighbours in sorted order, one batch at a time.
    Rows with equal slot and key have the same key; where rows have no column key, slot alone decides.
    """
    by = [c for c in ("slot", "key") if c in rows.columns]
    out = [c for c in ("key", "a", "b") if c in rows.columns]
    dealt = rows.repartition("slot").sortWithinPartitions(*by)

    def pick(batch: pd.DataFrame, edge: np.ndarray) -> pd.DataFrame:
        a, b, known = (batch[c].to_numpy() for c in ("a", "b", "known"))
        first = np.concatenate([[0], np.flatnonzero(edge) + 1])
        run = np.concatenate([[0], np.cumsum(edge)])
        held = np.logical_or.reduceat((a != a[first][run]) | (b != b[first][run]) | known, first)[run]
        return batch.loc[held != once, out]

    def neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail = None
        for batch in batches:
            if not len(batch):
                continue
            if tail is not None:
                batch = pd.concat([tail, batch], ignore_index=True)
            edge = np.logical_or.reduce([(v := batch[c].to_numpy())[1:] != v[:-1] for c in by])
            cuts = np.flatnonzero(edge)
            cut = int(cuts[-1]) + 1 if len(cuts) else 0
            tail = batch.iloc[cut:]
            if cut:
                yield pick(batch.iloc[:cut], edge[: cut - 1])
        if tail is not None:
            yield pick(tail, np.zeros(len(tail) - 1, bool))

    return dealt.mapInPandas(neighbours, ", ".join(f"{c} long" for c in out))


def block_rows(slot: np.ndarray, a: np.ndarray, b: np.ndarray, key: np.ndarray | None = None, once: bool = False, dedupe: bool = False) -> pd.DataFrame:
    """Rows of one block for held_twice(): of each key repeated here, one row goes by its key, the rest by themselves.

    key: further bits of the key, or None. Rows of equal (slot, key) are known to each other if their (a, b) differ.
    once, dedupe: the rest stays away.
    """
    order = np.argsort(slot, kind="stable") if key is None else np.lexsort((key, slot))
    cols = {"slot": slot[order], **({} if key is None else {"key": key[order]}), "a": a[order].astype(np.int64), "b": b[order].astype(np.int64)}
    lead = np.ones(len(order), bool)
    if len(order):
        lead[1:] = np.logical_or.reduce([cols[c][1:] != cols[c][:-1] for c in ("slot", "key") if c in cols])
    fresh = lead.copy()
    for c in ("a", "b"):
        fresh[1:] |= cols[c][1:] != cols[c][:-1]
    cols = {c: v[fresh] for c, v in cols.items()}
    lead = lead[fresh]
    known = ~lead
    known[:-1] |= ~lead[1:]
    own = mix(cols["a"].view(np.uint64) * _WORD + cols["b"].view(np.uint64) + np.uint64(77))
    cols["slot"] = np.where(lead, cols["slot"], own)
    cols = {c: v.view(np.int64) if v.dtype == np.uint64 else v for c, v in cols.items()} | {"known": known}
    keep = lead if once or dedupe else np.ones(len(lead), bool)
    cols = {c: v[keep] for c, v in cols.items()}
    back = np.argsort(cols["a"], kind="stable")  # rows of one text together: they compress
    return pd.DataFrame({c: v[back] for c, v in cols.items()})


def blocks(parts: Iterable[tuple[np.ndarray, ...]], **how: bool) -> Iterator[pd.DataFrame]:
    """block_rows() of about a million rows of (slot, a, b[, key]), whatever batches they come from."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n > BLOCK:
            yield block_rows(*map(np.concatenate, zip(*held, strict=True)), **how)
            held, n = [], 0
    if n:
        yield block_rows(*map(np.concatenate, zip(*held, strict=True)), **how)


def free(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of steps whose results are written: it does so when their handles are collected."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def with_id(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, id_col: str = "doc_id") -> DataFrame:
    """mapInPandas() with a long id, null or not, that comes out as it went in: as whole numbers beside a null become doubles in pandas, it goes as text."""
    held, own = f"{id_col} long", f"{id_col} string"
    out = df.withColumn(id_col, F.col(id_col).cast("string")).mapInPandas(run, schema.replace(held, own, 1))
    return out.withColumn(id_col, F.col(id_col).cast("long"))


def one_name(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Selects the wanted columns under the operator's own names, so that no other column can clash."""
    small_batches(df.sparkSession)
    return df.select(*[F.col(f"`{c}`").alias(own) for own, c in wanted.items()])
