"""Document fingerprints (4): threshold-scaled sketch of word shingles.

A sketch keeps every shingle hash below a fixed fraction of all hashes, so sketches of unequal texts are comparable
and the sketch of a union is the union of sketches. The smallest hash is always kept, so that a text with a word
has no empty sketch; merge() keeps it that way. Written as "s<one in>:" and the hashes, 8 bytes each, ascending, in base64.

Null and empty texts: no hashes; likeness and containment with them are 0, of two of them 1.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import chunks, one_name, with_id, word_shingles

ONE_IN = 2
#: Documents that are put in order in one group, and the most groups.
GROUP, GROUPS = 256, 8192


def limit(one_in: int) -> np.uint64:
    return np.uint64((2**64 - 1) // one_in)


def sketches(texts: list[bytes], one_in: int = ONE_IN, k: int = 5) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for i, j, part in chunks(texts):
        of, h = word_shingles(part, k)
        keep = h <= limit(one_in)
        keep[np.concatenate([[True], of[1:] != of[:-1]])[: len(of)]] = True
        of, h = of[keep], h[keep]
        out += np.split(h, np.searchsorted(of, np.arange(1, j - i)))
    return out


def written(sketch: np.ndarray, one_in: int = ONE_IN) -> str:
    return f"s{one_in}:{base64.b64encode(sketch.astype('>u8').tobytes()).decode()}"


def one_in_of(fingerprint: str) -> int:
    return int(fingerprint.partition(":")[0][1:])


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint.partition(":")[2]), ">u8").astype(np.uint64)


def merge(a: str, b: str) -> str:
    """The fingerprint of both texts' shingles together. Both must have one fraction."""
    one_in = one_in_of(a)
    if one_in != one_in_of(b):
        raise ValueError("fingerprints of different fractions")
    both = np.union1d(read(a), read(b))
    return written(both[: max(1, int(np.searchsorted(both, limit(one_in), side="right")))], one_in)


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimate of the Jaccard similarity."""
    return n / (len(a) + len(b) - n) if (n := _shared(a, b)) else float(not len(a) and not len(b))


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimate of the share of a's shingles that b has."""
    return _shared(a, b) / len(a) if len(a) else float(not len(b))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", one_in: int = ONE_IN) -> DataFrame:
    """doc_id, fingerprint of each row."""

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [("" if t is None else t).encode("utf-8", "surrogatepass") for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "fingerprint": [written(s, one_in) for s in sketches(texts, one_in)]})

    return with_id(one_name(docs, {"doc_id": id_col, "text": text_col}), sketch, "doc_id long, fingerprint string")


def with_next(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) dealt so that each document stands before the next by descending doc_id: of, last, key, doc_id, text.

    Ids are cut at quantiles into groups; the first document of each group also goes, as `last`, to the end of the group
    before it, and the very first to the end of the very last. Rows of one id are ordered by text, a null id is the lowest.
    """
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = docs.count()
    groups = max(1, min(GROUPS, n // GROUP))
    cuts = docs.stat.approxQuantile("key", [i / groups for i in range(1, groups)], 1 / (4 * groups)) if groups > 1 else []
    edges = docs.sparkSession.sparkContext.broadcast(np.unique(np.array(cuts, dtype=np.float64)))
    group = F.pandas_udf(lambda key: pd.Series(-np.searchsorted(edges.value, key.to_numpy().astype(np.float64), side="left")), "long")
    firsts = docs.select("key").withColumn("of", group("key")).groupBy("of").agg(F.max("key").alias("key")).orderBy("of").collect()
    before = {r["key"]: firsts[i - 1]["of"] for i, r in enumerate(firsts)}
    to = docs.sparkSession.sparkContext.broadcast((np.array(sorted(before), np.int64), np.array([before[k] for k in sorted(before)], np.int64)))

    def also(key: pd.Series) -> pd.Series:
        keys, groups_ = to.value
        k = key.to_numpy()
        at = np.minimum(np.searchsorted(keys, k), max(0, len(keys) - 1))
        own = -np.searchsorted(edges.value, k.astype(np.float64), side="left")
        return pd.Series([[o, groups_[a]] if keys[a] == x else [o] for o, a, x in zip(own, at, k, strict=True)])

    dealt = docs.withColumn("to", F.pandas_udf(also, "array<long>")("key")).select(F.posexplode("to").alias("last", "of"), "key", "doc_id", "text")
    return dealt.repartition("of").sortWithinPartitions("of", "last", F.desc("key"), "text")


def edited(text: str, following: str) -> str:
    """The last third (rounded down) of the code points replaced by as many of the next text, or all it has."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def compare_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", one_in: int = ONE_IN) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, in_edited (containment in the edited text)."""
    rows = with_next(one_name(docs, {"doc_id": id_col, "text": text_col}))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail = None
        for batch in batches:
            batch = batch if tail is None else pd.concat([tail, batch], ignore_index=True)
            tail = batch.iloc[-1:]
            of, last, text = batch["of"].to_numpy(), batch["last"].to_numpy(), batch["text"].tolist()
            own = [i for i in range(len(batch) - 1) if not last[i] and of[i] == of[i + 1]]
            for at in range(0, len(own), 200):
                part = own[at : at + 200]
                new = [edited(text[i], text[i + 1]).encode("utf-8", "surrogatepass") for i in part]
                old = sketches([text[i].encode("utf-8", "surrogatepass") for i in range(part[0], part[-1] + 2)], one_in)
                changed = sketches(new, one_in)
                out = []
                for i, e, c in zip(part, new, changed, strict=True):
                    a, following = old[i - part[0]], old[i + 1 - part[0]]
                    out.append((batch["doc_id"].iloc[i], len(text[i]), hashlib.sha256(e).hexdigest(), written(a, one_in), written(c, one_in), likeness(a, c), likeness(a, following), containment(a, c)))
                yield pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "in_edited"])

    return with_id(rows, compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, in_edited double")
