"""Benchmark decontamination (2): size-partitioned MinHash containment search for test items inside documents.

Items are partitioned by their number of shingles (powers of two). In a partition whose largest item has u shingles the
sketch of an item is its k = floor((1 - t) * u) + 1 smallest shingle hashes. A document that contains t of an item's n
shingles lacks floor((1 - t) * n) at most, so it has one of its sketch at least, and k - floor((1 - t) * n) of k: such
pairs are the candidates, at any length of the document, and none is missed. Candidates are verified by exact
containment of the shingles themselves (words, not hashes). An item of fewer words than a shingle is one shingle, its
whole sequence, and so is found only in documents that are nothing else.

Items with one text are searched once. Sketches are broadcast up to max_sketch hashes (counted first); beyond it, documents'
hashes are joined to them. Texts without words contain nothing and are in nothing. Null ids come out as null. Repeated
rows are searched each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import SPACE, chunks, one_name, scratch, utf8, with_id, word_shingles

K = 5
#: Pairs of document and item that are counted at once, and shingles of items that a task remembers.
PAIRS, REMEMBERED = 1_000_000, 200_000
_ASCII = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SPACES = bytes(np.flatnonzero(SPACE).astype(np.uint8))
_TO_SPACE = bytes.maketrans(_SPACES, b" " * len(_SPACES))


def shingles(text: bytes, k: int = K) -> set[bytes]:
    """The shingles themselves: k words between single spaces, or all words of a shorter text."""
    words = [w for w in text.translate(_ASCII).translate(_TO_SPACE).split(b" ") if w]
    return {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def sketch_items(items: DataFrame, num: int, den: int, k: int = K) -> tuple[DataFrame, DataFrame]:
    """items(item_id, text) -> written tables: item, text, n, need, sketch (array of hashes), one row a text; and item, item_id."""

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, j, texts in chunks(b["text"]):
                of, h = word_shingles(texts, k)
                parts = np.split(h, np.searchsorted(of, np.arange(1, j - i)))
                yield pd.DataFrame({"item": b["item"].iloc[i:j].to_numpy(), "text": texts, "n": [len(p) for p in parts], "h": [p.view(np.int64) for p in parts]})

    texts = scratch(items.where("text is not null").select("text").distinct().withColumn("item", F.monotonically_increasing_id()), "items")
    rows = scratch(texts.mapInPandas(reduce, "item long, text binary, n int, h array<long>").where("n > 0"), "shingles")
    size_class = F.floor(F.log2("n"))
    largest = rows.groupBy(size_class.alias("size_class")).agg(F.max("n").alias("u"))
    rows = rows.withColumn("size_class", size_class).join(F.broadcast(largest), "size_class")  # one row a power of two
    lacks = lambda n: F.floor(F.lit(den - num) * F.col(n) / den).cast("int")
    rows = rows.withColumn("k", F.least(lacks("u") + 1, F.col("n")))
    sketches = scratch(rows.select("item", "text", "n", (F.col("k") - lacks("n")).alias("need"), F.slice("h", F.lit(1), F.col("k")).alias("sketch")), "sketches")
    return sketches, scratch(items.join(texts, "text").select("item", "item_id"), "members")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", num: int = 75, den: int = 100, max_sketch: int = 4_000_000) -> DataFrame:
    """One row for each item in a document: doc_id, item_id, n_shared, n_item (shingles), containment (num / den or more)."""
    d = one_name(docs, {"doc_id": id_col, "text": text_col})
    table, members = sketch_items(one_name(items, {"item_id": item_id_col, "text": item_text_col}), num, den)
    size = table.agg(F.coalesce(F.sum(F.size("sketch") + F.octet_length("text") / 8), F.lit(0))).first()[0]
    found = _broadcast_search(d, table, num, den) if size <= max_sketch else _join_search(d, table, num, den)
    return found.join(members, "item").select("doc_id", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def candidates(doc: np.ndarray, left: np.ndarray, right: np.ndarray, of: np.ndarray, need: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(documents, items) of pairs with enough hashes in common, block by block. Hash i of doc[i] is that of the items
    of[left[i]:right[i]]; doc is in order. A block has at most PAIRS pairs, or one document's hashes counted by item."""
    if not len(doc):
        return
    size = right - left
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    total = np.cumsum(np.add.reduceat(size, first))
    at = 0
    while at < len(first):
        before = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, before + PAIRS, side="right")))
        hits = slice(first[at], first[end] if end < len(first) else len(doc))
        if total[end - 1] - before <= PAIRS:
            n = size[hits]
            place = np.arange(n.sum()) + np.repeat(left[hits] - np.cumsum(n) + n, n)
            pair, seen = np.unique(np.repeat(doc[hits], n) * len(need) + of[place], return_counts=True)
            x, y = np.divmod(pair, len(need))
        else:
            count = np.zeros(len(need), np.int64)
            for i, j in zip(left[hits], right[hits], strict=True):
                count[of[i:j]] += 1
            y = np.flatnonzero(count)
            x, seen = np.full(len(y), doc[first[at]]), count[y]
        enough = seen >= need[y]
        yield x[enough], y[enough]
        at = end


def _broadcast_search(docs: DataFrame, table: DataFrame, num: int, den: int) -> DataFrame:
    rows = table.orderBy("item").toPandas()
    sketch = np.concatenate([np.asarray(s, np.int64) for s in rows["sketch"]] or [np.zeros(0, np.int64)]).view(np.uint64)
    of = np.repeat(np.arange(len(rows)), [len(s) for s in rows["sketch"]]).astype(np.int64)
    order = np.argsort(sketch, kind="stable")
    shared = docs.sparkSession.sparkContext.broadcast((sketch[order], of[order], rows["need"].to_numpy(), rows["item"].to_numpy(), [bytes(t) for t in rows["text"]]))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, of, need, ids, item_texts = shared.value
        words: dict[int, set[bytes]] = {}
        held = 0
        for b in batches:
            ids_of_docs, out = b["doc_id"], []
            for i, _, texts in chunks(b["text"]) if len(keys) else ():
                doc, h = word_shingles(texts, K)
                left, right = np.searchsorted(keys, h, side="left"), np.searchsorted(keys, h, side="right")
                hit = np.flatnonzero(right > left)
                own: tuple[int, set[bytes]] = (-1, set())
                for xs, ys in candidates(doc[hit], left[hit], right[hit], of, need):
                    for x, y in zip(xs.tolist(), ys.tolist(), strict=True):
                        if y not in words:
                            if held > REMEMBERED:
                                words, held = {}, 0
                            words[y] = shingles(item_texts[y])
                            held += len(words[y])
                        own = own if own[0] == x else (x, shingles(texts[x]))
                        both = len(words[y] & own[1])
                        if den * both >= num * len(words[y]):
                            out.append((ids_of_docs.iloc[i + x], ids[y], both, len(words[y])))
            yield pd.DataFrame(out, columns=["doc_id", "item", "n_shared", "n_item"])

    return with_id(docs, search, "doc_id long, item long, n_shared long, n_item long")


def _join_search(docs: DataFrame, table: DataFrame, num: int, den: int) -> DataFrame:
    docs = scratch(docs.withColumn("row", F.monotonically_increasing_id()), "docs")

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, j, texts in chunks(b["text"]):
                of, h = word_shingles(texts, K)
                yield pd.DataFrame({"row": b["row"].to_numpy()[i:j][of], "h": h.view(np.int64)})

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            a = [shingles(t) for t in b["item_text"]]
            both = np.array([len(x & shingles(t)) for x, t in zip(a, map(utf8, b["text"]), strict=True)], np.int64)
            n = np.array([len(x) for x in a], np.int64)
            out = b[["doc_id", "item"]].assign(n_shared=both, n_item=n)
            yield out[den * both >= num * n]

    found = docs.select("row", "text").mapInPandas(hashes, "row long, h long").join(table.select("item", "need", F.explode("sketch").alias("h")), "h")
    pairs = found.groupBy("row", "item").agg(F.count("*").alias("n"), F.first("need").alias("need")).where("n >= need").select("row", "item")
    wide = pairs.join(docs, "row").join(table.select("item", F.col("text").alias("item_text")), "item")
    return with_id(wide, verify, "doc_id long, item long, n_shared long, n_item long")
