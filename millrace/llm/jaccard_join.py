"""N-gram Jaccard join (8): grouped prefix join over distinct word shingles.

Two documents whose sets have a Jaccard similarity of t or more share at least one of the first
n - ceil(t * n) + 1 shingles of each, in any one order of all shingles. The order here puts the shingles
that very many documents hold last and is by hash otherwise; which those are only decides how much work there is.

1. Every document is reduced to its number of shingles, a 128-bit digest of its set, a digest of
   (size, prefix) that names its group, a parity bitmap, and its prefix. Documents with one set are one class;
   documents with identical prefix and size are one group, and a task sends a group's prefix on once.
2. Prefix shingles that two groups hold make group pairs; they are expanded to the classes of each group.
   A shingle's positions in two sets bound what they share if it is the first that they share: other pairs are
   left to that first one. A short parity sketch rules out most of what is left before a pair is made.
3. Of the classes of a shingle, each is first held against one leader, that of the smallest doc_id (linear, not all
   pairs; copies tend to come after what they are copies of), filtered by
   the parity bitmaps' lower bound of the symmetric difference, and verified on the sets themselves.
   A group that isn't one component by then goes on: classes outside its largest component are held against
   those of all other components, all at once in groups of SMALL, in larger ones LEADERS and then four times as many
   a round, until nothing is left outside. No link between components is lost.

Shingles are 64-bit hashes. Nulls, empty texts: no shingles, no links. Classes and links go by a number of
the row, written by the caller or the 64-bit hash of id and text (equal for repeated rows only, which are of one class
anyway), so rows with equal doc_id, or none, are documents of their own and share a component only if they link. A component is named by its smallest doc_id (null if no row of it has one), so
two components of rows with one doc_id may have one name; first_row of numbered_components() tells them apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import components
from millrace.llm.shared import blocks, chunks, drop, free, held_twice, mix, one_name, scratch, sized, small_batches, word_shingles

#: Largest group whose unconnected classes are compared all with all.
SMALL = 64
#: About so many classes of a larger group are held against all others in the first such round. A group of near copies
#: meets in many shingles, in each with leaders of its own.
LEADERS = 256
#: Ids of candidates up to this number are broadcast (8 bytes each); more are shuffled.
BROADCAST_IDS = 1_000_000
#: 64-bit words of the parity sketch that every class of a shingle carries.
SKETCH = [f"s{i}" for i in range(4)]
#: A shingle that so many documents hold goes to the end of the order, if it is one of the MOST commonest.
COMMON, MOST = 16, 1_000_000
BLOCK = 4_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def common_shingles(docs: DataFrame, k: int = 5) -> np.ndarray:
    """Sorted hashes of the most common shingles, at most MOST of them, that COMMON documents or more hold.

    Tasks leave out what fewer than three documents of a block of BLOCK shingles hold. What is missing here costs time and no link.
    """

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in chain(batches, [None]):
            for _, _, texts in () if batch is None else chunks(batch["text"]):
                held.append(word_shingles(texts, k)[1])
                size += len(held[-1])
            if size > BLOCK or batch is None and size:
                h = np.sort(np.concatenate(held))
                held, size = [], 0
                first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                n = np.diff(np.append(first, len(h)))
                yield pd.DataFrame({"h": h[first[n > 2]].view(np.int64), "n": n[n > 2].astype(np.int64)})

    found = docs.select("text").mapInPandas(local, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    rows = found.where(F.col("n") >= COMMON).orderBy(F.desc("n"), "h").limit(MOST).select("h").toPandas()
    return np.sort(rows["h"].to_numpy(dtype=np.int64, na_value=0).view(np.uint64))


def _parity(h: np.ndarray) -> bytes:
    """Bit i: whether an odd number of the set's hashes falls on i; as many bits as the next power of two of the size."""
    bits = 1 << max(6, min(16, (len(h) - 1).bit_length()))
    return np.packbits((np.bincount((h % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def _apart(x: bytes, y: bytes) -> int:
    """At least so many shingles are in one of the sets only."""
    a, b = np.unpackbits(np.frombuffer(x, np.uint8)), np.unpackbits(np.frombuffer(y, np.uint8))
    if len(a) > len(b):
        a, b = b, a
    b = np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0) if len(b) > len(a) else b
    return int((a ^ b).sum())


def reduced(docs: DataFrame, common: np.ndarray, num: int, den: int, k: int) -> DataFrame:
    """docs(row, doc_id, no_id, text) -> (row, doc_id, no_id, n, d1, d2, grp, parity, prefix, SKETCH): prefix is null where
    the task has sent on that of the group before."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often, sent = shared.value, set()
        for batch in batches:
            ids = batch[["row", "doc_id", "no_id"]]
            for i, j, texts in chunks(batch["text"]):
                of, h = word_shingles(texts, k)
                n = np.bincount(of, minlength=j - i)
                out = {c: ids[c].to_numpy()[i:j] for c in ids} | {"n": n.astype(np.int32)}
                d1, d2, grp = (np.zeros(j - i, np.uint64) for _ in range(3))
                parity, prefix, sketch = [None] * (j - i), [None] * (j - i), np.zeros((j - i, len(SKETCH)), np.int64)
                some = np.flatnonzero(n)
                if len(some):
                    first = (np.cumsum(n) - n)[some]
                    d1[some] = np.add.reduceat(mix(h * _ODD), first)
                    d2[some] = np.bitwise_xor.reduceat(mix(h + _ODD), first)
                    late = np.zeros(len(h), bool)
                    if len(often):
                        late = often[np.minimum(np.searchsorted(often, h), len(often) - 1)] == h
                    order = np.lexsort((h, late, of))
                    keep = n - (num * n + den - 1) // den + 1
                    rank = np.arange(len(h)) - np.repeat(first, n[some])
                    taken = rank < np.repeat(keep[some], n[some])
                    tokens = h[order][taken]
                    at = np.cumsum(keep[some]) - keep[some]
                    grp[some] = mix(np.add.reduceat(mix(tokens + np.uint64(5)), at) + n[some].astype(np.uint64) * _ODD)
                    odd = np.bincount(of * 64 * len(SKETCH) + (h % np.uint64(64 * len(SKETCH))).astype(np.int64), minlength=64 * len(SKETCH) * (j - i)) & 1
                    sketch = np.packbits(odd.astype(np.uint8).reshape(j - i, -1), axis=1).view(np.int64)
                    for d, f, a in zip(some, first, at, strict=True):
                        parity[d] = _parity(h[f : f + n[d]])
                        if (g := int(grp[d])) not in sent:
                            sent.add(g)
                            prefix[d] = tokens[a : a + keep[d]].view(np.int64)
                yield pd.DataFrame(out | {"d1": d1.view(np.int64), "d2": d2.view(np.int64), "grp": grp.view(np.int64), "parity": parity, "prefix": prefix} | dict(zip(SKETCH, sketch.T, strict=True)))

    words = ", ".join(f"{c} long" for c in SKETCH)
    return docs.mapInPandas(reduce, f"row long, doc_id long, no_id boolean, n int, d1 long, d2 long, grp long, parity binary, prefix array<long>, {words}")


def _group_rows(table: DataFrame) -> DataFrame:
    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, ...]]:
        for batch in batches:
            if len(batch):
                sizes = batch["prefix"].map(len).to_numpy()
                tokens = np.concatenate(batch["prefix"].to_numpy()).view(np.uint64)
                at = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                yield tokens, np.repeat(batch["grp"].to_numpy(), sizes), at, tokens

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return blocks(parts(batches))

    return table.where("prefix is not null").select("grp", "prefix").mapInPandas(rows, "slot long, key long, a long, b long, known boolean")


def _ids(pairs: DataFrame, n: int) -> DataFrame:
    return scratch(sized(pairs.select(F.col("gid").alias("in_pair")).union(pairs.select("lead")).distinct(), 2 * n), "ids")


def _of_pairs(rows: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """The rows whose id is among the ids. Rows are shuffled only if the ids are too many to broadcast."""
    few = ids.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids.hint("shuffle_merge"), rows[id_col] == ids.in_pair, "left_semi")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, num: int, den: int, k: int) -> DataFrame:
    """pairs(lead, gid) -> a written table with apart double, the Jaccard distance (1 where the bitmaps rule a link out) and linked boolean."""
    n = pairs.count()
    ids = _ids(pairs, n)
    c = _of_pairs(classes.select("gid", "n", "parity"), "gid", ids)
    wide = pairs.join(c, "gid").join(c.toDF("lead", "lead_n", "lead_parity"), "lead")

    def possible(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            # union - inter >= apart, union + inter = n + m; a link needs den * inter >= num * union
            ok = [den * (n + m - d) >= num * (n + m + d) for n, m, d in zip(b["n"].tolist(), b["lead_n"].tolist(), map(_apart, b["parity"], b["lead_parity"]), strict=True)]
            yield b[["lead", "gid", "n", "lead_n"]].assign(may=np.array(ok, bool))

    filtered = scratch(sized(wide, n, 50_000).mapInPandas(possible, "lead long, gid long, n int, lead_n int, may boolean"), "pairs")
    may = filtered.where("may")
    drop(ids)
    ids = _ids(may, n)

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, j, texts in chunks(b["text"]):
                of, h = word_shingles(texts, k)
                cut = np.searchsorted(of, np.arange(1, j - i))
                yield pd.DataFrame({"gid": b["row"].to_numpy()[i:j], "items": np.split(h.view(np.int64), cut)})

    held = _of_pairs(docs.select("row", "text"), "row", ids).mapInPandas(sets, "gid long, items array<long>").dropDuplicates(["gid"])
    held = scratch(sized(held, ids.count(), 2_000), "sets")
    both = may.join(held, "gid").join(held.toDF("lead", "lead_items"), "lead")
    inter = both.select("lead", "gid", "n", "lead_n", F.size(F.array_intersect("items", "lead_items")).alias("both"))
    union = F.col("n") + F.col("lead_n") - F.col("both")
    sure = inter.select("lead", "gid", (1 - F.col("both") / union).alias("apart"), (F.col("both").cast("long") * den >= union.cast("long") * num).alias("linked"))
    out = scratch(sized(sure.union(filtered.where("not may").select("lead", "gid", F.lit(1.0), F.lit(False))), n, 5_000), "verified")
    drop(ids, filtered, held)
    return out


def _outside(active: DataFrame) -> DataFrame:
    """The classes that aren't in the largest component (main, of c classes) of a shingle's (all classes, away outside)."""
    sizes = active.groupBy("key", "component").agg(F.count("*").alias("c"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("c", "component")).alias("m"), F.sum("c").alias("all"))
    largest = largest.select("key", "m.c", F.col("m.component").alias("main"), "all", (F.col("all") - F.col("m.c")).alias("away"))
    return active.join(largest, "key").where("component <> main")


def _as_leads(rows: DataFrame) -> DataFrame:
    return rows.select("key", F.col("gid").alias("lead"), *[F.col(c).alias(f"lead_{c}") for c in ("n", "pos", "component", *SKETCH)])


def _fits(num: int, den: int) -> Column:
    """Whether a class and a lead may link: den * shared >= num * (n + m - shared), so shared is at least
    (n + m) * num / (num + den). It is at most what either has from this shingle on, and n + m - 2 * shared is at least
    the number of bits in which the sketches differ."""
    total = (F.col("n") + F.col("lead_n")).cast("long")
    most = F.least(F.col("n") - F.col("pos"), F.col("lead_n") - F.col("lead_pos")).cast("long")
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"lead_{c}"))) for c in SKETCH[1:]), F.bit_count(F.col(SKETCH[0]).bitwiseXOR(F.col(f"lead_{SKETCH[0]}"))))
    return (most * (num + den) >= total * num) & ((total - apart) * (num + den) >= total * 2 * num)


def _leaders(active: DataFrame, leaders: int) -> DataFrame:
    """Of each shingle's classes outside its largest component, those to hold against all others next: all in a group
    of SMALL classes, about as many as leaders says in a larger one, taken by hash. Once none is left outside, the group
    is connected or fully compared."""
    outside = _outside(active)
    least = outside.groupBy("key").agg(F.min("gid").alias("least"))
    drawn = F.pmod(F.xxhash64("gid", "key"), F.col("away")) < leaders
    chosen = outside.join(least, "key").where((F.col("all") <= SMALL) | drawn | (F.col("gid") == F.col("least")))
    return _as_leads(chosen)


def links(docs: DataFrame, num: int = 75, den: int = 100, k: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs(row, doc_id, text) -> (one row each: row, doc_id, n, gid of its class (its smallest row), first of the
    class by doc_id; links that were needed between classes: a, b, apart; gid, component of the classes that have one)."""
    small_batches(docs.sparkSession)
    docs = docs.select("row", F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc_id"), F.isnull("doc_id").alias("no_id"), "text")
    table = scratch(reduced(docs, common_shingles(docs, k), num, den, k), "reduced")
    classes = scratch(table.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("row").alias("gid"), F.min(F.struct("no_id", "doc_id", "row")).alias("first"), F.min(F.when(~F.col("no_id"), F.col("doc_id"))).alias("born"), F.min("grp").alias("grp"), F.min("parity").alias("parity"), *[F.min(c).alias(c) for c in SKETCH]), "classes")
    by_group = classes.select("grp", "gid", "n", F.coalesce("born", F.lit(2**63 - 1)).alias("born"), *SKETCH)
    across = held_twice(_group_rows(table)).select("key", F.col("a").alias("grp"), F.col("b").cast("int").alias("pos")).distinct().join(by_group, "grp")
    several = classes.groupBy("grp").agg(F.count("*").alias("c")).where("c > 1").select("grp")
    within = by_group.join(several, "grp").select(F.xxhash64("grp", F.lit("group")).alias("key"), "gid", "n", "born", F.lit(0).alias("pos"), *SKETCH)
    active = scratch(across.select("key", "gid", "n", "born", "pos", *SKETCH).union(within).withColumn("component", F.col("gid")), "active")
    spark = docs.sparkSession
    own = scratch(table.select("row", F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "n", "d1", "d2"), "own")
    drop(table)
    free(spark)  # the largest shuffle is over
    checked: list[DataFrame] = []  # a written table a round
    count, label, leaders = LEADERS, None, None
    while n := active.count():
        if not checked:
            least = active.groupBy("key").agg(F.min_by(F.struct("gid", "n", "pos", "component", *SKETCH), F.struct("born", "gid")).alias("l"))
            done = _as_leads(least.select("key", "l.*"))
        else:
            done = leaders = scratch(sized(_leaders(active, count), n), "leaders")
            count *= 4
        pairs = active.join(done, "key").where((F.col("component") != F.col("lead_component")) & _fits(num, den))
        pairs = pairs.select(F.least("lead", "gid").alias("lead"), F.greatest("lead", "gid").alias("gid")).distinct()
        pairs = pairs.join(reduce(DataFrame.union, checked), ["lead", "gid"], "left_anti") if checked else pairs
        pairs = scratch(pairs, "candidates")
        checked.append(_verified(pairs, classes, docs, num, den, k))
        drop(pairs, label)
        linked = reduce(DataFrame.union, checked).where("linked")
        label = components(linked.select(F.col("lead").alias("a"), F.col("gid").alias("b")))
        labels = label.toDF("gid", "component")
        rest = active.join(done.select("key", F.col("lead").alias("gid")), ["key", "gid"], "left_anti")
        rest = rest.drop("component").join(labels, "gid", "left").withColumn("component", F.coalesce("component", "gid"))
        rest = scratch(sized(rest, n), "rest")
        drop(active, leaders)
        apart = rest.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 <> c2").select("key")
        active, leaders = scratch(sized(rest.join(apart, "key").select(*active.columns), n), "active"), None
        drop(rest)
    drop(active)
    label = label.toDF("gid", "component") if checked else spark.createDataFrame([], "gid long, component long")
    empty = spark.createDataFrame([], "a long, b long, apart double")
    found = linked.select(F.col("lead").alias("a"), F.col("gid").alias("b"), "apart") if checked else empty
    of = classes.select("d1", "d2", "n", "gid", "first")
    return own.join(of, ["d1", "d2", "n"], "left").select("row", "doc_id", "n", "gid", "first"), found, label


def numbered_components(docs: DataFrame, num: int = 75, den: int = 100, k: int = 5) -> DataFrame:
    """docs(row, doc_id, text) -> row, doc_id, n_shingles long, component_id: the smallest doc_id that links reach
    (null if none), first_row: the row of that document, the smallest if several have it. One row of a component is its first."""
    members, _, label = links(docs, num, den, k)
    firsts = members.where("row = gid").select("gid", "first").join(label, "gid")
    best = firsts.groupBy("component").agg(F.min("first").alias("best"))
    of = label.join(best, "component").select("gid", "best")
    first = F.coalesce("best", "first", F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "row"))
    out = members.join(of, "gid", "left").select("row", "doc_id", F.col("n").cast("long").alias("n_shingles"), first.alias("f"))
    return out.select("row", "doc_id", "n_shingles", F.when(~F.col("f.no_id"), F.col("f.doc_id")).alias("component_id"), F.col("f.row").alias("first_row"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 75, den: int = 100, k: int = 5) -> DataFrame:
    """One row a document: doc_id, n_shingles long, component_id: the smallest doc_id that links reach.

    The similarity is num / den or more, compared in whole numbers. No documents: no rows.
    """
    docs = one_name(docs, {"doc_id": id_col, "text": text_col}).withColumn("doc_id", F.col("doc_id").cast("long"))
    return numbered_components(docs.withColumn("row", F.xxhash64("doc_id", "text")), num, den, k).select("doc_id", "n_shingles", "component_id")
