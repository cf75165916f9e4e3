"""Merkle dataset manifest (13): octopus multiproof over ternary trees, one a source and one of the sources' roots.

Leaves are hashed by Spark's own functions. They are put in order by ranges of (source, doc_id, leaf, row), so a leaf
partition holds a contiguous run of leaves, of a bounded number however large a source or a group of equal rows is; only
numbers of rows, by partition and source, fix every leaf's coordinate (tree, level, index).

1. Each partition hashes the nodes that its own leaves complete, and sends on those that no complete node of it covers: at
   most four a level at either end of its run, and as many of the tree of sources, where whole sources lie within.
2. What partitions share is hashed from these by blocks of 3^LEVELS nodes, a few levels a round.
3. Each partition computes the minimal union of the coordinates that its leaves' proofs lack: beside its run, at most four
   a level, of its first and its last source and of the tree of sources. They are fetched once, by one join; shared
   interiors are derived, and every leaf's proof is expanded in the partition.

Null values are hashed as "-". A null source comes first and is one source, a null doc_id first in its source; documents of
one id in a source stand by their leaf hash. Equal rows are leaves each. Nothing is tampered with where doc_id is null.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.shared import drop, one_name, scratch

FAN = 3
#: Leaves of a partition, about.
PART_ROWS = 25_000
#: Levels that a round hashes beyond partitions.
LEVELS = 6
#: The tree of the sources' roots; other trees have the numbers of their sources.
SOURCES = -1
_NODES = "tree long, level int, idx long, n long, hash string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def parent(children: list[str]) -> str:
    return sha("".join(children))


def height(n: int) -> int:
    """Levels above n leaves."""
    h = 0
    while n > 1:
        n, h = -(-n // FAN), h + 1
    return h


def leaf_hash(*values: Column) -> Column:
    """SHA-256 of all values in turn, each as its UTF-8 length, a colon and itself, null as "-"."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*parts), 256)


def rise(level: int, first: int, values: list[str], n: int) -> tuple[list[tuple[int, int, int, str]], str | None]:
    """Of a run of nodes: (level, index, nodes of that level, hash) of all that no complete node above covers, and the top if the run is the whole tree."""
    out: list[tuple[int, int, int, str]] = []
    while values and n > 1:
        end = first + len(values)
        lo, hi = -(-first // FAN) * FAN, end if end == n else end // FAN * FAN
        lo = min(lo, end)
        hi = max(hi, lo)
        out += [(level, first + i, n, values[i]) for i in (*range(lo - first), *range(hi - first, len(values)))]
        values = [parent(values[i : i + FAN]) for i in range(lo - first, hi - first, FAN)]
        first, level, n = lo // FAN, level + 1, -(-n // FAN)
    return out, values[0] if values else None


def lacking(first: int, end: int, n: int) -> list[tuple[int, int]]:
    """(level, index) of the fewest nodes besides first..end-1 that their proofs need."""
    out: list[tuple[int, int]] = []
    level = 0
    while n > 1:
        lo, hi = first // FAN * FAN, min(-(-end // FAN) * FAN, n)
        out += [(level, i) for i in (*range(lo, first), *range(end, hi))]
        first, end, level, n = lo // FAN, -(-hi // FAN), level + 1, -(-n // FAN)
    return out


class Run:
    """The nodes of a run of leaves at every level, those that it lacks put in; proofs of its leaves."""

    def __init__(self, tree: int, first: int, values: list[str], n: int, fetched: dict[tuple[int, int, int], str]) -> None:
        self.levels: list[tuple[int, list[str]]] = []
        level = 0
        while n > 1:
            end = first + len(values)
            lo, hi = first // FAN * FAN, min(-(-end // FAN) * FAN, n)
            values = [fetched[tree, level, i] for i in range(lo, first)] + values + [fetched[tree, level, i] for i in range(end, hi)]
            self.levels.append((lo, values))
            values = [parent(values[i : i + FAN]) for i in range(0, len(values), FAN)]
            first, level, n = lo // FAN, level + 1, -(-n // FAN)
        self.top = values[0]
        self._above: dict[tuple[int, int], list[tuple[str, str]]] = {}

    def beside(self, level: int, i: int) -> tuple[str, str]:
        """What stands left and right of a node in its run of children."""
        lo, values = self.levels[level]
        at = i - lo
        start = at // FAN * FAN
        return "".join(values[start:at]), "".join(values[at + 1 : start + FAN])

    def path(self, i: int, level: int = 0) -> list[tuple[str, str]]:
        """beside() at each level up from a node; the paths above the leaves are kept."""
        if level == len(self.levels):
            return []
        if level == 0:
            return [self.beside(0, i), *self.path(i // FAN, 1)]
        if (level, i) not in self._above:
            self._above[level, i] = [self.beside(level, i), *self.path(i // FAN, level + 1)]
        return self._above[level, i]


def folded(node: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        node = sha(left + node + right)
    return node


def located(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """leaves(row, doc_id, source, leaf, tampered) -> written tables: leaves with part, tree, n_sources, idx and n; and one row
    a part and source: part, tree, n_sources, first, end, n."""
    parts = max(1, -(-leaves.count() // PART_ROWS))
    order = ["source", "doc_id", "leaf", "row"]
    at = F.monotonically_increasing_id()
    dealt = leaves.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = scratch(dealt.select("*", F.shiftright(at, 33).cast("int").alias("part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("i")), "ordered")
    counts = scratch(dealt.groupBy("part", "source").agg(F.min("i").alias("i0"), F.count("*").alias("m")), "counts")
    by_source = W.partitionBy("source").orderBy("part")  # as many rows as there are partitions, at most
    runs = counts.withColumns({"end": F.sum("m").over(by_source), "n": F.sum("m").over(W.partitionBy("source"))})
    runs = scratch(runs.withColumn("first", F.col("end") - F.col("m")), "runs")
    # sources are numbered in the order of their first leaves: by part, which has a number of them, and within it
    begun = {r["part"]: r["k"] for r in runs.where("first = 0").groupBy("part").agg(F.count("*").alias("k")).collect()}  # a number a partition
    before, total = [], 0
    for p in range(max(begun, default=-1) + 1):
        before.append((p, total))
        total += begun.get(p, 0)
    if not before:
        before = [(0, 0)]
    earlier = F.broadcast(leaves.sparkSession.createDataFrame(before, "part int, earlier long"))
    own = F.row_number().over(W.partitionBy("part").orderBy("i0"))
    numbers = runs.where("first = 0").join(earlier, "part").select(F.col("source").alias("_source"), (F.col("earlier") + own - 1).alias("tree"))
    trees = runs.join(numbers, F.col("source").eqNullSafe(F.col("_source"))).withColumn("n_sources", F.lit(total).cast("bigint"))
    trees = scratch(trees.select("part", "source", "tree", "n_sources", "i0", "first", "end", "n"), "trees")
    same = (F.col("l.part") == F.col("r.part")) & F.col("l.source").eqNullSafe(F.col("r.source"))
    joined = dealt.alias("l").join(trees.alias("r"), same)
    rows = joined.select("l.row", "l.doc_id", "l.leaf", "l.tampered", "l.part", "r.tree", "r.n_sources", (F.col("l.i") - F.col("r.i0") + F.col("r.first")).alias("idx"), "r.n")
    rows = scratch(rows, "located")
    drop(dealt, counts, runs)
    return rows, trees.drop("i0", "source")


def _runs(b: pd.DataFrame) -> Iterator[tuple[int, int, int, slice]]:
    """(tree, first index, leaves of the tree, rows) of each tree in a sorted part."""
    tree = b["tree"].to_numpy()
    edge = np.flatnonzero(np.concatenate([[True], tree[1:] != tree[:-1]])) if len(tree) else []
    idx, n = b["idx"].to_numpy(), b["n"].to_numpy()
    for i, j in zip(edge, [*edge[1:], len(tree)], strict=True):
        yield int(tree[i]), int(idx[i]), int(n[i]), slice(i, j)


def completed(b: pd.DataFrame) -> pd.DataFrame:
    """Step 1 for one part: the nodes that it sends on."""
    b = b.sort_values(["tree", "idx"], kind="stable")
    leaf, out, whole = b["leaf"].to_numpy(), [], []
    for tree, first, n, at in _runs(b):
        found, top = rise(0, first, list(leaf[at]), n)
        out += [(tree, *x) for x in found]
        if top is not None and at.stop - at.start == n:
            whole.append((tree, top))
    if whole:  # whole sources of a part stand in a row
        found, top = rise(0, whole[0][0], [h for _, h in whole], int(b["n_sources"].iloc[0]))
        out += [(SOURCES, *x) for x in found]
    return pd.DataFrame(out, columns=["tree", "level", "idx", "n", "hash"])


def merged(b: pd.DataFrame) -> pd.DataFrame:
    """Step 2 for one block: the nodes above its own, up to the level `stop`."""
    b = b.sort_values(["level", "idx"], kind="stable")
    tree, stop = int(b["tree"].iloc[0]), int(b["stop"].iloc[0])
    at: dict[int, list[tuple[int, int, str]]] = {}
    for level, i, n, h in zip(b["level"].tolist(), b["idx"].tolist(), b["n"].tolist(), b["hash"], strict=True):
        at.setdefault(level, []).append((i, n, h))
    out = []
    for level in range(min(at), stop):
        above: dict[int, list[str]] = {}
        for i, _, h in sorted(at.get(level, [])):
            above.setdefault(i // FAN, []).append(h)
        n = next((n for _, n, _ in at.get(level, [])), 1)
        for i, children in above.items() if n > 1 else ():
            node = (i, -(-n // FAN), parent(children))
            at.setdefault(level + 1, []).append(node)
            out.append((tree, level + 1, *node))
    return pd.DataFrame(out, columns=["tree", "level", "idx", "n", "hash"])


def _climbed(nodes: DataFrame, highest: int) -> list[DataFrame]:
    """All nodes above what partitions sent on, a written table a round; the last of a tree has n = 1."""
    every = [nodes]
    for base in range(0, highest, LEVELS):
        stop = base + LEVELS
        now = [t.where((F.col("level") >= base) & (F.col("level") < stop) & (F.col("n") > 1)) for t in every]
        rows = now[0]
        for t in now[1:]:
            rows = rows.union(t)
        block = F.floor(F.col("idx") / F.pow(F.lit(float(FAN)), F.lit(stop) - F.col("level"))).cast("bigint")
        rows = rows.withColumns({"block": block, "stop": F.lit(stop)})
        every.append(scratch(rows.groupBy("tree", "block").applyInPandas(merged, _NODES), "nodes"))
    return every


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out


def _requests(runs: DataFrame) -> DataFrame:
    """Step 3: (part, tree, level, idx) of what each part lacks, from its first and last source and its range of sources."""
    run = F.struct("tree", "first", "end", "n")
    edges = runs.groupBy("part").agg(F.min_by(run, "tree").alias("lo"), F.max_by(run, "tree").alias("hi"), F.first("n_sources").alias("n_sources"))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for part, lo, hi, n in zip(b["part"].tolist(), b["lo"], b["hi"], b["n_sources"].tolist(), strict=True):
                asked = {(r["tree"], *x) for r in (lo, hi) for x in lacking(r["first"], r["end"], r["n"])}
                asked |= {(SOURCES, *x) for x in lacking(lo["tree"], hi["tree"] + 1, n)}
                out += [(part, *x) for x in sorted(asked)]
            yield pd.DataFrame(out, columns=["part", "tree", "level", "idx"])

    return edges.mapInPandas(ask, "part int, tree long, level int, idx long")


def expanded(key: tuple[int], b: pd.DataFrame, fetched: pd.DataFrame, keep_siblings: bool) -> pd.DataFrame:
    """Step 3 for one part: every leaf's proof."""
    b = b.sort_values(["tree", "idx"], kind="stable").reset_index(drop=True)
    have = {(t, v, i): h for t, v, i, h in zip(fetched["tree"].tolist(), fetched["level"].tolist(), fetched["idx"].tolist(), fetched["hash"], strict=True)}
    leaf, tampered = b["leaf"].to_numpy(), b["tampered"].to_numpy()
    runs = [(at, first, Run(tree, first, list(leaf[at]), n, have)) for tree, first, n, at in _runs(b)]
    sources = Run(SOURCES, int(b["tree"].iloc[0]), [r.top for *_, r in runs], int(b["n_sources"].iloc[0]), have)
    out = []
    for source, (at, first, run) in enumerate(runs, int(b["tree"].iloc[0])):
        above = sources.path(source)
        for k in range(at.start, at.stop):
            path = run.path(first + k - at.start) + above
            siblings = "".join([x + y for x, y in path])
            root = folded(leaf[k] if tampered[k] is None else tampered[k], path)
            out.append((run.top, sources.top, sha(siblings), root, *([siblings] if keep_siblings else [])))
    names = ["subroot", "root", "proof_sha256", "folded_root", *["siblings"] * keep_siblings]
    return pd.concat([b[["doc_id", "leaf"]], pd.DataFrame(out, columns=names)], axis=1)


def tampering(id_: Column, text: Column) -> tuple[Column, Column]:
    """Whether a row is tampered with, and its text then: without line feeds."""
    return F.coalesce(F.crc32(id_.cast("string")) % 2 == 0, F.lit(False)), F.replace(text, F.lit("\n"), F.lit(""))


def manifest(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), text_col: str = "text", keep_siblings: bool = False) -> DataFrame:
    """One row a document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified[, siblings: the proof itself, left to right]."""
    small = one_name(docs, {f"c{i}": c for i, c in enumerate(columns)})
    at = {c: F.col(f"c{i}") for i, c in enumerate(columns)}
    cut, without = tampering(at[id_col], at[text_col])
    values = [at[c] for c in columns]
    rows = small.select(
        F.monotonically_increasing_id().alias("row"), at[id_col].alias("doc_id"), at[source_col].alias("source"), leaf_hash(*values).alias("leaf"),
        F.when(cut & F.contains(at[text_col], F.lit("\n")), leaf_hash(*[without if c == text_col else at[c] for c in columns])).alias("tampered"),
    )
    leaves = scratch(rows, "leaves")
    kind = leaves.schema["doc_id"].dataType
    located_, runs = located(leaves)
    drop(leaves)
    sizes = runs.agg(F.max("n").alias("n"), F.max("n_sources").alias("s")).first()
    own = located_.select("part", "tree", "idx", "n", "n_sources", "leaf").groupBy("part").applyInPandas(completed, _NODES)
    sent = scratch(own, "sent")
    trees = _climbed(sent.where(F.col("tree") != SOURCES), height(sizes["n"] or 0))
    tops = _union(trees[1:] or [sent.limit(0)]).where("n = 1 and tree <> -1")
    shared = tops.select(F.lit(SOURCES).cast("bigint").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("idx"), F.lit(sizes["s"]).cast("bigint").alias("n"), "hash")
    above = _climbed(scratch(sent.where(F.col("tree") == SOURCES).union(shared), "tops"), height(sizes["s"] or 0))
    nodes = _union([*trees, *above]).select("tree", "level", "idx", "hash")
    fetched = _requests(runs).join(nodes, ["tree", "level", "idx"])

    names = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string" + ", siblings string" * keep_siblings
    pairs = located_.withColumn("doc_id", F.col("doc_id").cast("string")).groupBy("part").cogroup(fetched.groupBy("part"))
    out = pairs.applyInPandas(lambda key, b, f: expanded(key, b, f, keep_siblings) if len(b) else pd.DataFrame(), names)
    return out.select(F.col("doc_id").cast(kind).alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), *["siblings"] * keep_siblings)
