"""Language ID (7): interpolated Kneser-Ney character models per language, in sorted hash arrays.

A text is a run of letters, lower-cased, with one space for whatever stands between words. The counts of all n-grams of
ORDER characters of each language come from every training row: tasks count their own, Spark adds them up. Lower
orders use Kneser-Ney continuation counts, which follow from the distinct n-grams of the order above.

The model holds, for every n-gram that any language has seen, its probability in each language, sorted by hash; the same
for each lower order with the weight that is left to the order below. A character is scored by the highest order
that knows its n-gram. The language with the lowest cross-entropy per character is chosen. Rejection is calibrated on all
training rows, each scored by a model of the half of the rows (by text) that it isn't in: a text is rejected if its
cross-entropy is above the 0.999 quantile of its language by a margin, or if it has no letter. A language of fewer than
FEW rows has the quantile of all languages, as its own would be its highest row. The model's size depends on the alphabets:
up to max_cells values (n-grams times languages, counted before anything comes to the driver) it is held by every worker.
A larger one stays in tables (see Spread): every n-gram counts there too, and no worker holds more than those of a block of
texts. Both say the same. Only the languages, their limits and the letters' number are on the driver in either case.

Null text or one without a letter: "und", score 0. Nulls among languages are left out of training. Without a training
row every text is "und".
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.llm.shared import mix, one_name, scratch, small_batches

ORDER = 4
DISCOUNT = 0.75
#: A language of fewer calibrated rows has the limit of all languages together.
FEW = 1000
#: Calibrated values are counted in steps of one in so many bits.
_STEPS = 256
#: Characters that are scored or counted at once; the arrays of a block are some 40 bytes a character.
BLOCK = 250_000
#: Values of the largest table that workers hold; a model of more stays in Spark's tables.
MAX_CELLS = 8_000_000
#: Values (n-grams times languages) of a block of texts where a model is in tables.
BLOCK_CELLS = 1_000_000
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_SPACE, _HIGH, _LOW = np.uint16(0x20), 0xD800, 0xE000


@cache
def _letter() -> np.ndarray:
    """Of each 16-bit code, whether it is a letter."""
    return np.array([_NOT_LETTERS.match(chr(i)) is None for i in range(1 << 16)])


def letters(text: str | None) -> np.ndarray:
    """16-bit codes of the letters, words between single spaces; characters beyond 16 bits are folded into a private range."""
    if text is None or text != text:
        return np.zeros(0, np.uint64)
    c = np.frombuffer(f" {text.lower()} ".encode("utf-16-le", "surrogatepass"), np.uint16)
    if ((c >= _HIGH) & (c < _LOW)).any():
        wide = np.frombuffer(f" {_NOT_LETTERS.sub(' ', text.lower()).strip()} ".encode("utf-32-le", "replace"), np.uint32)
        c = np.where(wide > 0xFFFF, 0xE000 + wide % 0x1900, wide)
        return c.astype(np.uint64) if len(c) > 2 else np.zeros(0, np.uint64)
    own = _letter()[c]
    if not own.any():
        return np.zeros(0, np.uint64)
    c = np.where(own, c, _SPACE)
    own[1:] |= own[:-1]  # of a run between words, the first stays
    own[0] = True
    return c[own].astype(np.uint64)


def grams(c: np.ndarray, n: int) -> np.ndarray:
    """The n-gram that ends at each character from the n-th on, 16 bits a character, the last in the lowest."""
    out = np.zeros(max(0, len(c) - n + 1), np.uint64)
    for i in range(n):
        out = (out << np.uint64(16)) | c[i : i + len(out)]
    return out


@dataclass
class Table:
    """Values by n-gram, found by hash: sorted, with a directory of the first bits, about two entries a key."""

    keys: np.ndarray
    values: np.ndarray
    shift: np.uint64 = field(init=False)
    starts: np.ndarray = field(init=False)
    longest: int = field(init=False)

    def __post_init__(self) -> None:
        h = mix(self.keys)
        order = np.argsort(h)
        self.keys, self.values = h[order], self.values[order].astype(np.float32)
        bits = min(24, max(8, len(h).bit_length() + 1))
        self.shift = np.uint64(64 - bits)
        self.starts = np.searchsorted(self.keys >> self.shift, np.arange(2**bits + 1, dtype=np.uint64)).astype(np.int32)
        self.longest = int(np.diff(self.starts).max(initial=0))

    def find(self, g: np.ndarray) -> np.ndarray:
        """Row of each n-gram, or -1."""
        out = np.full(len(g), -1, np.int64)
        if not len(self.keys):
            return out
        h = mix(g)
        bucket = (h >> self.shift).astype(np.int64)
        at, end = self.starts[bucket], self.starts[bucket + 1]
        left = np.flatnonzero(at < end)
        at, end, h = at[left], end[left], h[left]
        for _ in range(self.longest):
            hit = self.keys[at] == h
            out[left[hit]] = at[hit]
            more = np.flatnonzero(~hit & (at + 1 < end))
            if not len(more):
                break
            left, at, end, h = left[more], at[more] + 1, end[more], h[more]
        return out


def add_up(total: np.ndarray, of: np.ndarray, values: np.ndarray) -> None:
    """Takes the values off the rows of total that they are of; of is in order."""
    if len(of):
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        total[of[first]] -= np.add.reduceat(values, first, axis=0, dtype=np.float64)


@dataclass
class Model:
    langs: list[str]
    tables: list[Table]  # by order, ORDER first: log2 of each language's probability
    rest: list[Table | None]  # by order: log2 of the weight that a context leaves to the order below
    unknown: float
    limits: np.ndarray | None = None  # by language, cross-entropy beyond which a text is rejected
    sharpness: float = 12.0

    def bits(self, c: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        """Mean bits per character, (texts, languages). of: which of n texts each character is of."""
        total = np.zeros((n, len(self.langs)))
        g = grams(c, ORDER)
        inside = of[ORDER - 1 :] == of[: len(g)]
        g, of = g[inside], of[: len(inside)][inside]
        weight = np.zeros((len(g), len(self.langs)), np.float32)
        for i, table in enumerate(self.tables):
            row = table.find(g)
            hit = row >= 0
            got = table.values[row[hit]]
            add_up(total, of[hit], got + weight[hit] if i else got)
            g, of, weight = g[~hit], of[~hit], weight[~hit]
            if not len(g):
                break
            if self.rest[i] is not None:
                at = self.rest[i].find(g >> np.uint64(16))
                known = at >= 0
                weight[known] += self.rest[i].values[at[known]]
                g = g & np.uint64((1 << 16 * (ORDER - i - 1)) - 1)
        else:
            add_up(total, of, weight - np.float32(self.unknown))
        return total

    def scored(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Characters of each text, and its bits per character by language."""
        n, total = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(self.langs)))
        held: list[np.ndarray] = []
        first = size = 0
        for i, t in enumerate(texts):
            held.append(letters(t))
            size += len(held[-1])
            if size > BLOCK or i == len(texts) - 1:
                lengths = np.array([len(x) for x in held])
                of = np.repeat(np.arange(len(held)), lengths)
                n[first : i + 1] = np.where(lengths, np.maximum(lengths - ORDER + 1, 1), 0)
                total[first : i + 1] = self.bits(np.concatenate(held), of, len(held))
                held, first, size = [], i + 1, 0
        return n, total / np.maximum(n, 1)[:, None]


def counted(train: DataFrame) -> DataFrame:
    """train(text, lang, half) -> (lang, gram, n, n1) over all rows and those of half 1. Tasks add up their own before they send."""

    def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(back, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = {}

        def rows(of: tuple[str, int]) -> pd.DataFrame:
            keys, n = summed(sums.pop(of))
            return pd.DataFrame({"lang": of[0], "gram": keys.view(np.int64), "n": n, "n1": n * of[1]})

        for batch in batches:
            for of, group in batch.groupby(["lang", "half"], sort=True):
                held, size = [], 0
                for t in [*group["text"], None]:
                    held.append(grams(letters(t), ORDER))
                    size += len(held[-1])
                    if size > 4 * BLOCK or t is None:
                        sums.setdefault(of, []).append(np.unique(np.concatenate(held), return_counts=True))
                        held, size = [], 0
                if sum(len(k) for k, _ in sums[of]) > 4 * BLOCK:
                    sums[of] = [summed(sums[of])]
                    if len(sums[of][0][0]) > 2 * BLOCK:
                        yield rows(of)
        for of in list(sums):
            yield rows(of)

    return train.mapInPandas(count, "lang string, gram long, n long, n1 long").groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1"))


def model_of(counts: pd.DataFrame) -> Model:
    """Kneser-Ney probabilities of every language for every n-gram that any of them has."""
    langs = sorted(counts["lang"].unique())
    alphabet = max(2, len(np.unique(counts["gram"].to_numpy(np.int64).view(np.uint64) & np.uint64(0xFFFF))) + 1)
    own = []
    for lang in langs:
        part = counts[counts["lang"] == lang]
        g, n = part["gram"].to_numpy(np.int64).view(np.uint64), part["n"].to_numpy(np.float64)
        order = np.argsort(g)
        own.append([(g[order], n[order])])
        for k in range(ORDER - 1, 0, -1):  # continuation counts: in how many distinct n-grams above does it end
            above = own[-1][-1][0]
            own[-1].append(tuple(np.unique(above & np.uint64((1 << 16 * k) - 1), return_counts=True)))
    tables: list[Table] = []
    rest: list[Table | None] = []
    below: tuple[np.ndarray, np.ndarray] | None = None
    for k in range(1, ORDER + 1):
        every = np.unique(np.concatenate([x[ORDER - k][0] for x in own]))
        p, contexts, left = np.zeros((len(every), len(langs))), None, None
        if k > 1:
            contexts = np.unique(every >> np.uint64(16))
            left = np.ones((len(contexts), len(langs)))
        for j in range(len(langs)):
            g, n = own[j][ORDER - k]
            at = np.searchsorted(every, g)
            if k == 1:
                c = np.zeros(len(every))
                c[at] = n
                p[:, j] = np.maximum(c - DISCOUNT, 0) / n.sum() + DISCOUNT * len(g) / n.sum() / alphabet
                continue
            ctx = np.searchsorted(contexts, g >> np.uint64(16))
            total = np.bincount(ctx, n, len(contexts))
            kinds = np.bincount(ctx, minlength=len(contexts))
            left[:, j] = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1)
            c = np.zeros(len(every))
            c[at] = n
            of = np.searchsorted(contexts, every >> np.uint64(16))
            lower = np.searchsorted(below[0], every & np.uint64((1 << 16 * (k - 1)) - 1))
            p[:, j] = np.maximum(c - DISCOUNT, 0) / np.maximum(total[of], 1) + left[of, j] * below[1][lower, j]
        below = (every, p)
        tables.insert(0, Table(every, np.log2(p)))
        rest.insert(0, Table(contexts, np.log2(left)) if k > 1 else None)
    lowest = [DISCOUNT * len(x[ORDER - 1][0]) / x[ORDER - 1][1].sum() / alphabet for x in own]
    return Model(langs, tables, rest, -math.log2(min(lowest)))


def row_name(df: DataFrame) -> str:
    """A name for the number of a row that no column has."""
    return "_" * (1 + max((len(c) for c in df.columns), default=0)) + "row"


def pieces(docs: DataFrame, row: str, size: int) -> DataFrame:
    """docs(row, text) -> (block, row, codes): the letters of each text, in pieces that overlap by ORDER - 1, about `size` characters a block."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, room = TaskContext.get().partitionId() << 33, size
        for b in batches:
            out = []
            for r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                c = letters(t).astype(np.uint16)
                for i in range(0, max(1, len(c) - ORDER + 1) if len(c) else 0, size):
                    part = c[i : i + size + ORDER - 1]
                    if room < len(part):
                        block, room = block + 1, size
                    room -= len(part)
                    out.append((block, r, part.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True) if out else ([], [], []), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["block", "row", "codes"])

    return scratch(docs.select(F.col(row).alias("row"), "text").where("text is not null").mapInArrow(cut, "block long, row long, codes binary"), "pieces")


@dataclass
class Spread:
    """A model in tables: the counts of each order and of each context, by language. Probabilities are made by joins for the n-grams that texts have."""

    langs: list[str]
    orders: list[DataFrame]  # from 1 to ORDER: (lang, gram, n); lang is a place in langs
    contexts: list[DataFrame]  # alike: (lang, context, total, kinds)
    alphabet: int
    unknown: float
    limits: np.ndarray | None = None
    sharpness: float = 12.0

    def values(self, grams: DataFrame) -> DataFrame:
        """grams(gram), distinct -> (gram, bits): minus log2 of each language's probability."""
        asked = [grams]
        for k in range(ORDER - 1, 0, -1):
            asked.insert(0, asked[0].select(F.col("gram").bitwiseAND((1 << 16 * k) - 1).alias("gram")).distinct())
        every = grams.sparkSession.range(len(self.langs)).select(F.col("id").cast("int").alias("lang"))
        n, kinds, total, below = F.coalesce("n", F.lit(0)), F.col("kinds"), F.col("total"), None
        for k in range(1, ORDER + 1):
            rows = asked[k - 1].crossJoin(F.broadcast(every)).join(self.orders[k - 1], ["lang", "gram"], "left")
            if k == 1:
                known = self.orders[0].select("gram", F.lit(True).alias("known")).distinct()
                rows = rows.join(known, "gram", "left").join(self.contexts[0].drop("context"), "lang")
                p = F.greatest(n - DISCOUNT, F.lit(0.0)) / total + DISCOUNT * kinds / total / self.alphabet
                p = F.when(F.col("known"), p).otherwise(2.0**-self.unknown)
            else:
                rows = rows.withColumns({"context": F.shiftrightunsigned("gram", 16), "suffix": F.col("gram").bitwiseAND((1 << 16 * (k - 1)) - 1)})
                rows = rows.join(self.contexts[k - 1], ["lang", "context"], "left").join(below, ["lang", "suffix"])
                p = F.coalesce(F.greatest(n - DISCOUNT, F.lit(0.0)) / total, F.lit(0.0)) + F.coalesce(DISCOUNT * kinds / total, F.lit(1.0)) * F.col("lower")
            below = rows.select("lang", F.col("gram").alias("suffix"), p.alias("lower"))
        found = below.groupBy(F.col("suffix").alias("gram")).agg(F.sort_array(F.collect_list(F.struct("lang", (-F.log2("lower")).alias("v")))).alias("all"))
        return found.select("gram", F.transform("all", lambda x: x["v"]).alias("bits"))

    def scored(self, docs: DataFrame, row: str) -> DataFrame:
        """docs(row, text) -> (row, n, bits) of the texts with a letter: characters, and bits per character by language."""
        langs = len(self.langs)
        parts = pieces(docs, row, max(1000, BLOCK_CELLS // langs))

        def distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for block, codes in b.groupby("block")["codes"]:
                    own = [np.unique(grams(np.frombuffer(c, np.uint16).astype(np.uint64), ORDER)) for c in codes]
                    yield pd.DataFrame({"block": block, "gram": np.unique(np.concatenate(own)).view(np.int64)})

        asked = scratch(parts.mapInPandas(distinct, "block long, gram long").distinct(), "asked")
        values = scratch(self.values(asked.select("gram").distinct()), "values")

        def added(key: tuple, texts: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
            known = known.sort_values("gram")
            keys, bits = known["gram"].to_numpy(np.int64), np.array(list(known["bits"]))
            out = []
            for codes in texts["codes"]:
                g, n = np.unique(grams(np.frombuffer(codes, np.uint16).astype(np.uint64), ORDER).view(np.int64), return_counts=True)
                total = n @ bits[np.searchsorted(keys, g)] if len(g) else np.zeros(langs)
                out.append((int(n.sum()), total))
            return pd.DataFrame({"row": texts["row"], "n": [n for n, _ in out], "bits": [list(x) for _, x in out]})

        here = asked.join(values, "gram").select("block", "bits", "gram")
        sums = parts.groupBy("block").cogroup(here.groupBy("block")).applyInPandas(added, "row long, n long, bits array<double>")
        sums = sums.groupBy("row").agg(F.sum("n").alias("n"), F.collect_list("bits").alias("parts"))
        zero = F.transform(F.sequence(F.lit(1), F.lit(langs)), lambda _: F.lit(0.0))
        n = F.greatest("n", F.lit(1))
        total = F.aggregate("parts", zero, lambda x, y: F.zip_with(x, y, lambda a, b: a + b))
        return sums.select(F.col("row").alias(row), n.alias("n"), F.transform(total, lambda x: x / n).alias("bits"))


def spread_of(counts: DataFrame) -> Spread | None:
    """The model of counts(lang, gram, n) in tables, all by joins and sums."""
    spark = counts.sparkSession
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
    if not langs:
        return None
    at = spark.createDataFrame(list(enumerate(langs)), "at int, lang string")
    orders = [scratch(counts.join(F.broadcast(at), "lang").select(F.col("at").alias("lang"), "gram", "n"), "order")]
    for k in range(ORDER - 1, 0, -1):
        orders.insert(0, scratch(orders[0].groupBy("lang", F.col("gram").bitwiseAND((1 << 16 * k) - 1).alias("gram")).agg(F.count("*").alias("n")), "order"))
    contexts = [scratch(x.groupBy("lang", F.shiftrightunsigned("gram", 16).alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds")), "contexts") for x in orders]
    alphabet = max(2, orders[0].agg(F.count_distinct("gram")).first()[0] + 1)
    lowest = contexts[0].agg(F.min(F.col("kinds") / F.col("total"))).first()[0] * DISCOUNT / alphabet
    return Spread(langs, orders, contexts, alphabet, -math.log2(lowest))


def quantile(steps: pd.DataFrame, q: float) -> float:
    """The upper edge of the step that holds the quantile. steps(step, n)"""
    n = steps.groupby("step")["n"].sum().sort_index()
    return (int(n.index[np.searchsorted(n.cumsum().to_numpy(), q * n.sum())]) + 1) / _STEPS


def held_by_workers(train: DataFrame, counts: DataFrame) -> tuple[Model, DataFrame]:
    """The model that every worker holds, and what it measures on train(text, lang, half): (lang, kind, step, n)."""
    rows = counts.toPandas()
    model, others = model_of(rows), []
    for n in (rows["n1"], rows["n"] - rows["n1"]):  # of half 1, for the rows of half 0; and the other way round
        part = rows.assign(n=n)[n > 0]
        others.append(None if part.empty else model_of(part))
    held = train.sparkSession.sparkContext.broadcast((model, others))

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        full, by_half = held.value
        at = {x: i for i, x in enumerate(full.langs)}
        for b in batches:
            known = [((b["half"] == i) & b["lang"].isin(m.langs if m else [])).to_numpy() for i, m in enumerate(by_half)]
            # a language that stands in one half only is scored by the model of all rows
            for m, some in zip([*by_half, full], [*known, b["lang"].isin(full.langs).to_numpy() & ~(known[0] | known[1])], strict=True):
                if not some.any():
                    continue
                own = {x: i for i, x in enumerate(m.langs)}
                n, bits = m.scored(list(b["text"][some]))
                langs = list(b["lang"][some])
                ordered = np.sort(bits, axis=1)
                values = {"bits": bits[np.arange(len(n)), [own[x] for x in langs]], "gap": ordered[:, :2][:, -1] - ordered[:, 0]}
                for kind, v in values.items():
                    each = pd.DataFrame({"lang": [at[x] for x in langs], "step": np.floor(v * _STEPS).astype(np.int64)})[n > 0]
                    yield each.groupby(["lang", "step"]).size().reset_index(name="n").assign(kind=kind)

    found = train.mapInPandas(measured, "lang int, kind string, step long, n long").groupBy("lang", "kind", "step").agg(F.sum("n").alias("n"))
    return model, found


def held_in_tables(train: DataFrame, counts: DataFrame) -> tuple[Spread, DataFrame]:
    """The same where the model stays in tables."""
    row = row_name(train)
    rows = scratch(train.withColumn(row, F.monotonically_increasing_id()), "train")
    model = spread_of(counts)
    at = {x: i for i, x in enumerate(model.langs)}

    def names(m: Spread) -> DataFrame:
        return F.broadcast(rows.sparkSession.createDataFrame([(x, at[x], i) for i, x in enumerate(m.langs)], "lang string, at int, own int"))

    def measured(m: Spread, some: DataFrame) -> DataFrame:
        told = m.scored(some, row).join(some.select(row, "at", "own"), row)
        ordered = F.array_sort("bits")
        gap = F.get(ordered, F.lit(min(1, len(m.langs) - 1))) - F.get(ordered, F.lit(0))
        each = told.select(F.col("at").alias("lang"), F.explode(F.create_map(F.lit("bits"), F.get("bits", F.col("own")), F.lit("gap"), gap)).alias("kind", "v"))
        return each.groupBy("lang", "kind", F.floor(F.col("v") * _STEPS).cast("long").alias("step")).agg(F.count("*").alias("n"))

    found, left = [], rows
    for half, n in enumerate((F.col("n1"), F.col("n") - F.col("n1"))):
        m = spread_of(counts.select("lang", "gram", n.alias("n")).where("n > 0"))
        if m:
            found.append(measured(m, rows.where(F.col("half") == half).join(names(m), "lang")))
            left = left.join(names(m).select("lang", F.lit(half).alias("half")), ["lang", "half"], "left_anti")
    found.append(measured(model, left.join(names(model), "lang")))
    return model, reduce(DataFrame.union, found)


def fit(train: DataFrame, min_count: int = 1, margin: float = 1.25, max_cells: int | None = None) -> Model | Spread | None:
    """A model of train(text, lang), its rejection limits and sharpness set on every training row with a letter.

    N-grams that occur less than min_count times are left out. Of more than max_cells values (null: MAX_CELLS) it stays in tables.
    """
    small_batches(train.sparkSession)
    train = train.where("lang is not null and text is not null").select("text", "lang", (F.crc32("text") % 2).cast("int").alias("half"))
    counts = scratch(counted(train), "grams").where(F.col("n") >= min_count)
    size = counts.agg(F.count_distinct("lang").alias("langs"), F.count("*").alias("rows")).first()
    if not size["rows"]:
        return None
    model, found = (held_by_workers if size["rows"] * size["langs"] <= (MAX_CELLS if max_cells is None else max_cells) else held_in_tables)(train, counts)
    found = found.toPandas()
    bits, gap = found[found["kind"] == "bits"], found[found["kind"] == "gap"]
    if len(bits):
        of = dict(list(bits.groupby("lang")))
        model.limits = np.array([quantile(of[i] if i in of and of[i]["n"].sum() >= FEW else bits, 0.999) * margin for i in range(len(model.langs))])
    if len(gap) and len(model.langs) > 1:  # a text of the middling gap between best and second scores 0.99
        middle = float(np.median([quantile(x, 0.5) for _, x in gap.groupby("lang")]))
        model.sharpness = float(np.clip(math.log2(99) / max(middle, 1e-3), 1, 64))
    return model


def predict(docs: DataFrame, model: Model | Spread | None) -> DataFrame:
    """docs(doc_id, text, ...) with lang_pred, score (0 to 1), bits per character and rejected; other columns stay."""
    told = pa.schema({"lang_pred": pa.string(), "score": pa.float64(), "bits": pa.float64(), "rejected": pa.bool_()})
    rows, sums = docs, None
    if isinstance(model, Spread):
        row = row_name(docs)
        rows, sums = scratch(docs.withColumn(row, F.monotonically_increasing_id()), "texts"), f"{row}_sums"
        rows = rows.join(model.scored(rows, row).select(row, F.struct("n", "bits").alias(sums)), row, "left").select(*[F.col(f"`{c}`") for c in (*docs.columns, sums)])
        model = Model(model.langs, [], [], model.unknown, model.limits, model.sharpness)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # Arrow: the other columns stay what they are
        m = shared.value
        for b in batches:
            if sums:
                zero = {"n": 0, "bits": [0.0] * len(m.langs)}
                each = [x or zero for x in b.column(sums).to_pylist()]
                n, bits = np.array([x["n"] for x in each], np.int64), np.array([x["bits"] for x in each]).reshape(len(each), len(m.langs))
                b = b.select(b.schema.names[:-1])
            else:
                n, bits = m.scored(b.column("text").to_pylist()) if m else (np.zeros(len(b), np.int64), np.zeros((len(b), 1)))
            best = bits.argmin(axis=1)
            low = bits.min(axis=1)
            score = np.where(n > 0, 1 / np.exp2((low[:, None] - bits) * (m.sharpness if m else 1)).sum(axis=1), 0.0)
            limit = m.limits[best] if m and m.limits is not None else np.inf
            pred = np.where(n > 0, np.array(m.langs if m else ["und"], dtype=object)[best], "und")
            values = zip((pred, score, np.where(n > 0, low, 0.0), (n == 0) | (low > limit)), told, strict=True)
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(v, f.type) for v, f in values]], names=[*b.schema.names, *told.names])

    added = StructType().add("lang_pred", "string").add("score", "double").add("bits", "double").add("rejected", "boolean")
    return rows.mapInArrow(judge, StructType([*docs.schema.fields, *added.fields]))


def held_out(id_col: str = "doc_id") -> Column:
    """A quarter of the documents, by id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **how: object) -> DataFrame:
    """doc_id, text, held_out, lang_pred, score, bits, rejected: learned from the labels of the rows that aren't held out."""
    d = one_name(docs, {"doc_id": id_col, "text": text_col, "lang": lang_col})
    model = fit(d.where(~held_out()), **how)
    return predict(d.select("doc_id", "text", held_out().alias("held_out")), model)
