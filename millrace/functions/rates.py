"""Event-time rates, dedup and metrics."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Upper bounds of duration buckets, seconds.
BUCKETS = (0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0)


def rate_window(events: DataFrame, key: str, ts: str, tie: str, n: int, seconds: int) -> DataFrame:
    """The first n events of a key in each window are allowed; others have the seconds to the next window."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    size = seconds * 1_000_000
    start = at - F.pmod(at, F.lit(size))
    rank = F.row_number().over(W.partitionBy(key, "window_start").orderBy(ts, tie))
    out = events.withColumn("window_start", start).withColumn("allowed", rank <= n)
    return out.withColumn("retry_after", F.when(F.col("allowed"), F.lit(0.0)).otherwise((F.col("window_start") + size - at) / 1e6))


def token_bucket(events: DataFrame, key: str, ts: str, tie: str, rate: float, burst: float, idle: float) -> DataFrame:
    """tie, allowed, retry_after. A key's bucket is full at first and after idle seconds; time that goes back takes no tokens.

    Events of a key come to one task in order, one batch at a time; only the bucket is kept between them.
    """
    rows = events.select(F.col(key).alias("k"), (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("t"), F.col(tie).alias("tie"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, tokens, last = None, burst, 0.0
        for b in batches:
            allowed, wait = [], []
            for k, t in zip(b["k"], b["t"], strict=True):
                if k != held or t - last >= idle:
                    held, tokens = k, burst
                else:
                    tokens = min(burst, tokens + max(0.0, t - last) * rate)
                last = t
                ok = tokens >= 1
                tokens -= ok
                allowed.append(ok)
                wait.append(0.0 if ok else (1 - tokens) / rate)
            yield pd.DataFrame({"tie": b["tie"], "allowed": allowed, "retry_after": wait})

    return rows.repartition("k").sortWithinPartitions("k", "t", "tie").mapInPandas(run, "tie long, allowed boolean, retry_after double").withColumnRenamed("tie", tie)


def histogram(events: DataFrame, labels: list[str], value: Column) -> DataFrame:
    """Per label set: count, sum, and the cumulative count of each bucket."""
    counts = [F.count_if(value <= b).alias(f"le_{str(b).replace('.', '_')}") for b in BUCKETS]
    return events.groupBy(*labels).agg(F.count("*").alias("n"), F.sum(value).alias("total"), *counts)


def overflow(counts: DataFrame, labels: list[str], n: str, cap: int) -> DataFrame:
    """The cap most frequent label sets, and one more for all others; no count is lost."""
    top = counts.orderBy(F.desc(n), *labels).limit(cap).select(*[F.col(c).alias(f"_{c}") for c in labels], F.lit(True).alias("_in"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in labels]
    both = counts.join(top, same, "left")
    return both.select(*[F.when(F.col("_in"), F.col(c).cast("string")).otherwise("overflow").alias(c) for c in labels], n).groupBy(*labels).agg(F.sum(n).alias(n))


def ranked(df: DataFrame, key: str, score: str, tie: str) -> DataFrame:
    """Rank from the start (0) and from the end (-1) of each key's members by score."""
    up = W.partitionBy(key).orderBy(score, tie)
    size = F.count("*").over(W.partitionBy(key))
    return df.withColumn("rank", (F.row_number().over(up) - 1).cast("bigint")).withColumn("from_end", F.col("rank") - size)


def first_within(events: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """Streaming: events of a key are dropped while one was kept less than so long ago, by watermark."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, f"{seconds} seconds").dropDuplicatesWithinWatermark([key])


def unique_within(events: DataFrame, key: str, ts: str, tie: str, seconds: float, span: int = 64) -> DataFrame:
    """key, ts, tie of the events that are let through: a key's first one, then each time the first at least so long after
    the last that was; of those at one instant, that of the smallest tie. A null key is a key; rows without a time are out.

    A key's events are taken apart into blocks of `span` such times. A block becomes steps: for when a chain may enter it,
    the last event that it lets through there. Only these steps meet key by key; then each block is gone through from where
    its chain enters, so a key with most of the rows is spread over as many tasks as it has blocks.
    """
    ttl = round(seconds * 1e6)
    types = {c: events.schema[c].dataType for c in (key, tie)}
    k = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("-")).alias("k")
    rows = events.select(k, F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(tie).alias("tie")).where("t is not null")
    rows = rows.groupBy("k", "t").agg(F.min("tie").cast("string").alias("tie")).withColumn("block", F.floor(F.col("t") / (span * ttl)))

    def steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Blocks from their ends: (k, block, upto, last), one row for each last event; a chain that enters at or before upto ends there."""
        group, ahead, late, told, out = None, deque(), None, None, []

        def step(t: int, last: int) -> None:
            nonlocal told
            if last != told:
                out.append((*group, t, last))
                told = last

        for b in batches:
            for g_k, g_block, t in zip(b["k"], b["block"], b["t"], strict=True):
                if (g_k, g_block) != group:
                    if late:
                        step(*late)
                    group, late, told = (g_k, g_block), None, None
                    ahead.clear()
                while len(ahead) > 1 and ahead[1][0] >= t + ttl:
                    ahead.popleft()
                last = ahead[0][1] if ahead and ahead[0][0] >= t + ttl else t
                ahead.append((t, last))
                if t >= g_block * span * ttl + ttl:
                    late = t, last  # of those that every chain may reach, the first
                    continue
                if late:
                    step(*late)
                    late = None
                step(t, last)
            yield pd.DataFrame(out, columns=["k", "block", "upto", "last"])
            out.clear()
        if late:
            step(*late)
            yield pd.DataFrame(out, columns=["k", "block", "upto", "last"])

    def enter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """(k, block, since): the last event let through before a block; null before the first."""
        held, block, since, moved, out = None, None, None, False, []
        for b in batches:
            for g_k, g_block, upto, last in zip(b["k"], b["block"], b["upto"], b["last"], strict=True):
                if g_k != held:
                    held, block, since = g_k, None, None
                if g_block != block:
                    block, moved = g_block, False
                    out.append((g_k, g_block, since))
                if not moved and (since is None or upto >= since + ttl):
                    since, moved = last, True
            yield pd.DataFrame({"k": [x[0] for x in out], "block": [x[1] for x in out], "since": pd.array([x[2] for x in out], dtype="Int64")})
            out.clear()

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, last = None, None
        for b in batches:
            kept = []
            for g_k, g_block, t, since in zip(b["k"], b["block"], b["t"], b["since"], strict=True):
                if (g_k, g_block) != group:
                    group, last = (g_k, g_block), int(since) if since else None
                kept.append(last is None or t >= last + ttl)
                last = t if kept[-1] else last
            yield b.loc[kept, ["k", "t", "tie"]]

    found = rows.repartition("k", "block").sortWithinPartitions("k", "block", F.desc("t")).select("k", "block", "t").mapInPandas(steps, "k string, block long, upto long, last long")
    entries = found.repartition("k").sortWithinPartitions("k", "block", "upto").mapInPandas(enter, "k string, block long, since long")
    joined = rows.join(entries.withColumn("since", F.col("since").cast("string")), ["k", "block"])  # as text, so that a null doesn't make it a float
    kept = joined.repartition("k", "block").sortWithinPartitions("k", "block", "t").select("k", "block", "t", "tie", "since").mapInPandas(follow, "k string, t long, tie string")
    of_key = F.when(F.col("k") != "-", F.col("k").substr(F.lit(2), F.length("k"))).cast(types[key])
    return kept.select(of_key.alias(key), F.timestamp_micros("t").alias(ts), F.col("tie").cast(types[tie]).alias(tie))
