"""Limits on a stream: token buckets, fixed windows and unique jobs, as state by key that outlives a restart.

Every event is judged once, in the micro-batch that brings it; those of a key in a micro-batch in the order of their
times. Its state is forgotten by an event-time timer, when the watermark says that no event can need it: a limit behaves
alike whether the stream runs at the speed of its events or catches up. Events later than `late` behind the newest, and
those without a time, get no answer; a null key is a key of its own. The state store must be RocksDB's (`PROVIDER`).

A task holds one key's rows of one micro-batch, so the size of a micro-batch bounds its memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What spark.sql.streaming.stateStore.providerClass has to be.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
State = tuple[float, int]


def token_bucket(events: DataFrame, key: str, ts: str, tie: str, rate: float, burst: float, idle: float, late: str = "1 minute") -> DataFrame:
    """tie, allowed, retry_after, as rates.token_bucket tells for the events in this order. A rate of 0 or less never refills."""
    rest = round(idle * 1e6)

    def decide(held: State | None, t: int) -> tuple[State, bool, float]:
        if held is None or t - held[1] >= rest:
            tokens = burst
        else:
            tokens = min(burst, held[0] + max(0.0, (t - held[1]) / 1e6) * max(rate, 0.0))
        ok = tokens >= 1
        wait = 0.0 if ok else (1 - tokens) / rate if rate > 0 else idle
        return (tokens - ok, t), ok, wait

    return _judged(events, _key(key), ts, tie, decide, lambda held: held[1] + rest, late)


def rate_window(events: DataFrame, key: str, ts: str, tie: str, n: int, seconds: int, late: str = "1 minute") -> DataFrame:
    """tie, allowed, retry_after: the first n events of a key in each window are allowed; a window has a counter of its own."""
    size = seconds * 1_000_000

    def decide(held: State | None, t: int) -> tuple[State, bool, float]:
        seen = held[0] if held else 0.0
        ok = seen < n
        return (min(seen + 1, float(n)), t - t % size), ok, 0.0 if ok else (size - t % size) / 1e6

    at = F.unix_micros(F.col(ts).cast("timestamp"))
    return _judged(events, F.concat(_key(key), F.lit("@"), (at - F.pmod(at, F.lit(size))).cast("string")), ts, tie, decide, lambda held: held[1] + size, late)


def unique(events: DataFrame, key: str, ts: str, tie: str, seconds: float, late: str = "1 minute") -> DataFrame:
    """tie, allowed, retry_after: an event is let through unless one of its key was, less than so long before it."""
    ttl = round(seconds * 1e6)

    def decide(held: State | None, t: int) -> tuple[State, bool, float]:
        if held is None or t >= held[1] + ttl:
            return (0.0, t), True, 0.0
        return held, False, (held[1] + ttl - t) / 1e6

    return _judged(events, _key(key), ts, tie, decide, lambda held: held[1] + ttl, late)


def _key(name: str) -> Column:
    """Never null: a state's key is text, null has a text that no value has."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit("-"))


def _judged(events: DataFrame, key: Column, ts: str, tie: str, decide: Callable, until: Callable[[State], int], late: str) -> DataFrame:
    class Limit(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle, self.held = handle, handle.getValueState("held", "amount double, at long")

        def handleInputRows(self, key: object, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            held = tuple(self.held.get()) if self.held.exists() else None
            before = held
            b = pd.concat(list(rows)).sort_values(["t", "place", "tie"], kind="stable")
            allowed, wait = [], []
            for t in b["t"]:
                held, ok, seconds = decide(held, int(t))
                allowed.append(bool(ok))
                wait.append(float(seconds))
            self.held.update((float(held[0]), int(held[1])))
            old, new = (None if s is None else -(-until(s) // 1000) for s in (before, held))
            if old != new:
                if old is not None:
                    self.handle.deleteTimer(old)
                self.handle.registerTimer(new)
            yield pd.DataFrame({"tie": b["tie"].to_numpy(), "allowed": allowed, "retry_after": wait})

        def handleExpiredTimer(self, key: object, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            self.held.clear()
            return iter(())

        def close(self) -> None:
            pass

    of = events.schema[tie].dataType
    at = F.col(ts).cast("timestamp")
    rows = events.select(key.alias("k"), at.alias("at"), F.unix_micros(at).alias("t"), F.col(tie).try_cast("bigint").alias("place"), F.col(tie).cast("string").alias("tie")).where("at is not null").withWatermark("at", late)
    rows = rows.withColumn("place", F.coalesce("place", F.lit(0)))  # numbers by value, other ties as text
    out = rows.groupBy("k").transformWithStateInPandas(Limit(), "tie string, allowed boolean, retry_after double", "append", "EventTime")
    return out.select(F.col("tie").cast(of).alias(tie), "allowed", "retry_after")
