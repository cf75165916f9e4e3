"""Replication as a stream: every micro-batch is merged into a versioned store, exactly once in effect."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators import cdc
from millrace.plans.spec import TableSpec
from millrace.sources.changelog import dead_letters, stream_log
from millrace.sources.store import Conflict, VersionedStore

ATTEMPTS, FIRST_WAIT = 3, 0.2


class OffsetRegression(RuntimeError):
    """The log's offsets started anew: applying them would lose changes."""


class TargetBehind(RuntimeError):
    """The target lacks columns of the table: nothing is applied until it has them."""


def attempted(run: Callable[[], object], attempts: int = ATTEMPTS, first_wait: float = FIRST_WAIT, sleep: Callable[[float], None] = time.sleep) -> object:
    """What run returns, tried again after waits that double; the last error is raised."""
    for i in range(attempts):
        try:
            return run()
        except Exception:
            if i == attempts - 1:
                raise
            sleep(first_wait * 2**i)
    raise ValueError("no attempts")


def deliver(records: DataFrame, handler: Callable[[dict], None], group: str, attempts: int = ATTEMPTS, first_wait: float = FIRST_WAIT) -> DataFrame:
    """Hands each record of a log to the handler on the executors; the dead letters of those that it refuses each time.

    A reason has the error's type, as its text may have values. A lost executor's records are handed over again.
    """
    place = ["topic", "partition", "offset"]
    names = [*place, "key", "value", "headers", "timestamp"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            failed, reasons = [], []
            for i, record in enumerate(b.to_dict("records")):
                try:
                    attempted(lambda r=record: handler(r), attempts, first_wait)
                except Exception as e:  # noqa: BLE001 - whatever a handler raises parks its record
                    failed.append(i)
                    reasons.append(type(e).__name__)
            yield b.iloc[failed][place].assign(reason=pd.Series(reasons, dtype=object, index=b.index[failed]))

    parked = records.select(*names).mapInPandas(run, "topic string, partition int, offset long, reason string")
    return dead_letters(records.select(*names).join(parked, place), group, attempts)


def apply_batch(batch: DataFrame, batch_id: int | None, store: VersionedStore, spec: TableSpec, group: str = "replica") -> dict[str, int]:
    """One batch: skip what is covered, park what can't be decoded or breaks a check, refuse positions (lsn) below a row's
    own or that of a change before, fold the rest, and commit rows, row states, positions and dead letters together. Returns totals.

    Reads and rewrites only the buckets that the batch's keys fall into.
    """
    spark, base = batch.sparkSession, store.manifest()
    have = store.read("data", manifest=base)
    if have is not None and (missing := cdc.missing_columns(spec, have)):
        raise TargetBehind(f"the target has no column {', '.join(missing)}")
    checkpoints = store.read("checkpoints", manifest=base)
    if checkpoints is not None and not cdc.regressions(batch, checkpoints).isEmpty():
        raise OffsetRegression("covered records are newer than the checkpoint")
    fresh = cdc.classify(cdc.uncovered(batch, checkpoints), spec).persist()
    try:
        touched = sorted(r[0] for r in fresh.where("kind = 'change'").select(store.bucket("row_key")).distinct().collect())  # as many as there are buckets at most
        rows = store.read("data", spec.schema, touched, base)
        rows = spark.createDataFrame([], spec.schema) if rows is None else rows
        state = store.read("state", "row_key string, lsn long, deleted boolean, updated_at timestamp", touched, base)
        bad = fresh.where("kind = 'change' and not is_delete").select("topic", "partition", "offset", "row.*").withColumn("broken", cdc.violations(spec.checks)).where(F.size("broken") > 0)
        bad = bad.select("topic", "partition", "offset", F.concat(F.lit("checks: "), F.array_join("broken", ",")).alias("broken"))
        judged = fresh.join(bad, ["topic", "partition", "offset"], "left").withColumn("reason", F.coalesce("reason", "broken"))
        good = judged.where("kind = 'change' and reason is null")
        good = cdc.in_position(good if state is None else cdc.claim(good, state))
        result = cdc.fold(good.select("row_key", "offset", "is_delete", "version", "row", "lsn"), rows, spec)
        n = lambda condition: F.count_if(F.expr(condition))
        totals = judged.agg(F.count("*").alias("records"), n("kind = 'change' and reason is null").alias("decoded"), n("reason is not null").alias("dead_lettered"), n("kind = 'tombstone'").alias("tombstones")).first().asDict()
        totals["applied"] = good.count()
        tables = {"data": cdc.apply_rows(rows, result, spec), "state": cdc.row_states(good, state), "checkpoints": cdc.advance(batch, checkpoints)}
        if totals["dead_lettered"]:
            parked = judged.where("reason is not null").select("topic", "partition", "offset", "key", "value", "headers", "timestamp", "reason")
            tables["letters"] = dead_letters(parked, group)
        store.commit(tables, batch_id, {"data": (spec.id_col, touched), "state": ("row_key", touched)}, ("letters",), base)
        return totals
    finally:
        fresh.unpersist()


def replicate(spark: SparkSession, log_path: str, store: VersionedStore, spec: TableSpec, checkpoint: str, files_per_batch: int = 1, every: str | None = None, attempts: int = ATTEMPTS, first_wait: float = FIRST_WAIT) -> StreamingQuery:
    """Runs over the files that are there, or, with `every` (an interval), goes on with those that come.

    A batch is tried again after waits that double; one that still fails stops the query, and is run again when it is
    started anew. One that is committed is never run again. Dead letters are in the store's part "letters".
    """
    spec.validate()

    def handle(batch: DataFrame, batch_id: int) -> None:
        def once() -> None:
            done = store.manifest()["batch"]
            if done is None or done < batch_id:
                try:
                    apply_batch(batch, batch_id, store, spec)
                except Conflict:
                    if (store.manifest()["batch"] or -1) < batch_id:
                        raise

        attempted(once, attempts, first_wait)

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return stream_log(spark, log_path, files_per_batch=files_per_batch).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(**trigger).start()
