"""The repair of parked rows as a loop over a store: keys wait with a due time, are claimed for a while, and healed or put off.

The store's part "repairs" has a row for each waiting key: attempts, when it is due, and who holds it until when. A pass
seeds it from the dead letters that came since the last one, claims up to `limit` keys that are due, makes the replica's
rows of these keys equal to the source's, and commits rows and waiting keys together. A key whose row still breaks a check
waits twice as long each time. What a crashed pass holds is free again after its lease; a pass that comes back late finds
that it holds nothing and changes nothing. All of it touches only the buckets of the keys.
"""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators import cdc
from millrace.plans.spec import TableSpec
from millrace.sources.changelog import SCHEMA
from millrace.sources.store import Conflict, VersionedStore

#: A pass claims so many keys at once, and claims so many times; seconds to the first repeat, the longest wait, the lease.
LIMIT, CLAIMS, FIRST, LONGEST, LEASE = 500, 10, 30, 3600, 300
WAITING = "row_key string, attempts int, due timestamp, lease timestamp, holder string"
NAMES = [c.split()[0] for c in WAITING.split(", ")]


def waiting(store: VersionedStore, manifest: dict | None = None, buckets: list[int] | None = None) -> DataFrame:
    rows = store.read("repairs", WAITING, buckets, manifest)
    return store.spark.createDataFrame([], WAITING) if rows is None else rows.select(*NAMES)


def parked_keys(letters: DataFrame, spec: TableSpec) -> DataFrame:
    """row_key of the letters whose record has a key that can be read; others can't be repaired."""
    key = F.try_parse_json("key")
    found = F.coalesce(cdc.get(key, spec.id_col, as_type="string"), cdc.get(key, "payload", spec.id_col, as_type="string"))
    return letters.select(found.alias("row_key")).where("row_key is not null and row_key not in ('', '0')").distinct()


def claim(store: VersionedStore, spec: TableSpec, now: datetime, limit: int = LIMIT, lease: float = LEASE) -> str | None:
    """Takes new letters in, then up to `limit` keys that are due and free, the longest due first; who holds them, None if nobody need.

    Raises Conflict if another writer was first.
    """
    spark, base = store.spark, store.manifest()
    mark = store.read("repair_mark", "seeded long", manifest=base)
    seeded = mark.first().seeded if mark is not None else 0
    news = [int(v) for v in base["paths"].get("letters", {}) if int(v) > seeded]  # a commit's letters are known by its version
    pool = waiting(store, base)
    at = F.lit(now).cast("timestamp")
    fresh = spark.createDataFrame([], WAITING)
    if news:
        keys = parked_keys(store.read("letters", SCHEMA, news, base), spec)
        fresh = keys.join(pool, "row_key", "left_anti").select("row_key", F.lit(0).alias("attempts"), at.alias("due"), F.lit(None).cast("timestamp").alias("lease"), F.lit(None).cast("string").alias("holder"))
    rows = pool.unionByName(fresh)
    due = rows.where((F.col("due") <= at) & (F.col("lease").isNull() | (F.col("lease") <= at))).orderBy("due", "row_key").limit(limit)
    mine = [r.row_key for r in due.select("row_key").collect()]  # limit at most
    if not mine and not news:
        return None
    taken = spark.createDataFrame([(k,) for k in mine], "row_key string")
    touched = sorted(r[0] for r in taken.union(fresh.select("row_key")).select(store.bucket("row_key")).distinct().collect())
    holder = uuid.uuid4().hex
    held = F.col("_mine").isNotNull()
    out = rows.where(store.bucket("row_key").isin(touched)).join(F.broadcast(taken.withColumn("_mine", F.lit(True))), "row_key", "left")
    out = out.withColumns({"lease": F.when(held, F.lit(now + timedelta(seconds=lease)).cast("timestamp")).otherwise(F.col("lease")), "holder": F.when(held, holder).otherwise(F.col("holder"))})
    tables = {"repair_mark": spark.createDataFrame([(max([seeded, *news]),)], "seeded long")}
    if touched:
        tables["repairs"] = out.select(*NAMES)
    store.commit(tables, base["batch"], {"repairs": ("row_key", touched)}, base=base)
    return holder if mine else None


def settle(store: VersionedStore, source: DataFrame, spec: TableSpec, holder: str, now: datetime, first: int = FIRST, longest: int = LONGEST) -> dict[str, int]:
    """Heals what the holder still holds: rows and waiting keys in one commit. How many were repaired, and how many refused."""
    spark, base = store.spark, store.manifest()
    keys = [r.row_key for r in waiting(store, base).where(F.col("holder") == holder).select("row_key").collect()]  # a claim's limit at most
    if not keys:
        return {"repaired": 0, "refused": 0}
    mine = F.broadcast(spark.createDataFrame([(k,) for k in keys], "row_key string"))
    touched = sorted(r[0] for r in mine.select(store.bucket("row_key")).distinct().collect())
    rows = store.read("data", spec.schema, touched, base)
    rows = spark.createDataFrame([], spec.schema) if rows is None else rows
    healed, still = cdc.repair(mine, source, rows, spec)
    refused = [r.row_key for r in still.select("row_key").distinct().collect()]
    bad = F.broadcast(spark.createDataFrame([(k,) for k in refused], "row_key string"))
    pool = waiting(store, base, touched)
    wait = cdc.backoff(F.col("attempts") + 1, first, longest)
    later = pool.join(bad, "row_key", "left_semi").withColumns({"due": F.timestamp_seconds(F.unix_micros(F.lit(now).cast("timestamp")) / F.lit(1e6) + wait), "attempts": F.col("attempts") + 1, "lease": F.lit(None).cast("timestamp"), "holder": F.lit(None).cast("string")})
    left = pool.join(mine, "row_key", "left_anti").unionByName(later.select(*NAMES))
    store.commit({"data": healed, "repairs": left}, base["batch"], {"data": (spec.id_col, touched), "repairs": ("row_key", touched)}, base=base)
    return {"repaired": len(keys) - len(refused), "refused": len(refused)}


def release(store: VersionedStore, holder: str) -> None:
    """The holder's keys are due as before, without an attempt more."""
    base = store.manifest()
    rows = waiting(store, base)
    touched = sorted(r[0] for r in rows.where(F.col("holder") == holder).select(store.bucket("row_key")).distinct().collect())
    if not touched:
        return
    own = F.col("holder") == holder
    out = rows.where(store.bucket("row_key").isin(touched)).withColumns({"lease": F.when(~F.coalesce(own, F.lit(False)), F.col("lease")), "holder": F.when(~own, F.col("holder"))})
    store.commit({"repairs": out.select(*NAMES)}, base["batch"], {"repairs": ("row_key", touched)}, base=base)


def tick(store: VersionedStore, source: Callable[[], DataFrame], spec: TableSpec, now: Callable[[], datetime] = datetime.now, limit: int = LIMIT, claims: int = CLAIMS, first: int = FIRST, longest: int = LONGEST, lease: float = LEASE, tries: int = 5) -> dict[str, int]:
    """One pass: claims and heals until nothing is due or it has claimed often enough. Totals.

    A lost race is run again. Any other error frees the keys and is raised: they stay due, no attempt is counted.
    """
    totals = {"repaired": 0, "refused": 0}
    for _ in range(claims):
        holder = _again(lambda: claim(store, spec, now(), limit, lease), tries)
        if holder is None:
            break
        try:
            done = _again(lambda h=holder: settle(store, source(), spec, h, now(), first, longest), tries)
        except Exception:
            _again(lambda h=holder: release(store, h), tries)
            raise
        totals = {k: v + done[k] for k, v in totals.items()}
    return totals


def _again(run: Callable[[], object], tries: int) -> object:
    for i in range(tries):
        try:
            return run()
        except Conflict:
            if i == tries - 1:
                raise
    raise ValueError("no tries")


def repair_loop(spark: SparkSession, store: VersionedStore, source: Callable[[], DataFrame], spec: TableSpec, checkpoint: str, every: str = "30 seconds", **more: object) -> StreamingQuery:
    """A pass at each trigger of a stream that has nothing else to do. A pass that fails is put off to the next trigger."""

    def handle(_: DataFrame, batch_id: int) -> None:
        try:
            tick(store, source, spec, **more)
        except Exception as e:  # noqa: BLE001 - the keys are free again; its text may have values of rows
            logging.getLogger(__name__).warning("pass %d put off: %s", batch_id, type(e).__name__)

    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return clock.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
