"""Limits on streams and in batch, against loops over the events."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.functions import rates
from millrace.streaming import limits

START = datetime(2024, 1, 1)
SCHEMA = "id long, k string, at timestamp"


def events(seed, n=240, keys=("a", "b", "c", None), gap=40):
    """In order of time, some at one instant; one key has half of them."""
    r, at, out = random.Random(seed), START, []
    for i in range(n):
        at += timedelta(seconds=r.choice([0, 1, 5, gap, gap * 8 if i % 50 == 0 else 2]))
        out.append((i + 2**60, r.choice(["a", *keys]), at))
    return out


def chains(rows, seconds):
    held, kept = {}, set()
    for i, k, at in sorted(rows, key=lambda x: (x[2], x[0])):
        if k not in held or at >= held[k] + timedelta(seconds=seconds):
            held[k] = at
            kept.add(i)
    return kept


@pytest.mark.parametrize(("seed", "seconds", "span"), [(1, 30, 1), (2, 30, 2), (3, 7, 3), (4, 300, 1), (5, 1, 64)])
def test_unique_within_against_a_loop(spark, seed, seconds, span):
    rows = events(seed)
    got = rates.unique_within(spark.createDataFrame(rows, SCHEMA).repartition(3), "k", "at", "id", seconds, span)
    assert [(f.name, f.dataType.simpleString()) for f in got.schema.fields] == [("k", "string"), ("at", "timestamp"), ("id", "bigint")]
    got = got.collect()
    assert len({r.id for r in got}) == len(got)
    assert {r.id for r in got} == chains(rows, seconds)
    assert {(r.id, r.k, r.at) for r in got} <= set(rows)


def test_unique_within_hard_rows(spark):
    rows = [(1, None, START), (2, None, START), (3, "-", START), (4, "a", None), (5, "", START)]
    assert sorted(r.id for r in rates.unique_within(spark.createDataFrame(rows, SCHEMA), "k", "at", "id", 10).collect()) == [1, 3, 5]
    assert rates.unique_within(spark.createDataFrame([], SCHEMA), "k", "at", "id", 10).count() == 0


def test_a_key_with_all_events_is_spread(spark):
    rows = spark.range(20_000).select("id", F.lit("hot").alias("k"), F.timestamp_seconds(F.col("id") * 3).alias("at"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be put together
    try:
        got = rates.unique_within(rows, "k", "at", "id", 10, span=16)
        assert got.count() == 5000  # every fourth: 12 seconds
        assert got.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def loop(rows, decide):
    held, out = {}, {}
    for i, k, at in rows:
        held[k], out[i] = decide(held.get(k), at)
    return out


def streamed(spark, tmp_path, rows, judge, parts=4):
    """Written as files of a stream, read one a batch, with a new query (and its state from disk) for every other file."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", limits.PROVIDER)
    n = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * n : i * n + n], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if i % 2:
            source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            judge(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len({r.id for r in got}) == len(got)
    return {r.id: (r.allowed, round(r.retry_after, 4)) for r in got}


def test_streamed_bucket_is_the_batch_one_across_a_restart(spark, tmp_path):
    rows = events(11)
    got = streamed(spark, tmp_path, rows, lambda s: limits.token_bucket(s, "k", "at", "id", 0.02, 2, 200))
    batch = rates.token_bucket(spark.createDataFrame(rows, SCHEMA).where("k is not null"), "k", "at", "id", 0.02, 2, 200).collect()
    want = {r.id: (r.allowed, round(r.retry_after, 4)) for r in batch}
    assert {i: v for i, v in got.items() if i in want} == want
    assert set(got) == {r[0] for r in rows}
    assert {True, False} == {v[0] for v in got.values()}


def test_streamed_window_is_the_batch_one_across_a_restart(spark, tmp_path):
    rows = events(12)
    got = streamed(spark, tmp_path, rows, lambda s: limits.rate_window(s, "k", "at", "id", 2, 60))
    want = {r.id: (r.allowed, round(r.retry_after, 4)) for r in rates.rate_window(spark.createDataFrame(rows, SCHEMA), "k", "at", "id", 2, 60).collect()}
    assert got == want


def test_streamed_unique_is_the_batch_one_across_a_restart(spark, tmp_path):
    rows = events(13)
    got = streamed(spark, tmp_path, rows, lambda s: limits.unique(s, "k", "at", "id", 45))
    assert {i for i, v in got.items() if v[0]} == chains(rows, 45)
    assert set(got) == {r[0] for r in rows}


def test_streamed_bucket_without_a_rate(spark, tmp_path):
    """It never refills; full again when it was idle. Times that go back take no tokens."""
    rows = [(1, "a", START + timedelta(seconds=50)), (2, "a", START + timedelta(seconds=45)), (3, "a", START + timedelta(seconds=60)), (4, "a", START + timedelta(seconds=99)), (5, "a", None)]
    got = streamed(spark, tmp_path, rows, lambda s: limits.token_bucket(s, "k", "at", "id", 0, 1, 30), parts=2)
    assert got == {2: (True, 0.0), 1: (False, 30.0), 3: (False, 30.0), 4: (True, 0.0)}
