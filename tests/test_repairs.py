"""The repair loop: due times, limits, leases, crashes and races."""

import json
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from millrace.plans.spec import TableSpec
from millrace.sources import changelog
from millrace.sources.store import Conflict, VersionedStore
from millrace.streaming import repairs
from millrace.streaming.replicate import apply_batch

SCHEMA = StructType([StructField("id", LongType()), StructField("owner", StringType()), StructField("version", LongType())])
SPEC = TableSpec("accounts", "id", SCHEMA, version_col="version", checks={"not 13": "version <> 13"})
NOW = datetime(2024, 5, 1, 12)


def record(offset, key, version, owner="log"):
    body = {"op": "c", "after": {"id": key, "owner": owner, "version": version}, "source": {"table": "accounts"}}
    return ("bank.public.accounts", 0, offset, json.dumps({"id": key}), json.dumps(body), [], NOW + timedelta(seconds=offset))


def parked_store(spark, tmp_path, bad=(2, 4), good=(1, 3), first=0):
    """A replica that has taken the good rows, and parked the bad ones."""
    store = VersionedStore(spark, str(tmp_path / "replica"), buckets=4)
    rows = [record(first + i, k, 13 if k in bad else 1) for i, k in enumerate((*good, *bad))]
    apply_batch(spark.createDataFrame(rows, changelog.SCHEMA), store.version(), store, SPEC)
    return store


def rows(store):
    return {r.id: (r.owner, r.version) for r in store.read("data", SCHEMA).collect()}


def waits(store):
    return {r.row_key: (r.attempts, r.due, r.holder) for r in repairs.waiting(store).collect()}


def source(spark, *given):
    return spark.createDataFrame(list(given), SCHEMA)


def test_fails_twice_then_heals(spark, tmp_path):
    store = parked_store(spark, tmp_path)
    batch = store.manifest()["batch"]
    clock = [NOW]
    now = lambda: clock[0]
    state = [(2, "src", 13), (4, "src", 5), (9, "src", 1)]
    assert repairs.tick(store, lambda: source(spark, *state), SPEC, now) == {"repaired": 1, "refused": 1}
    assert rows(store) == {1: ("log", 1), 3: ("log", 1), 4: ("src", 5)}  # only what was parked
    assert waits(store) == {"2": (1, NOW + timedelta(seconds=60), None)}
    clock[0] = NOW + timedelta(seconds=59)
    before = store.version()
    assert repairs.tick(store, lambda: source(spark, *state), SPEC, now) == {"repaired": 0, "refused": 0}
    assert store.version() == before  # nothing was due, nothing is written
    clock[0] = NOW + timedelta(seconds=60)
    assert repairs.tick(store, lambda: source(spark, *state), SPEC, now) == {"repaired": 0, "refused": 1}
    assert waits(store) == {"2": (2, clock[0] + timedelta(seconds=120), None)}
    clock[0] += timedelta(seconds=120)
    assert repairs.tick(store, lambda: source(spark, (2, "healed", 14)), SPEC, now) == {"repaired": 1, "refused": 0}
    assert waits(store) == {}
    assert rows(store)[2] == ("healed", 14)
    assert store.manifest()["batch"] == batch  # the stream's own place isn't lost


def test_a_row_that_the_source_has_no_more_goes(spark, tmp_path):
    store = parked_store(spark, tmp_path, bad=(), good=(1, 2))
    parked_store(spark, tmp_path, bad=(2,), good=(), first=10)
    assert set(rows(store)) == {1, 2}
    repairs.tick(store, lambda: source(spark), SPEC, lambda: NOW)
    assert set(rows(store)) == {1}
    assert waits(store) == {}


def test_crash_between_claim_and_commit(spark, tmp_path):
    store = parked_store(spark, tmp_path)
    crashed = repairs.claim(store, SPEC, NOW, lease=300)
    assert {v[2] for v in waits(store).values()} == {crashed}
    assert repairs.claim(store, SPEC, NOW + timedelta(seconds=299)) is None  # held
    late = NOW + timedelta(seconds=300)
    other = repairs.claim(store, SPEC, late)
    assert other not in (None, crashed)
    src = source(spark, (2, "src", 1), (4, "src", 1))
    before = store.version()
    assert repairs.settle(store, src, SPEC, crashed, late) == {"repaired": 0, "refused": 0}  # it comes back too late
    assert store.version() == before
    assert repairs.settle(store, src, SPEC, other, late) == {"repaired": 2, "refused": 0}
    assert repairs.settle(store, src, SPEC, other, late) == {"repaired": 0, "refused": 0}
    assert rows(store) == {1: ("log", 1), 2: ("src", 1), 3: ("log", 1), 4: ("src", 1)}


def test_limits_and_order(spark, tmp_path):
    store = parked_store(spark, tmp_path, bad=tuple(range(10, 17)))
    repairs.claim(store, SPEC, NOW, limit=3)
    assert sorted(k for k, v in waits(store).items() if v[2]) == ["10", "11", "12"]
    full = source(spark, *[(k, "src", 1) for k in range(10, 17)])
    assert repairs.tick(store, lambda: full, SPEC, lambda: NOW, limit=2, claims=1) == {"repaired": 2, "refused": 0}
    assert repairs.tick(store, lambda: full, SPEC, lambda: NOW, limit=2, claims=9) == {"repaired": 2, "refused": 0}
    assert sorted(waits(store)) == ["10", "11", "12"]


def test_letters_are_taken_in_once(spark, tmp_path):
    store = parked_store(spark, tmp_path)
    full = source(spark, *[(k, "src", 1) for k in (2, 4, 6)])
    repairs.tick(store, lambda: full, SPEC, lambda: NOW)
    assert repairs.claim(store, SPEC, NOW) is None  # the same letters don't wait again
    parked_store(spark, tmp_path, bad=(6,), good=(7,), first=100)
    assert repairs.tick(store, lambda: full, SPEC, lambda: NOW) == {"repaired": 1, "refused": 0}


def test_a_source_that_is_away(spark, tmp_path):
    store = parked_store(spark, tmp_path)

    def away():
        raise OSError("no route")

    with pytest.raises(OSError, match="no route"):
        repairs.tick(store, away, SPEC, lambda: NOW)
    assert waits(store) == {"2": (0, NOW, None), "4": (0, NOW, None)}
    assert repairs.tick(store, lambda: source(spark, (2, "a", 1), (4, "a", 1)), SPEC, lambda: NOW) == {"repaired": 2, "refused": 0}


def test_a_lost_race_is_run_again(spark, tmp_path, monkeypatch):
    store = parked_store(spark, tmp_path)
    commit, lost = store.commit, []

    def racing(*a, **k):
        if len(lost) < 2:
            lost.append(1)
            raise Conflict("first")
        return commit(*a, **k)

    monkeypatch.setattr(store, "commit", racing)
    assert repairs.tick(store, lambda: source(spark, (2, "a", 1), (4, "a", 1)), SPEC, lambda: NOW) == {"repaired": 2, "refused": 0}
    assert rows(store) == {1: ("log", 1), 2: ("a", 1), 3: ("log", 1), 4: ("a", 1)}


def test_loop_runs_passes(spark, tmp_path):
    store = parked_store(spark, tmp_path)
    running = repairs.repair_loop(spark, store, lambda: source(spark, (2, "a", 1), (4, "a", 1)), SPEC, str(tmp_path / "c"), every="1 second")
    try:
        for _ in range(60):
            if rows(store).keys() == {1, 2, 3, 4} and not waits(store):
                break
            time.sleep(0.5)
    finally:
        running.stop()
    assert waits(store) == {}
    assert set(rows(store)) == {1, 2, 3, 4}
