import json
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DateType, DoubleType, LongType, ShortType, StringType, StructField, StructType, TimestampType

from millrace.functions import rates
from millrace.operators import cdc
from millrace.plans.spec import TableSpec
from millrace.sources import changelog
from millrace.sources.store import Conflict, VersionedStore
from millrace.streaming import replicate as stream
from millrace.streaming.replicate import replicate

SCHEMA = StructType([StructField("id", LongType()), StructField("owner", StringType()), StructField("version", LongType())])
SPEC = TableSpec("accounts", "id", SCHEMA, version_col="version", checks={"not 13": "version <> 13"})


def record(offset, op, key, version=None, owner="x", value=None, at=0):
    row = {"id": key, "owner": owner, "version": version}
    body = {"op": op, "before": row if op == "d" and version is not None else None, "after": None if op == "d" else row, "source": {"schema": "public", "table": "accounts", "lsn": offset * 10}}
    return ("bank.public.accounts", 0, offset, json.dumps({"id": key}), json.dumps(body) if value is None else value, [], datetime(2024, 1, 1) + timedelta(seconds=at or offset))


def history(seed, n=150):
    r = random.Random(seed)
    return [record(i, r.choice("cuuuurd"), r.randint(1, 12), r.choice([None, *range(12)]), f"o{i}") for i in range(n)]


def model(records):
    """One change at a time."""
    rows, have = {}, {}
    for _, _, offset, _, value, *_ in sorted(records, key=lambda x: x[2]):
        e = json.loads(value)
        image = e["after"] or e["before"]
        key = image["id"] if image else json.loads(records[offset][3])["id"]
        version = image["version"] if image else None
        held = have.get(key)
        if e["op"] == "d":
            if key in rows and held is not None and version is not None and version != 0 and held > version:
                continue
            rows.pop(key, None)
            have.pop(key, None)
            continue
        if key in rows and held is not None and (version is None or held > version):
            continue
        rows[key], have[key] = image, version
    return {k: (v["owner"], v["version"]) for k, v in rows.items()}


@pytest.mark.parametrize("seed", range(3))
def test_fold_is_one_at_a_time(spark, seed):
    records = history(seed)
    log = spark.createDataFrame(records, changelog.SCHEMA).repartition(3)
    rows = spark.createDataFrame([], SCHEMA)
    for lo in range(0, len(records), 60):  # in batches, each on what the one before it left
        part = cdc.classify(log.where(F.col("offset").between(lo, lo + 59)), SPEC).where("kind = 'change'")
        rows = spark.createDataFrame(cdc.apply_rows(rows, cdc.fold(part, rows, SPEC), SPEC).select("id", "owner", "version").collect(), SCHEMA)
    assert {r.id: (r.owner, r.version) for r in rows.collect()} == model(records)


@pytest.mark.parametrize(
    ("value", "kind"),
    [("", "tombstone"), (None, "tombstone"), ("{nope", "dead"), ('{"op": ""}', "dead"), ('{"op": "t"}', "truncate"), ('{"op": "m"}', "unsupported"), ('{"op": "c", "after": {"id": 1, "version": 40000000000000000000}}', "dead"), ('{"op": "c", "after": {"id": 0}}', "dead"), ('{"op": "u", "after": {"id": 1, "owner": "__debezium_unavailable_value"}}', "dead"), ('{"schema": {}, "payload": {"op": "c", "after": {"id": 5, "owner": "é", "extra": 1}}}', "change"), ('{"op": "c", "after": {"id": 1}, "source": {"table": "others"}}', "dead"), ('{"op": "c", "after": {"id": 1, "owner": "secret-value", "version": "abc"}}', "dead")],
)
def test_classify(spark, value, kind):
    rec = list(record(1, "c", 1))
    rec[4] = value
    row = cdc.classify(spark.createDataFrame([tuple(rec)], changelog.SCHEMA), SPEC).first()
    assert row.kind == kind
    assert "secret-value" not in (row.reason or "")


KINDS = StructType([StructField(n, t) for n, t in {"id": LongType(), "small": ShortType(), "whole": LongType(), "real": DoubleType(), "yes": BooleanType(), "text": StringType(), "doc": StringType(), "at": TimestampType(), "day": DateType(), "raw": BinaryType()}.items()])
KIND_SPEC = TableSpec("kinds", "id", KINDS, kinds={"doc": "json"})
INSTANT = datetime(2025, 7, 8, 9, 10, 11)
ACCEPTED = [
    ("text", '"plain"', "plain"), ("text", '""', ""), ("text", '"日本 🎈 ñ"', "日本 🎈 ñ"), ("text", r'"a\"b\\c\nd\te"', 'a"b\\c\nd\te'), ("text", '"' + "y" * 70000 + '"', "y" * 70000), ("text", "null", None), ("text", "17", "17"), ("text", "true", "true"),
    ("small", "32767", 32767), ("small", "-32768", -32768), ("small", '"12"', 12), ("small", "null", None), ("whole", "9223372036854775807", 2**63 - 1), ("whole", "-9223372036854775808", -(2**63)), ("whole", "0", 0), ("whole", '"456"', 456), ("whole", "9007199254740993", 2**53 + 1),
    ("real", "2.718281828459045", 2.718281828459045), ("real", "4", 4.0), ("real", "2.5e3", 2500.0), ("real", "-0.125", -0.125), ("real", '"7.5"', 7.5), ("real", "null", None),
    ("yes", "true", True), ("yes", "false", False), ("yes", '"t"', True), ("yes", "null", None),
    ("doc", '{"a": [1, {"b": null}]}', '{"a":[1,{"b":null}]}'), ("doc", "[3,4]", "[3,4]"), ("doc", '"{\\"k\\": 1}"', '{"k": 1}'), ("doc", '"42"', "42"),
    ("at", '"2025-07-08T09:10:11Z"', INSTANT), ("at", '"2025-07-08T09:10:11.250001Z"', INSTANT.replace(microsecond=250001)), ("at", '"2025-07-08T17:10:11+08:00"', INSTANT), ("at", "null", None),
    ("day", "20000", date(2024, 10, 4)), ("day", "0", date(1970, 1, 1)), ("day", "-1", date(1969, 12, 31)), ("day", "null", None), ("raw", '"AQIDBA=="', b"\x01\x02\x03\x04"), ("raw", '""', b""), ("raw", "null", None), ("nope", "1", None),
]
REFUSED = [
    ("whole", '"many"'), ("whole", "{}"), ("whole", "[1]"), ("whole", "true"), ("whole", "1.5"), ("whole", '"1.5"'), ("whole", "9223372036854775808"), ("whole", "-9223372036854775809"), ("small", "32768"), ("small", '"__debezium_unavailable_value"'),
    ("text", '{"a": 1}'), ("text", "[1, 2]"), ("text", '"__debezium_unavailable_value"'), ("text", r'"a\u0000b"'), ("doc", '"__debezium_unavailable_value"'), ("at", "{}"), ("at", "1700000000000"), ("at", '"yesterday"'), ("at", '"2025-07-08 09:10:11"'),
    ("yes", '"perhaps"'), ("yes", "[true]"), ("raw", '"!!!"'), ("raw", "5"), ("day", "1.5"), ("day", '"not a date"'), ("real", '"x"'), ("real", "{}"),
]


def images(spark, values):
    rows = [("kinds", 0, i, json.dumps({"id": i + 1}), v, [], datetime(2024, 1, 1)) for i, v in enumerate(values)]
    return {r.offset: r for r in cdc.classify(spark.createDataFrame(rows, changelog.SCHEMA), KIND_SPEC).select("offset", "kind", "reason", "row").collect()}


def test_accepted_forms(spark):
    got = images(spark, [f'{{ "op":"c", "after": {{"{c}" : {v}, "id":{i + 1}}} }}' for i, (c, v, _) in enumerate(ACCEPTED)])
    for i, (c, v, want) in enumerate(ACCEPTED):
        assert got[i].kind == "change", (c, v, got[i].reason)
        if c != "nope":
            assert got[i].row[c] == want, (c, v)


def test_refused_forms(spark):
    got = images(spark, [f'{{"op":"u","after":{{"id":{i + 1},"{c}":{v}}}}}' for i, (c, v) in enumerate(REFUSED)])
    for i, (c, v) in enumerate(REFUSED):
        assert (got[i].kind, got[i].reason) == ("dead", f"columns: {c}"), (c, v)
    whole = ["null", "", '"x"', "5", "[1]", '{"id":1,"text":', "{id:1}", '{"text":"x"}', '{"id":0}', '{"id":null}']
    assert {r.kind for r in images(spark, [f'{{"op":"u","after":{x}}}' for x in whole]).values()} == {"dead"}


@pytest.mark.parametrize("value", ["nope", '{"op":"c","after":', "[1,2]", '"hello"', "42", "null", "{}", '{"after":{"id":1}}', '{"payload":{"x":1}}', '{"schema":{"type":"struct"}}', '{"op":5}', 'x{"op":"c"}', "<html></html>", "  \n ", '{"payload":{"payload":{"op":"c"}}}'])
def test_not_an_event(spark, value):
    assert images(spark, [value])[0].reason == "not a change event"


def test_one_parse_a_record(spark):
    """However a consumer filters, the optimized plan parses value and key once."""
    log = spark.createDataFrame(history(1, 5), changelog.SCHEMA)
    before = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    plan = cdc.classify(log, SPEC).where("kind = 'change' and not is_delete").select("offset", "row.*")._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.set("spark.sql.debug.maxToStringFields", before)
    assert plan.count("parseJson") == 2
    assert plan.count("variant_get") < 40


def test_stream_is_exactly_once_in_effect(spark, tmp_path):
    records = history(7, 90)
    log = str(tmp_path / "log")
    bad = [record(90, "c", 99, 13), record(91, "c", 98, 1, value="{broken")]
    for part in (records[:40], records[30:70], records[70:] + bad):  # the second file redelivers ten
        changelog.publish(spark.createDataFrame(part, changelog.SCHEMA).coalesce(1), log)
    store = VersionedStore(spark, str(tmp_path / "replica"), buckets=4)
    for _ in range(2):  # started anew, nothing is applied twice
        replicate(spark, log, store, SPEC, str(tmp_path / "ckpt")).awaitTermination()
    assert store.version() == 3
    assert {r.id: (r.owner, r.version) for r in store.read("data").collect()} == model(records)
    dead = store.read("letters", changelog.SCHEMA)
    letters = changelog.read_dead_letters(dead).withColumn("reason", changelog.header("dlq.reason")).collect()
    assert [(x.offset, x.reason) for x in letters] == [(90, "checks: not 13"), (91, "not a change event")]
    assert store.read("checkpoints").first().next_offset == 92
    with pytest.raises(changelog.TooMany):
        changelog.read_dead_letters(dead, limit=1)


@pytest.mark.parametrize("fails_at", range(1, 6))
def test_a_crash_between_any_two_steps(spark, tmp_path, monkeypatch, fails_at):
    """Tables are written one by one, then the manifest: whatever step fails, the next run leaves what one run would."""
    records = [*history(3, 30), record(30, "c", 97, 1, value="{broken")]
    batch = spark.createDataFrame(records, changelog.SCHEMA)
    store, calls = VersionedStore(spark, str(tmp_path / "r"), buckets=4), []
    from pyspark.sql.classic.dataframe import DataFrame

    write = DataFrame.write

    def failing(self):
        calls.append(1)
        if len(calls) == fails_at:
            raise OSError("crash")
        return write.fget(self)

    monkeypatch.setattr(DataFrame, "write", property(failing))
    if fails_at == 5:
        monkeypatch.setattr(store, "_path", lambda p, real=store._path: (_ for _ in ()).throw(OSError("crash")) if p.endswith(".tmp") else real(p))
    with pytest.raises(OSError, match="crash"):
        stream.apply_batch(batch, 0, store, SPEC)
    monkeypatch.undo()
    assert store.version() == 0
    assert store.read("letters") is None
    totals = stream.apply_batch(batch, 0, store, SPEC)
    assert (totals["records"], totals["dead_lettered"]) == (31, 1)
    assert {r.id: (r.owner, r.version) for r in store.read("data").collect()} == model(records[:30])
    assert store.read("letters").count() == 1


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "r"), buckets=16)
    first = [record(i, "c", i + 1, 1) for i in range(40)]
    stream.apply_batch(spark.createDataFrame(first, changelog.SCHEMA), 0, store, SPEC)
    before = store.manifest()["paths"]["data"]
    stream.apply_batch(spark.createDataFrame([record(40, "u", 7, 2, "new"), record(41, "d", 8, 2)], changelog.SCHEMA), 1, store, SPEC)
    after = store.manifest()["paths"]["data"]
    assert 1 <= sum(before[b] != after.get(b) for b in before) <= 2
    rows = {r.id: r.owner for r in store.read("data").collect()}
    assert rows == {i: "new" if i == 7 else "x" for i in range(1, 41) if i != 8}


def test_positions_below_a_row_s_own_are_refused(spark, tmp_path):
    """Two logs of one table: the later one has older positions, which don't undo what is there."""
    store = VersionedStore(spark, str(tmp_path / "r"), buckets=2)
    spec = TableSpec("accounts", "id", SCHEMA)
    other = lambda r, partition: (r[0], partition, *r[2:])
    stream.apply_batch(spark.createDataFrame([record(9, "u", 1, 5, "newest"), record(10, "d", 2)], changelog.SCHEMA), 0, store, spec)
    totals = stream.apply_batch(spark.createDataFrame([other(record(3, "u", 1, 4, "older"), 1), other(record(4, "u", 2, 4, "back"), 1), other(record(5, "c", 3, 1, "own"), 1)], changelog.SCHEMA), 1, store, spec)
    assert totals["applied"] == 1
    assert {r.id: r.owner for r in store.read("data").collect()} == {1: "newest", 3: "own"}


def placed(seed, n):
    """Changes of few rows whose positions come out of order, or lack; versions that restart."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        rec = list(record(i, r.choice("cuuuurd"), r.randint(1, 6), r.choice([None, *range(12)]), f"o{i}"))
        body = json.loads(rec[4])
        body["source"]["lsn"] = r.choice([None, *[r.randint(1, 2 * n)] * 3])
        rec[4] = json.dumps(body)
        out.append(tuple(rec))
    return out


def placed_model(records, by_position):
    """One change at a time: a position below the row's own is refused, whatever the row; versions guard what has none, or all."""
    rows, state = {}, {}
    for rec in records:
        e = json.loads(rec[4])
        image, lsn = e["after"] or e["before"], e["source"]["lsn"]
        key, version = json.loads(rec[3])["id"], image["version"] if image else None
        if lsn is not None and state.get(key) is not None and state[key] > lsn:
            continue
        if lsn is not None:
            state[key] = lsn
        held = rows[key]["version"] if key in rows else None
        stale = held is not None and (version not in (None, 0) and held > version if e["op"] == "d" else version is None or held > version)
        if stale and not (by_position and lsn is not None):
            continue
        rows.pop(key, None)
        if e["op"] != "d":
            rows[key] = image
    return {k: (v["owner"], v["version"]) for k, v in rows.items()}, state


@pytest.mark.parametrize(("seed", "by_position"), [(1, True), (2, True), (3, False)])
def test_positions_out_of_order_within_a_batch(spark, tmp_path, seed, by_position):
    spec = TableSpec("accounts", "id", SCHEMA, version_col="version", by_position=by_position)
    store, records = VersionedStore(spark, str(tmp_path / "r"), buckets=2), placed(seed, 60)
    for i, (lo, hi) in enumerate([(0, 25), (25, 27), (27, 60)]):
        stream.apply_batch(spark.createDataFrame(records[lo:hi], changelog.SCHEMA).repartition(3), i, store, spec)
    rows, state = placed_model(records, by_position)
    assert {r.id: (r.owner, r.version) for r in store.read("data").collect()} == rows
    assert {int(r.row_key): r.lsn for r in store.read("state").collect() if r.lsn is not None} == state


def test_the_older_of_two_positions_in_a_batch_loses(spark, tmp_path):
    store, batch = VersionedStore(spark, str(tmp_path / "r"), buckets=2), []
    for offset, lsn, owner in ((0, 200, "newer"), (1, 100, "older")):
        batch.append(record(offset, "u", 1, value=json.dumps({"op": "u", "after": {"id": 1, "owner": owner}, "source": {"table": "accounts", "lsn": lsn}})))
    stream.apply_batch(spark.createDataFrame(batch, changelog.SCHEMA), 0, store, TableSpec("accounts", "id", SCHEMA))
    assert [(r.owner,) for r in store.read("data").collect()] == [("newer",)]
    assert [(r.lsn,) for r in store.read("state").collect()] == [(200,)]


def test_offsets_that_start_anew_stop_the_stream(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "r"), buckets=2)
    stream.apply_batch(spark.createDataFrame(history(1, 20), changelog.SCHEMA), 0, store, SPEC)
    with pytest.raises(stream.OffsetRegression):
        stream.apply_batch(spark.createDataFrame([record(2, "c", 1, 1, at=5000)], changelog.SCHEMA), 1, store, SPEC)
    assert store.version() == 1


def test_schema_change_in_the_stream(spark, tmp_path):
    """An unknown column is ignored and a missing one null; a table that lacks a column of the spec stalls until it has it."""
    from millrace.operators import schema

    store = VersionedStore(spark, str(tmp_path / "r"), buckets=2)
    stream.apply_batch(spark.createDataFrame([record(0, "c", 1, 1)], changelog.SCHEMA), 0, store, SPEC)
    wider = TableSpec("accounts", "id", StructType([*SCHEMA.fields, StructField("city", StringType())]), version_col="version")
    value = json.dumps({"op": "c", "after": {"id": 2, "owner": "y", "version": 1, "city": "Bern", "unknown": [1]}})
    batch = spark.createDataFrame([record(1, "c", 2, value=value), record(2, "c", 3, 1)], changelog.SCHEMA)
    with pytest.raises(stream.TargetBehind, match="city"):
        stream.apply_batch(batch, 1, store, wider)
    assert cdc.missing_columns(wider, store.read("data")) == ["city"]
    store.commit({"data": schema.align(store.read("data", SCHEMA), wider.schema)}, 0, {"data": ("id", [0, 1])})
    stream.apply_batch(batch, 1, store, wider)
    assert {r.id: r.city for r in store.read("data").collect()} == {1: None, 2: "Bern", 3: None}


def test_snapshot_then_changes_in_one_pass(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "r"), buckets=2)
    batch = [*(record(i, "r", i + 1, 1, "snap") for i in range(5)), record(5, "u", 2, 2, "live"), record(6, "d", 3, 1), record(7, "c", 9, 1, "live")]
    log = spark.createDataFrame(batch, changelog.SCHEMA)
    stream.apply_batch(log, 0, store, SPEC)
    assert {r.id: r.owner for r in store.read("data").collect()} == {1: "snap", 2: "live", 4: "snap", 5: "snap", 9: "live"}
    events = cdc.feed(cdc.classify(log, SPEC).where("kind = 'change'"), spark.createDataFrame([], SCHEMA), SPEC).collect()
    assert sorted((r.offset, r.event) for r in events) == [(5, "updated"), (6, "deleted"), (7, "created")]


def test_second_writer_loses(spark, tmp_path):
    """Two writers with different rows: the manifest that was first stays, with its own rows."""
    store = VersionedStore(spark, str(tmp_path / "s"))
    base = store.manifest()
    store.commit({"data": spark.range(3)}, 0, base=base)
    with pytest.raises(Conflict):
        VersionedStore(spark, str(tmp_path / "s")).commit({"data": spark.range(100, 107)}, 1, base=base)
    assert sorted(r.id for r in store.read("data").collect()) == [0, 1, 2]
    assert store.manifest()["batch"] == 0


def test_gaps_across_ranges(spark):
    offsets = [0, 1, 2, 5, 9, 10, 31, 32, 70]
    log = spark.createDataFrame([("t", p, o) for p in (0, 1) for o in offsets if (o + p) % 3], "topic string, partition int, offset long")
    for span in (10, 100):
        got = {(r.partition, r.after, r.before, r.missing) for r in changelog.gaps(log, span).collect()}
        own = {p: [o for o in offsets if (o + p) % 3] for p in (0, 1)}
        assert got == {(p, a, b, b - a - 1) for p in own for a, b in zip(own[p], own[p][1:]) if b - a > 1}


def test_attempts_and_quarantine(spark, tmp_path):
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "done"

    assert stream.attempted(flaky, sleep=waits.append) == "done"
    assert waits == [0.2, 0.4]
    with pytest.raises(ZeroDivisionError):
        stream.attempted(lambda: 1 / 0, sleep=waits.append)

    def handler(r):
        if r["offset"] % 4 == 1:
            raise ValueError(f"a secret of {r['key']}")

    parked = stream.deliver(spark.createDataFrame(history(2, 12), changelog.SCHEMA), handler, "g", first_wait=0.001)
    got = parked.select("offset", "topic", changelog.header("dlq.reason").alias("reason"), changelog.header("dlq.attempts").alias("attempts")).orderBy("offset").collect()
    assert [tuple(r) for r in got] == [(i, "bank.public.accounts.dlq", "ValueError", "3") for i in (1, 5, 9)]


def test_token_bucket_against_a_loop(spark):
    r = random.Random(5)
    events = [(i, r.randint(1, 4), datetime(2024, 1, 1) + timedelta(seconds=r.randint(0, 400))) for i in range(200)]
    got = {x.i: x.allowed for x in rates.token_bucket(spark.createDataFrame(events, "i long, k long, at timestamp_ntz"), "k", "at", "i", 0.1, 2, 60).collect()}
    want, held = {}, {}
    for i, k, at in sorted(events, key=lambda e: (e[1], e[2], e[0])):
        tokens, last = held.get(k, (2.0, at))
        gap = (at - last).total_seconds()
        tokens = 2.0 if gap >= 60 else min(2.0, tokens + gap * 0.1)
        want[i] = tokens >= 1
        held[k] = (tokens - want[i], at)
    assert got == want
