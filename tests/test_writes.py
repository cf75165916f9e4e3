import random

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from millrace import queries
from millrace.functions import rates, text
from millrace.operators import ledger, relations, schema, writes
from millrace.plans.spec import TableSpec
from millrace.sources import files

SPEC = TableSpec("items", "id", checks={"positive": "n > 0"})


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, 5, "a"), (2, 7, None), (3, None, "c")], "id long, n int, name string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_insert(spark, items):
    new = spark.createDataFrame([(4, 1, "x"), (2, 1, "x"), (5, -1, "x"), (6, 1, "x"), (6, 2, "x"), (None, 1, "x")], "id long, n int, extra string")
    every, inserted, refused = writes.insert(items, new, SPEC)
    assert rows(inserted) == [(4, 1, None)]
    assert len(rows(every)) == 4
    assert sorted((r.id or 0, r.reason) for r in refused.collect()) == [(0, "no key"), (2, "key is stored"), (5, "checks: positive"), (6, "key stands twice"), (6, "key stands twice")]


def test_update_increment_delete(spark, items):
    new = spark.createDataFrame([(1, None), (9, "new"), (2, "a"), (2, "b")], "id long, name string")
    assert rows(writes.update(items, new, SPEC)) == [(1, 5, None), (2, 7, "b"), (3, None, "c")]
    deltas = spark.createDataFrame([(1, 2), (1, 3), (3, 4), (9, 1)], "id long, d int")
    assert rows(writes.increment(items, deltas, SPEC, "n")) == [(1, 10, "a"), (2, 7, None), (3, 4, "c")]
    with pytest.raises(TypeError):
        writes.increment(items, deltas.withColumn("d", F.col("d") * 0.5), SPEC, "n")
    assert rows(writes.delete(items, spark.createDataFrame([(1,), (8,)], "x long"), SPEC)) == [(2, 7, None), (3, None, "c")]
    with pytest.raises(writes.NoneDeleted):
        writes.delete(items, spark.createDataFrame([(8,)], "x long"), SPEC, must=True)


def test_backfill_stops_and_goes_on(spark):
    df = spark.range(100).select("id", F.when(F.col("id") % 2 == 0, "done").alias("s"))
    half, report = writes.backfill(df, TableSpec("t", "id"), "s", F.lit("done"), size=10, hi=50)
    assert rows(report) == [(i, i + 10, 5) for i in range(0, 50, 10)]
    whole, report = writes.backfill(half, TableSpec("t", "id"), "s", F.lit("done"), size=25)
    assert rows(report) == sorted([(0, 25, 0), (25, 50, 0), (50, 75, 13 - 1), (75, 100, 13)], key=repr)
    assert whole.where("s is null").isEmpty()


def test_transfers_against_a_loop(spark):
    rng = random.Random(3)
    accounts = {i: (rng.randint(0, 500), rng.random() > 0.2) for i in range(12)}
    asked = [(i, rng.randrange(13), rng.randrange(13), rng.randint(-20, 200)) for i in range(150)]
    want, after = {}, {a: b for a, (b, _) in accounts.items()}
    for i, d, c, n in asked:
        if n <= 0:
            want[i] = "not positive"
        elif d == c:
            want[i] = "self"
        elif d not in accounts or c not in accounts:
            want[i] = "unknown"
        elif not (accounts[d][1] and accounts[c][1]):
            want[i] = "inactive"
        else:
            want[i] = "insufficient" if n > after[d] else "posted"
            if want[i] == "posted":
                after[d], after[c] = after[d] - n, after[c] + n
    judged, legs, balances = ledger.post(spark.createDataFrame(asked, "id long, debit long, credit long, cents long"), spark.createDataFrame([(a, b, x) for a, (b, x) in accounts.items()], "account long, balance long, active boolean"))
    assert {r.id: r.verdict for r in judged.collect()} == want
    assert legs.agg(F.sum("cents")).first()[0] == 0
    assert {r.account: r.balance for r in balances.collect()} == after


OLD = StructType([StructField("id", IntegerType()), StructField("label", StringType()), StructField("price", DoubleType()), StructField("gone", LongType()), StructField("also", LongType())])
NEW = StructType([StructField("id", LongType()), StructField("title", StringType()), StructField("price", IntegerType()), StructField("added", DoubleType())])


def test_schema_diff_and_align(spark):
    changes = {(c.kind, c.column): c for c in schema.diff(OLD, NEW)}
    assert set(changes) == {("renamed", "title"), ("added", "added"), ("dropped", "gone"), ("dropped", "also"), ("changed", "id"), ("changed", "price")}
    assert changes["renamed", "title"].old == "label"
    assert [k for k, c in changes.items() if c.destructive] == [("dropped", "gone"), ("dropped", "also"), ("changed", "price")]
    df = spark.createDataFrame([(1, "x", 2.0, 3, 4)], OLD)
    with pytest.raises(schema.Destructive):
        schema.align(df, NEW)
    out = schema.align(df, NEW, destructive=True)
    assert out.schema == NEW
    assert rows(out) == [(1, "x", 2, None)]
    assert schema.drift(df, df).count() == 0
    assert {r.column: r.n_values for r in schema.drift(out, df).collect()} == {"title": 1, "added": 0, "gone": 1, "also": 1, "id": 1, "price": 1}


def test_ancestry_with_a_cycle(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (3, 2, "c"), (4, 5, "d"), (5, 4, "e"), (6, 77, "f")], "k long, up long, name string")
    got = {r.k: (r.parent_name, r.root, r.depth) for r in relations.ancestry(df, "k", "up", "name").collect()}
    assert got == {1: (None, 1, 0), 2: ("a", 1, 1), 3: ("b", 1, 2), 4: ("e", None, None), 5: ("d", None, None), 6: (None, None, None)}


def test_ancestry_of_a_deep_chain(spark):
    df = spark.createDataFrame([(k, k - 1 if k else None, f"n{k}") for k in range(70)], "k long, up long, name string")
    spark.sparkContext.setJobGroup("deep", "one job or more for each round")
    out = relations.ancestry(df, "k", "up", "name")
    spark.sparkContext.setJobGroup("", "")
    assert {r.k: (r.parent_name, r.root, r.depth) for r in out.collect()} == {k: (f"n{k - 1}" if k else None, 0, k) for k in range(70)}
    assert 0 < len(spark.sparkContext.statusTracker().getJobIdsForGroup("deep")) < 70


def test_ancestry_has_a_row_for_each_chain(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, None, "A"), (2, 1, "b"), (3, 2, "c"), (3, 2, "C"), (3, 9, "x"), (4, 3, "d"), (8, 8, "h"), (8, 8, "H")], "k long, up long, name string")
    above = {1: [], 2: ["a", "A"], 3: ["b", "b"], 4: ["c", "c", "C", "C"]}
    want = [(k, name, up, 1, depth) for k, name, depth in ((2, "b", 1), (3, "c", 2), (3, "C", 2), (4, "d", 3)) for up in above[k]]
    want += [(1, "a", None, 1, 0), (1, "A", None, 1, 0), (3, "x", None, None, None), (4, "d", "x", None, None), *[(8, a, b, None, None) for a in "hH" for b in "hH"]]
    assert sorted(map(tuple, relations.ancestry(df, "k", "up", "name").collect()), key=repr) == sorted(want, key=repr)


def test_sub_accounts_as_the_sql(spark, tmp_path):
    keys = [0, 1, 2, 3, 3, 6, 7, 12, 40, 80, None, -4, *[((1 << 60) - 1) >> i for i in range(60)]]
    spark.createDataFrame([(k, f"s{i}") for i, k in enumerate(keys)], "s_suppkey long, s_name string").write.parquet(str(tmp_path / "supplier.parquet"))
    want = duckdb.sql(queries.SQL["sub_accounts"].replace("FROM supplier", f"FROM '{tmp_path}/supplier.parquet/*.parquet'")).fetchall()
    assert sorted(map(tuple, queries.sub_accounts(spark, str(tmp_path)).collect()), key=repr) == sorted(want, key=repr)
    assert max(r[2] for r in want) == 59


def test_in_sync(spark, items):
    assert tuple(relations.in_sync("id", ["n", "name"], items, items.repartition(3)).first()) == (3, 3, 0, 0, 0, True)
    other = spark.createDataFrame([(1, 5, "b"), (2, 7, None), (9, 1, "c")], items.schema)
    assert tuple(relations.in_sync("id", ["n", "name"], items, other).first()) == (3, 3, 1, 1, 1, False)


def test_csv_and_years(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "quoted", text\nof two lines', "2023-05-06 00:00:00"), (2, None, "2024-01-01 00:00:00"), (3, "", None)], "id long, t string, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    files.write_csv(df, str(tmp_path / "c"), {"key": "id", "t": "t"})
    assert rows(files.read_csv(spark, str(tmp_path / "c"), "key long, t string")) == rows(df.select("id", "t"))
    files.write_by_year(df, "ts", str(tmp_path / "y"))
    read = files.read_years(spark, str(tmp_path / "y"), 2024)
    assert [r.id for r in read.collect()] == [2]
    assert "PartitionFilters: [isnotnull(_year" in read._jdf.queryExecution().executedPlan().toString() or "PartitionFilters: [" in read._jdf.queryExecution().toString()


@pytest.mark.parametrize(("given", "n", "want"), [("ab\ufffdcdefgh", 5, "ab\ufffd..."), ("héllo", 2, "h..."), ("héllo", 3, "hé..."), ("日本語", 7, "日本..."), ("🎈🎈", 7, "🎈..."), ("short", 5, "short"), ("", 3, ""), (None, 3, None)])
def test_truncate(spark, given, n, want):
    assert spark.createDataFrame([(given,)], "t string").select(text.truncate(F.col("t"), n)).first()[0] == want


def test_truncate_drops_only_invalid_bytes(spark):
    df = spark.createDataFrame([(b"a\xffb\xef\xbf\xbdc\xc3",)], "b binary").select(F.col("b").cast("string").alias("t"))
    assert df.select(text.truncate(F.col("t"), 100)).first()[0] == "ab\ufffdc"
    assert df.select(text.label(F.lit("a\x01b" + "é" * 100), 128)).first()[0] == "ab" + "é" * 63


def test_split_list_as_the_sql(spark, tmp_path):
    texts = ["0997 | x, 12", "4072374829496490", " first , second", "0", ",1,,2 ,", "a, ,b", "00,11,22", "\t tab\n,x", "\u00a0 , 1", "", " ", ",", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = duckdb.sql(queries.SQL["split_list"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")).fetchall()
    assert sorted(map(tuple, queries.split_list(spark, str(tmp_path)).collect())) == sorted(want)
    assert spark.createDataFrame([(" 0a0, 1b1 ,,  2 ",)], "t string").select(text.split_list(F.col("t"))).first()[0] == ["0a0", "1b1", "2"]


def test_unique_within_a_time(spark, tmp_path):
    """Streaming: of jobs with one key, the first within the time is kept; later ones are let through again by watermark."""
    rows_ = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:20"), ("b", "2024-01-01 00:00:30")]
    spark.createDataFrame(rows_, "k string, at string").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema("k string, at timestamp").parquet(str(tmp_path / "in"))
    rates.first_within(events, "k", "at", 60).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]
