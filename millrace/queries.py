"""Named queries over the given tables, each with the SQL that says the same where SQL can."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from millrace.functions import rates, text
from millrace.operators import cdc, dates, ledger, paging, relations, search, writes
from millrace.operators import filters as flt
from millrace.operators import schema as schemas
from millrace.plans.spec import Relation, TableSpec
from millrace.sources import changelog, files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

ORDERS = TableSpec("orders", "o_orderkey", default_sort=(("o_orderdate", "desc"),), relations=(Relation("customer", "customer", "o_custkey", "c_custkey"), Relation("lines", "lineitem", "o_orderkey", "l_orderkey", many=True)))
CUSTOMER = TableSpec("customer", "c_custkey", default_sort=(("c_acctbal", "desc"),), relations=(Relation("nation", "nation", "c_nationkey", "n_nationkey"),))
NATION = TableSpec("nation", "n_nationkey", default_sort=(("n_name", "asc"),), relations=(Relation("region", "region", "n_regionkey", "r_regionkey"),))
EVENTS = TableSpec("events", "event_id", default_sort=(("ts", "desc"),))
PART = TableSpec("part", "p_partkey", default_sort=(("p_name", "asc"),))
DOCUMENTS = TableSpec("documents", "doc_id", default_sort=(("doc_id", "asc"),))
SPECS = {s.name: s for s in (ORDERS, CUSTOMER, NATION, EVENTS, PART, DOCUMENTS)}
REPLICA = TableSpec("users", "id", StructType([StructField("id", LongType()), StructField("event_type", StringType()), StructField("version", LongType())]), version_col="version", checks={"not_signup_13": "not (event_type = 'signup' and version % 13 = 0)"})


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def stamp(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def term(field: str, mode: str, value: object = None, **more: object) -> dict:
    return {"field": field, "mode": mode, "value": value, **more}


def filtered(name: str, terms: list[dict], columns: list[str], sql: str, logic: str = "AND", **more: object) -> None:
    """Registers a filter over a table with its key and some columns."""

    def run(spark: SparkSession, sf: str, of: str = name.split(":")[1]) -> DataFrame:
        df = t(spark, sf, of)
        return flt.apply(df, SPECS[of], {"filters": terms, "logic": logic, **more}).select(*columns)

    QUERIES[name.split(":")[0]] = lambda spark, sf: run(spark, sf)
    SQL[name.split(":")[0]] = f"SELECT {', '.join(columns)} FROM {name.split(':')[1]} WHERE {sql}"


O, C, E = ["o_orderkey", "o_orderstatus"], ["c_custkey", "c_name"], ["event_id", "event_type"]
filtered("filter_equal:orders", [term("o_orderstatus", "equal", "F")], O, "o_orderstatus = 'F'")
filtered("filter_not_equal:orders", [term("o_orderstatus", "notEqual", "F")], O, "o_orderstatus <> 'F'")
filtered("filter_compare:orders", [term("o_totalprice", "gte", 100000.0), term("o_totalprice", "lt", 200000.0)], O, "o_totalprice >= 100000 AND o_totalprice < 200000")
filtered("filter_before_after:orders", [term("o_orderkey", "after", 100), term("o_orderkey", "before", 5000)], O, "o_orderkey > 100 AND o_orderkey < 5000")
filtered("filter_contains:part", [term("p_name", "contains", "e"), term("p_type", "notContains", "100%")], ["p_partkey", "p_name"], "contains(p_name, 'e') AND NOT contains(p_type, '100%')")
filtered("filter_starts_ends:customer", [term("c_name", "startsWith", "Customer"), term("c_name", "endsWith", "7")], C, "starts_with(c_name, 'Customer') AND ends_with(c_name, '7')")
filtered("filter_inside:customer", [term("c_nationkey", "inside", [1, 3, 7])], C, "c_nationkey IN (1, 3, 7)")
filtered("filter_outside:customer", [term("c_nationkey", "outside", [1, 3, 7])], C, "c_nationkey NOT IN (1, 3, 7)")
filtered("filter_range:orders", [term("o_totalprice", "range", {"from": 50000.0, "to": 60000.0})], O, "o_totalprice BETWEEN 50000 AND 60000")
filtered("filter_empty:documents", [term("lang", "isNotEmpty"), term("text", "isNotEmpty")], ["doc_id", "lang"], "lang IS NOT NULL AND lang <> '' AND text IS NOT NULL AND text <> ''")
filtered("search_field:documents", [term("text", "search", "license version")], ["doc_id", "source"], "list_has_any(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), ['license', 'version'])")
filtered("filter_logic:orders", [term("o_orderstatus", "equal", "O"), term("o_totalprice", "gt", 250000.0)], O, "o_orderstatus = 'O' OR o_totalprice > 250000", logic="OR")
filtered("date_equal_day:orders", [term("o_orderdate", "equal", "1997-03-10", dataType="date", timezone="America/New_York")], O, "o_orderdate >= TIMESTAMP '1997-03-10 05:00:00' AND o_orderdate < TIMESTAMP '1997-03-11 05:00:00'")
filtered("date_compare_day:events", [term("ts", "gt", "2024-01-10", dataType="date"), term("ts", "lte", "01/12/2024", dataType="date", timezone="Asia/Manila")], E, "ts >= TIMESTAMP '2024-01-11 00:00:00' AND ts < TIMESTAMP '2024-01-12 16:00:00'", timezone="UTC")
filtered("date_instant:events", [term("ts", "gte", "2024-01-10T08:30:00.0000001Z", dataType="date"), term("ts", "before", "2024-01-10 20:00:00+08:00", dataType="date")], E, "ts > TIMESTAMP '2024-01-10 08:30:00' AND ts < TIMESTAMP '2024-01-10 12:00:00'")
filtered("date_range:orders", [term("o_orderdate", "range", {"from": "1997-01-01", "to": "1997-03-31"}, dataType="date")], O, "o_orderdate >= TIMESTAMP '1996-12-31 16:00:00' AND o_orderdate < TIMESTAMP '1997-03-31 16:00:00'", timezone="Asia/Manila")
filtered("date_inside:events", [term("ts", "inside", ["2024-01-05", "2024-01-07"], dataType="date"), term("ts", "outside", ["07.01.2024"], dataType="date")], E, "ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-06'")
filtered("date_zone_precedence:events", [term("ts", "lt", "2024-01-02 00:00:00-05:00", dataType="date", timezone="Asia/Manila")], E, "ts < TIMESTAMP '2024-01-02 05:00:00'", timezone="Europe/Paris")
filtered("time_of_day:events", [term("ts", "gte", "22:30", dataType="time", timezone="+08:00")], E, "strftime(ts + INTERVAL 8 HOUR, '%H:%M:%S') >= '22:30:00'")
filtered("time_range:events", [term("ts", "range", ["09:00", "10:15:30"], dataType="time")], E, "CAST(ts AS TIME) BETWEEN TIME '09:00:00' AND TIME '10:15:30'")
filtered("filter_json_key:events", [{"mode": "custom", "value": "k", "custom": lambda df, k: F.get_json_object("props", f"$.{k}").try_cast("int") >= 50}], E, "TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) >= 50")


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey IN (1, 2) AND c_mktsegment = 'BUILDING'")
def filter_scoped(spark: SparkSession, sf: str) -> DataFrame:
    scope = {"filters": [term("c_nationkey", "inside", [1, 2])]}
    return flt.apply(t(spark, sf, "customer"), CUSTOMER, scope, {"filters": [term("c_mktsegment", "equal", "BUILDING"), term("noSuchField", "equal", 1)], "logic": "AND"}).select(*C)


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0")
def filter_from_request(spark: SparkSession, sf: str) -> DataFrame:
    request = flt.from_request({"filter": "eyJmaWx0ZXJzIjpbeyJmaWVsZCI6ImNfYWNjdGJhbCIsIm1vZGUiOiJndCIsInZhbHVlIjowfV19"})
    return flt.apply(t(spark, sf, "customer"), CUSTOMER, None, request).select(*C)


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE CAST(o_orderdate AS DATE) > DATE '1998-01-31'")
def date_column(spark: SparkSession, sf: str) -> DataFrame:
    d = t(spark, sf, "orders").withColumn("o_orderdate", F.to_date("o_orderdate"))
    return flt.apply(d, ORDERS, {"filters": [term("o_orderdate", "gt", "31.1.1998", dataType="date")]}).select(*O)


@query("SELECT CAST(day AS VARCHAR) AS day, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT CAST(ts + INTERVAL 8 HOUR AS DATE) AS day, value FROM events) GROUP BY 1")
def daily_totals_zone(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "events").groupBy(dates.day_in(F.col("ts"), "Asia/Manila").cast("string").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def parse_date_column(spark: SparkSession, sf: str) -> DataFrame:
    d = t(spark, sf, "orders").withColumn("raw", F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy/MM/dd")).otherwise(F.date_format("o_orderdate", "d.M.yyyy")))
    return d.select("o_orderkey", dates.parse_date_column(F.col("raw")).cast("string").alias("day"))


PAGE_SQL = "SELECT o_orderkey, o_totalprice FROM orders {} ORDER BY {} LIMIT {}"
FLAGSHIP = {
    "filters": [term("o_orderstatus", "equal", "F"), term("o_orderdate", "range", {"from": "1997-01-01", "to": "1997-03-31"}, dataType="date", timezone="Asia/Manila")],
    "sortFields": [{"field": "o_totalprice", "order": "desc"}],
}


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    request = FLAGSHIP | {"filters": FLAGSHIP["filters"][1:]}
    return paging.paginate(t(spark, sf, "orders"), ORDERS, request, 25).rows.select("o_orderkey", "o_orderstatus", "o_totalprice", stamp("o_orderdate").alias("o_orderdate"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1996-12-31 16:00:00' AND o_orderdate < TIMESTAMP '1997-03-31 16:00:00' AND o_orderstatus = 'F' ORDER BY o_totalprice DESC NULLS LAST, o_orderkey DESC LIMIT 25")
def page_first(spark: SparkSession, sf: str) -> DataFrame:
    return paging.paginate(t(spark, sf, "orders"), ORDERS, FLAGSHIP, 25).rows.select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 150000 ORDER BY o_totalprice, o_orderkey DESC LIMIT 20 OFFSET 20")
def page_keyset(spark: SparkSession, sf: str) -> DataFrame:
    request = {"filters": [term("o_totalprice", "gt", 150000.0)], "sortFields": [{"field": "o_totalprice", "order": "asc"}]}
    first = paging.paginate(t(spark, sf, "orders"), ORDERS, request, 20)
    return paging.paginate(t(spark, sf, "orders"), ORDERS, request, 20, first.next).rows.select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, status FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS status, o_custkey FROM orders) ORDER BY status DESC NULLS LAST, o_custkey ASC NULLS LAST, o_orderkey DESC LIMIT 50 OFFSET 50")
def page_keyset_mixed(spark: SparkSession, sf: str) -> DataFrame:
    d = t(spark, sf, "orders").withColumn("status", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")))
    request = {"sortFields": [{"field": "status", "order": "desc"}, {"field": "o_custkey", "order": "asc"}]}
    first = paging.paginate(d, ORDERS, request, 50)
    return paging.paginate(d, ORDERS, request, 50, first.next).rows.select("o_orderkey", "status")


@query(PAGE_SQL.format("", "o_totalprice DESC, o_orderkey DESC", 20))
def page_backward(spark: SparkSession, sf: str) -> DataFrame:
    d, request = t(spark, sf, "orders"), {"sortFields": [{"field": "o_totalprice", "order": "desc"}]}
    second = paging.paginate(d, ORDERS, request, 20, paging.paginate(d, ORDERS, request, 20).next)
    return paging.paginate(d, ORDERS, request, 20, second.previous).rows.select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, row_number() OVER w AS row_number, (row_number() OVER w - 1) // 100 + 1 AS page FROM orders WINDOW w AS (ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC)")
def page_numbers(spark: SparkSession, sf: str) -> DataFrame:
    d = t(spark, sf, "orders")
    return paging.page_numbers(d, paging.total_order(d, ORDERS), 100).select("o_orderkey", "row_number", "page")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' ORDER BY o_totalprice DESC NULLS LAST, o_orderkey DESC LIMIT 30")
def find_many(spark: SparkSession, sf: str) -> DataFrame:
    return paging.find(t(spark, sf, "orders"), ORDERS, {"filters": [term("o_orderstatus", "equal", "P")], "sortFields": [{"field": "o_totalprice", "order": "desc"}]}).select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey DESC LIMIT 1")
def find_one(spark: SparkSession, sf: str) -> DataFrame:
    return paging.find(t(spark, sf, "customer"), CUSTOMER, limit=1).select(*C)


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey = 7")
def get_by_id(spark: SparkSession, sf: str) -> DataFrame:
    return paging.get_by_id(t(spark, sf, "orders"), ORDERS, 7).select(*O)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey DESC LIMIT 1")
def row_at_max(spark: SparkSession, sf: str) -> DataFrame:
    return paging.row_at_extreme(t(spark, sf, "orders"), ORDERS, "o_totalprice").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice ASC NULLS LAST, o_orderkey DESC LIMIT 1")
def row_at_min(spark: SparkSession, sf: str) -> DataFrame:
    return paging.row_at_extreme(t(spark, sf, "orders"), ORDERS, "o_totalprice", largest=False).select("o_orderkey", "o_totalprice")


@query("SELECT o_custkey, o_orderkey, rn FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn <= 5")
def statement_top_n(spark: SparkSession, sf: str) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    return t(spark, sf, "orders").withColumn("rn", rank.cast("bigint")).where("rn <= 5").select("o_custkey", "o_orderkey", "rn")


@query("SELECT user_id, event_id, rank, from_end FROM (SELECT user_id, event_id, row_number() OVER w - 1 AS rank, row_number() OVER w - 1 - count(*) OVER (PARTITION BY user_id) AS from_end FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value, event_id)) WHERE rank < 3 OR from_end >= -3")
def ranked_range(spark: SparkSession, sf: str) -> DataFrame:
    return rates.ranked(t(spark, sf, "events"), "user_id", "value", "event_id").where("rank < 3 or from_end >= -3").select("user_id", "event_id", "rank", "from_end")


@query("SELECT count(*) AS n FROM orders WHERE o_totalprice > 100000")
def count_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return paging.count(t(spark, sf, "orders"), ORDERS, {"filters": [term("o_totalprice", "gt", 100000.0)]})


@query("SELECT count(*) > 0 AS found FROM orders WHERE o_totalprice > 100000")
def exists_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return paging.exists(t(spark, sf, "orders"), ORDERS, {"filters": [term("o_totalprice", "gt", 100000.0)]})


@query("SELECT count(*) AS n_rows, count(*) AS n_counted, count(*) > 0 AS found FROM orders WHERE o_orderstatus = 'P'")
def readers_agree(spark: SparkSession, sf: str) -> DataFrame:
    d, r = t(spark, sf, "orders"), {"filters": [term("o_orderstatus", "equal", "P")]}
    rows = flt.apply(d, ORDERS, r).select("o_orderkey").agg(F.countDistinct("o_orderkey").alias("n_rows"))
    return rows.crossJoin(paging.count(d, ORDERS, r).withColumnRenamed("n", "n_counted")).crossJoin(paging.exists(d, ORDERS, r))  # one row each


@query("SELECT o_orderkey, c_name, c_nationkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def preload_one(spark: SparkSession, sf: str) -> DataFrame:
    return relations.preload(t(spark, sf, "orders"), ORDERS.relations[0], t(spark, sf, "customer")).select("o_orderkey", F.col("customer.c_name").alias("c_name"), F.col("customer.c_nationkey").alias("c_nationkey"))


@query("SELECT o_orderkey, count(l_orderkey) AS n_lines, coalesce(sum(l_linenumber), 0) AS numbers FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def preload_many(spark: SparkSession, sf: str) -> DataFrame:
    d = relations.preload(t(spark, sf, "orders").select("o_orderkey"), ORDERS.relations[1], t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"))
    return d.select("o_orderkey", F.size("lines").cast("bigint").alias("n_lines"), F.aggregate("lines", F.lit(0).cast("bigint"), lambda a, x: a + x["l_linenumber"]).alias("numbers"))


@query("SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def preload_nested(spark: SparkSession, sf: str) -> DataFrame:
    d = relations.preload_paths(t(spark, sf, "customer"), CUSTOMER, ["nation.region", "no_such"], lambda n: t(spark, sf, n), SPECS)
    return d.select("c_custkey", F.col("nation.n_name").alias("n_name"), F.col("nation.region.r_name").alias("r_name"))


@query("SELECT c_custkey, c_name, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey")
def customer_accounts(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "customer").join(t(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "c_name", "o_orderkey")


LEDGER_SQL = "SELECT o_orderkey, round(o_totalprice, 2) AS stored, coalesce(round(s, 2), 0) AS posted FROM orders LEFT JOIN (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE AS s FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey"


@query(LEDGER_SQL)
def account_balances(spark: SparkSession, sf: str) -> DataFrame:
    posted = t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("s"))
    return t(spark, sf, "orders").join(posted, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.round("o_totalprice", 2).alias("stored"), F.coalesce(F.round("s", 2), F.lit(0.0)).alias("posted"))


@query("SELECT count(*) AS accounts, count_if(abs(stored - posted) > 0.005) AS differing FROM (" + LEDGER_SQL + ")")
def ledger_rebalance(spark: SparkSession, sf: str) -> DataFrame:
    return account_balances(spark, sf).agg(F.count("*").alias("accounts"), F.count_if(F.abs(F.col("stored") - F.col("posted")) > 0.005).alias("differing"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')")
def orphan_accounts(spark: SparkSession, sf: str) -> DataFrame:
    return relations.orphans(t(spark, sf, "orders"), t(spark, sf, "customer").where("c_mktsegment <> 'BUILDING'"), "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def rows_by_ids(spark: SparkSession, sf: str) -> DataFrame:
    ids = t(spark, sf, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return t(spark, sf, "customer").join(ids, "c_custkey", "left_semi").select(*C)


def _copy(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c = t(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    return c, c.where("c_custkey % 10 <> 0").withColumn("c_nationkey", F.when(F.col("c_custkey") % 7 == 0, -1).otherwise(F.col("c_nationkey")))


COPY = "(SELECT c_custkey, c_name, CASE WHEN c_custkey % 7 = 0 THEN -1 ELSE c_nationkey END AS c_nationkey FROM customer WHERE c_custkey % 10 <> 0)"
ALL3 = "(SELECT c_custkey, c_name, c_nationkey FROM customer)"


@query(f"SELECT 'missing' AS side, * FROM ({ALL3} EXCEPT {COPY}) UNION ALL SELECT 'extra', * FROM ({COPY} EXCEPT {ALL3})")
def reconcile_tables(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _copy(spark, sf)
    same = lambda x, y: reduce(Column.__and__, [x[c].eqNullSafe(y[c]) for c in a.columns])
    return a.join(b, same(a, b), "left_anti").select(F.lit("missing").alias("side"), "*").union(b.join(a, same(b, a), "left_anti").select(F.lit("extra").alias("side"), "*"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'missing' ELSE 'changed' END AS state, CASE WHEN c_custkey % 10 = 0 THEN '' ELSE 'c_nationkey' END AS differs FROM customer WHERE c_custkey % 10 = 0 OR (c_custkey % 7 = 0 AND c_nationkey <> -1)")
def diff_want_have(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _copy(spark, sf)
    return relations.differing("c_custkey", ["c_name", "c_nationkey"], a, b)


@query(f"SELECT (SELECT count(*) FROM {ALL3}) AS n_source, (SELECT count(*) FROM {COPY}) AS n_replica, count_if(state = 'missing') AS missing, count_if(state = 'extra') AS extra, count_if(state = 'changed') AS changed, count(*) = 0 AS in_sync FROM ({SQL['diff_want_have']})")
def sync_diff(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _copy(spark, sf)
    return relations.in_sync("c_custkey", ["c_name", "c_nationkey"], a, b)


@query(f"SELECT * FROM ({ALL3} EXCEPT ALL {COPY})")
def table_except(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _copy(spark, sf)
    return a.exceptAll(b)


@query(f"SELECT * FROM ({ALL3} INTERSECT {COPY})")
def table_intersect(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _copy(spark, sf)
    return a.intersect(b)


@query("WITH RECURSIVE up AS (SELECT s_suppkey, s_name, CAST(NULL AS VARCHAR) AS parent, 0 AS depth, s_suppkey AS root FROM supplier WHERE s_suppkey <= 1 UNION ALL SELECT c.s_suppkey, c.s_name, u.s_name, u.depth + 1, u.root FROM supplier c JOIN up u ON c.s_suppkey > 1 AND c.s_suppkey // 2 = u.s_suppkey) SELECT s_suppkey, parent, CAST(depth AS INTEGER) AS depth, root FROM up")
def sub_accounts(spark: SparkSession, sf: str) -> DataFrame:
    s = t(spark, sf, "supplier").select("s_suppkey", "s_name", F.when(F.col("s_suppkey") > 1, F.expr("s_suppkey div 2")).alias("up"))
    return relations.ancestry(s, "s_suppkey", "up", "s_name").where("root is not null").select("s_suppkey", F.col("parent_name").alias("parent"), "depth", "root")


@query("SELECT l_orderkey, l_linenumber, p_name, s_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey")
def transfer_parties(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "lineitem").join(t(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).join(t(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "l_linenumber", "p_name", "s_name")


def legs(spark: SparkSession, sf: str) -> DataFrame:
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    d = t(spark, sf, "orders")
    return d.select(F.col("o_orderkey").alias("transfer_id"), F.explode(F.array(F.struct((F.col("o_custkey") * 2).alias("account"), (-cents).alias("cents")), F.struct((F.col("o_custkey") * 2 + 1).alias("account"), cents.alias("cents")))).alias("x")).select("transfer_id", "x.account", "x.cents")


LEGS = "(SELECT o_orderkey AS transfer_id, o_custkey * 2 AS account, -CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders UNION ALL SELECT o_orderkey, o_custkey * 2 + 1, CAST(round(o_totalprice * 100) AS BIGINT) FROM orders)"


@query(f"SELECT * FROM {LEGS}")
def transfer_legs(spark: SparkSession, sf: str) -> DataFrame:
    return legs(spark, sf)


@query(f"SELECT transfer_id, count(*) AS n_legs, CAST(sum(cents) AS BIGINT) AS total FROM {LEGS} GROUP BY 1")
def transfer_zero_sum(spark: SparkSession, sf: str) -> DataFrame:
    return legs(spark, sf).groupBy("transfer_id").agg(F.count("*").alias("n_legs"), F.sum("cents").alias("total"))


@query(f"SELECT CAST(sum(CASE WHEN cents > 0 THEN cents END) AS BIGINT) AS credits, CAST(sum(CASE WHEN cents < 0 THEN cents END) AS BIGINT) AS debits, sum(cents) = 0 AS balanced FROM {LEGS}")
def books_balance(spark: SparkSession, sf: str) -> DataFrame:
    return legs(spark, sf).agg(F.sum(F.when(F.col("cents") > 0, F.col("cents"))).alias("credits"), F.sum(F.when(F.col("cents") < 0, F.col("cents"))).alias("debits"), (F.sum("cents") == 0).alias("balanced"))


@query("SELECT count(*) AS n, count(DISTINCT c_name) AS names, count(DISTINCT c_nationkey) AS nations FROM customer")
def distinct_check(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "customer").agg(F.count("*").alias("n"), F.countDistinct("c_name").alias("names"), F.countDistinct("c_nationkey").alias("nations"))


@query("SELECT count(*) AS n_rows, bit_xor(h) AS xor_hash, CAST(sum(CAST(h AS HUGEINT)) AS VARCHAR) AS sum_hash FROM (SELECT CAST('0x' || substr(md5(concat_ws('|', coalesce(c_mktsegment, chr(1) || 'null'), coalesce(c_name, chr(1) || 'null'), coalesce(CAST(c_nationkey AS VARCHAR), chr(1) || 'null'))), 1, 15) AS BIGINT) AS h FROM customer)")
def table_digest(spark: SparkSession, sf: str) -> DataFrame:
    return relations.digest(t(spark, sf, "customer"), ["c_name", "c_nationkey", "c_mktsegment"])


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, " + ", ".join(f"count_if(value <= {b}) AS le_{str(b).replace('.', '_')}" for b in rates.BUCKETS) + " FROM events GROUP BY 1")
def duration_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return rates.histogram(t(spark, sf, "events"), ["event_type"], F.col("value")).withColumn("total", F.round("total", 4))


@query("WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, user_id) AS rn FROM c) SELECT CASE WHEN rn <= 50 THEN CAST(user_id AS VARCHAR) ELSE 'overflow' END AS user_id, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1")
def series_overflow(spark: SparkSession, sf: str) -> DataFrame:
    return rates.overflow(t(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n")), ["user_id"], "n", 50)


@query("SELECT o_custkey, month, CAST(sum(cents) OVER (PARTITION BY o_custkey ORDER BY month) AS BIGINT) AS closing FROM (SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS month, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents FROM orders GROUP BY 1, 2)")
def monthly_statements(spark: SparkSession, sf: str) -> DataFrame:
    m = t(spark, sf, "orders").groupBy("o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"))
    return m.select("o_custkey", "month", F.sum("cents").over(W.partitionBy("o_custkey").orderBy("month")).alias("closing"))


@query("SELECT o_orderkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance_after FROM orders")
def running_balance(spark: SparkSession, sf: str) -> DataFrame:
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(W.unboundedPreceding, 0)
    return t(spark, sf, "orders").select("o_orderkey", F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).over(w).alias("balance_after"))


@query("SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem")
def row_count_guard(spark: SparkSession, sf: str) -> DataFrame:
    return reduce(DataFrame.union, [t(spark, sf, n).agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in ("customer", "orders", "lineitem")])


@query("SELECT c_custkey, CASE WHEN c_custkey = min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) THEN email ELSE email || '+dup' || c_custkey END AS email FROM (SELECT *, c_mktsegment || c_nationkey || '@x.com' AS email FROM customer)")
def dedup_emails(spark: SparkSession, sf: str) -> DataFrame:
    d = t(spark, sf, "customer").withColumn("email", F.concat("c_mktsegment", "c_nationkey", F.lit("@x.com")))
    first = F.min("c_custkey").over(W.partitionBy("email"))
    return d.select("c_custkey", F.when(F.col("c_custkey") == first, F.col("email")).otherwise(F.concat("email", F.lit("+dup"), F.col("c_custkey"))).alias("email"))


@query("SELECT c_custkey, split_part(c_name, '#', 1) AS first_name, split_part(c_name, '#', 2) AS last_name FROM customer")
def split_full_name(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "customer").select("c_custkey", F.split_part("c_name", F.lit("#"), F.lit(1)).alias("first_name"), F.split_part("c_name", F.lit("#"), F.lit(2)).alias("last_name"))


@query("SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders")
def to_cents(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'AC' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') END AS number FROM customer")
def backfill_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "customer").select("c_custkey", F.coalesce(F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")), F.concat(F.lit("AC"), F.lpad(F.col("c_custkey").cast("string"), 10, "0"))).alias("number"))


@query("SELECT o_orderkey, year(o_orderdate) AS year FROM orders WHERE year(o_orderdate) = 1996")
def partition_by_year(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{files.shared_folder(spark)}/orders-{uuid.uuid4().hex}"
    files.write_by_year(t(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", path)
    return files.read_years(spark, path, 1996).select("o_orderkey", F.year("o_orderdate").cast("bigint").alias("year"))


@query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS note FROM customer")
def csv_export(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{files.shared_folder(spark)}/customers-{uuid.uuid4().hex}"
    files.write_csv(t(spark, sf, "customer"), path, {"id": "c_custkey", "name": "c_name", "note": "c_mktsegment"})
    return files.read_csv(spark, path, "id long, name string, note string")


def event_log(spark: SparkSession, sf: str) -> DataFrame:
    """events as the change log of a table of users."""
    e = t(spark, sf, "events")
    op = F.when(F.col("event_type") == "signup", "c").when(F.col("event_type").isin("view", "purchase"), "u").when(F.col("event_type") == "click", "r").otherwise("d")
    row = F.struct(F.col("user_id").alias("id"), "event_type", F.floor(F.col("value") * 100).cast("bigint").alias("version"))
    source = F.struct(F.lit("public").alias("schema"), F.lit("users").alias("table"), (F.col("event_id") * 10).alias("lsn"))
    body = F.to_json(F.struct(op.alias("op"), F.when(op == "d", row).alias("before"), F.when(op != "d", row).alias("after"), source.alias("source")))
    value = F.when(F.col("event_id") % 50 == 7, F.lit(None)).when(F.col("event_id") % 50 == 9, F.lit("{broken")).otherwise(body)
    return e.select(
        F.lit("bank.public.users").alias("topic"), (F.col("user_id") % 4).cast("int").alias("partition"), F.col("event_id").alias("offset"),
        F.to_json(F.struct(F.col("user_id").alias("id"))).alias("key"), value.alias("value"), F.array().cast("array<struct<key:string,value:binary>>").alias("headers"), F.col("ts").cast("timestamp").alias("timestamp"),
    )


def changes(spark: SparkSession, sf: str) -> DataFrame:
    return cdc.classify(event_log(spark, sf), REPLICA).where("kind = 'change'")


LOG = "(SELECT *, CAST(floor(value * 100) AS BIGINT) AS version, CASE event_type WHEN 'signup' THEN 'c' WHEN 'view' THEN 'u' WHEN 'purchase' THEN 'u' WHEN 'click' THEN 'r' ELSE 'd' END AS op, CASE WHEN event_id % 50 = 7 THEN 'tombstone' WHEN event_id % 50 = 9 OR user_id = 0 THEN 'dead' ELSE 'change' END AS kind FROM events)"


@query(f"SELECT kind, count(*) AS n FROM {LOG} GROUP BY 1")
def classify_records(spark: SparkSession, sf: str) -> DataFrame:
    return cdc.classify(event_log(spark, sf), REPLICA).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"SELECT event_id AS \"offset\", op, event_id * 10 AS lsn FROM {LOG} WHERE event_id % 50 NOT IN (7, 9)")
def decode_envelope(spark: SparkSession, sf: str) -> DataFrame:
    return cdc.decode_envelope(event_log(spark, sf)).where("not poison and not tombstone").select("offset", "op", "lsn")


@query(f"SELECT event_id AS \"offset\", user_id AS id, event_type, version FROM {LOG} WHERE kind = 'change' AND op <> 'd'")
def decode_rows(spark: SparkSession, sf: str) -> DataFrame:
    return changes(spark, sf).where("not is_delete").select("offset", "row.*")


@query(f"SELECT event_id AS \"offset\", CAST(user_id AS VARCHAR) AS row_key, version FROM {LOG} WHERE kind = 'change' AND op = 'd'")
def decode_deletes(spark: SparkSession, sf: str) -> DataFrame:
    return changes(spark, sf).where("is_delete").select("offset", "row_key", "version")


QUERIES["row_key"] = lambda spark, sf: changes(spark, sf).groupBy("row_key").agg(F.count("*").alias("n"))
SQL["row_key"] = f"SELECT CAST(user_id AS VARCHAR) AS row_key, count(*) AS n FROM {LOG} WHERE kind = 'change' GROUP BY 1"


@query(f"SELECT event_id AS \"offset\", 'bank.public.users.dlq' AS topic, CAST(event_id AS VARCHAR) AS original, CASE WHEN event_id % 50 = 9 THEN 'not a change event' ELSE 'no key' END AS reason FROM {LOG} WHERE kind = 'dead'")
def dead_letter_write(spark: SparkSession, sf: str) -> DataFrame:
    dead = cdc.classify(event_log(spark, sf), REPLICA).where("kind = 'dead'").select("topic", "partition", "offset", "key", "value", "headers", "timestamp", "reason")
    out = changelog.dead_letters(dead, "replica")
    return out.select("offset", "topic", changelog.header("dlq.offset").alias("original"), changelog.header("dlq.reason").alias("reason"))


@query("SELECT 'users' AS table_name, 'public' AS schema_name, 'bank' AS prefix, count(*) AS n FROM events")
def topic_names(spark: SparkSession, sf: str) -> DataFrame:
    names = changelog.topic_parts(F.col("topic"))
    return event_log(spark, sf).groupBy(*[c.alias(n) for n, c in names.items()]).agg(F.count("*").alias("n"))


@query("SELECT 'bank.public.users' AS topic, CAST(user_id % 4 AS INTEGER) AS \"partition\", max(event_id) + 1 AS next_offset, strftime(arg_max(ts, event_id), '%Y-%m-%d %H:%M:%S') AS last_record_at FROM events GROUP BY 2")
def checkpoint_advance(spark: SparkSession, sf: str) -> DataFrame:
    return cdc.advance(event_log(spark, sf)).withColumn("last_record_at", stamp("last_record_at"))


@query("SELECT event_id AS \"offset\" FROM events WHERE event_id >= 5000")
def cdc_skip_covered(spark: SparkSession, sf: str) -> DataFrame:
    log = event_log(spark, sf)
    marks = log.select("topic", "partition").distinct().withColumn("next_offset", F.lit(5000).cast("bigint"))
    return cdc.uncovered(log, marks).select("offset")


@query("SELECT CAST(user_id % 4 AS INTEGER) AS \"partition\", count(*) AS records, count_if(event_id >= 5000) AS lag FROM events GROUP BY 1")
def replication_lag(spark: SparkSession, sf: str) -> DataFrame:
    return event_log(spark, sf).groupBy("partition").agg(F.count("*").alias("records"), F.count_if(F.col("offset") >= 5000).alias("lag"))


@query("SELECT \"partition\", \"after\", \"before\", \"before\" - \"after\" - 1 AS missing FROM (SELECT CAST(user_id % 4 AS INTEGER) AS \"partition\", event_id AS \"before\", lag(event_id) OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS \"after\" FROM events) WHERE \"before\" - \"after\" > 1")
def offset_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return changelog.gaps(event_log(spark, sf)).drop("topic")


@query("SELECT event_id AS \"offset\" FROM (SELECT event_id, lag(event_id) OVER (PARTITION BY user_id % 4 ORDER BY event_type, ts, event_id) AS p FROM events) WHERE event_id <= p")
def offset_order_check(spark: SparkSession, sf: str) -> DataFrame:
    kinds = t(spark, sf, "events").select(F.col("event_id").alias("offset"), "event_type")
    log = event_log(spark, sf).join(kinds, "offset").withColumn("arrival", F.struct("event_type", "timestamp", "offset"))
    return changelog.order_violations(log, "arrival").select("offset")


LAST = f"SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(op, event_id) AS op, max(event_id) AS last, count(*) AS changes FROM {LOG} WHERE kind = 'change' GROUP BY 1"


@query(f"SELECT coalesce(user_id, c_custkey) AS id, CASE WHEN user_id IS NULL THEN 'stored' ELSE event_type END AS event_type FROM ({LAST}) FULL JOIN customer ON c_custkey = user_id WHERE op IS NULL OR op <> 'd'")
def cdc_upsert(spark: SparkSession, sf: str) -> DataFrame:
    stored = t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit("stored").alias("event_type"), F.lit(2500).cast("bigint").alias("version"))
    last = cdc.newest(changes(spark, sf), by_lsn=False).select("row_key", (~F.col("is_delete")).alias("present"), "row")
    return cdc.apply_rows(stored, last, REPLICA).select("id", "event_type")


@query(f"SELECT CAST(user_id AS VARCHAR) AS row_key, last * 10 AS lsn, op = 'd' AS deleted FROM ({LAST})")
def cdc_order_by_lsn(spark: SparkSession, sf: str) -> DataFrame:
    return cdc.newest(changes(spark, sf), by_lsn=True).select("row_key", "lsn", F.col("is_delete").alias("deleted"))


@query(f"SELECT CAST(user_id AS VARCHAR) AS row_key, max(event_id) FILTER (op = 'c') * 10 AS lsn FROM {LOG} WHERE kind = 'change' GROUP BY 1 HAVING max(event_id) FILTER (op = 'c') >= coalesce(max(event_id) FILTER (op = 'd'), 0)")
def cdc_row_state(spark: SparkSession, sf: str) -> DataFrame:
    every = changes(spark, sf)
    state = every.where("is_delete").groupBy("row_key").agg(F.max("lsn").alias("lsn"))
    return cdc.claim(every.where("op = 'c'").groupBy("row_key").agg(F.max("lsn").alias("lsn")), state)


@query(f"SELECT event_id FROM (SELECT event_id, max(event_id * 10) OVER (PARTITION BY user_id ORDER BY event_id * 7919 % 1000003 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ahead FROM {LOG} WHERE kind = 'change') WHERE ahead IS NULL OR ahead <= event_id * 10")
def cdc_in_position(spark: SparkSession, sf: str) -> DataFrame:
    """The log delivered in another order: what is behind a position that its row has had is refused."""
    scrambled = changes(spark, sf).withColumn("event_id", F.col("offset")).withColumn("offset", F.col("offset") * 7919 % 1000003)
    return cdc.in_position(scrambled).select("event_id")


def folded(spark: SparkSession, sf: str) -> DataFrame:
    stored = t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit("stored").alias("event_type"), F.lit(2500).cast("bigint").alias("version"))
    return cdc.fold(changes(spark, sf).select("row_key", "offset", "is_delete", "version", "row"), stored, REPLICA)


#: The changes of each user folded onto the customers, one at a time; and all states on the way.
FOLD = """(WITH seq AS (SELECT user_id, event_id, {'gone': op = 'd', 'v': version, 'et': event_type, 'present': true, 'kept': 0::BIGINT, 'at': event_id} AS s FROM @LOG WHERE kind = 'change'),
lists AS (SELECT user_id, list_prepend({'gone': false, 'v': any_value(c_custkey) * 0 + 2500, 'et': CASE WHEN any_value(c_custkey) IS NOT NULL THEN 'stored' END, 'present': any_value(c_custkey) IS NOT NULL, 'kept': 0::BIGINT, 'at': -1}, list(s ORDER BY event_id)) AS l FROM seq LEFT JOIN customer ON c_custkey = user_id GROUP BY 1)
SELECT user_id, list_reduce(l, lambda a, x: CASE WHEN a.present AND a.v IS NOT NULL AND a.v > x.v AND NOT (x.gone AND x.v = 0) THEN a ELSE {'gone': x.gone, 'v': CASE WHEN NOT x.gone THEN x.v END, 'et': x.et, 'present': NOT x.gone, 'kept': a.kept + 1, 'at': x.at} END) AS s FROM lists)""".replace("@LOG", LOG)


@query(f"SELECT CAST(user_id AS VARCHAR) AS row_key, s.present AS present, s.et AS event_type, CASE WHEN s.present THEN s.v END AS version, s.kept AS kept FROM {FOLD}")
def cdc_collapse(spark: SparkSession, sf: str) -> DataFrame:
    return folded(spark, sf).select("row_key", "present", F.col("row.event_type").alias("event_type"), F.when(F.col("present"), F.col("row.version")).alias("version"), "kept")


@query(f"SELECT CAST(user_id AS VARCHAR) AS row_key, s.v AS version, s.kept AS kept FROM {FOLD} WHERE s.present")
def cdc_version_guard(spark: SparkSession, sf: str) -> DataFrame:
    return folded(spark, sf).where("present").select("row_key", F.col("row.version").alias("version"), "kept")


@query(f"SELECT CAST(user_id AS VARCHAR) AS row_key, s.kept AS kept FROM {FOLD} WHERE NOT s.present")
def cdc_delete(spark: SparkSession, sf: str) -> DataFrame:
    return folded(spark, sf).where("not present").select("row_key", "kept")


#: Whether each change survives: without a stored row it does, if no newer version is held; a delete ends what is held.
FEED = f"""(WITH RECURSIVE seq AS (SELECT user_id, event_id, event_type, version, op, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM {LOG} WHERE kind = 'change'),
run AS (SELECT user_id, event_id, op, rn, true AS kept, CASE WHEN op <> 'd' THEN version END AS held FROM seq WHERE rn = 1
UNION ALL SELECT s.user_id, s.event_id, s.op, s.rn, NOT coalesce(r.held > s.version AND NOT (s.op = 'd' AND s.version = 0), false), CASE WHEN coalesce(r.held > s.version AND NOT (s.op = 'd' AND s.version = 0), false) THEN r.held WHEN s.op <> 'd' THEN s.version END FROM run r JOIN seq s ON s.user_id = r.user_id AND s.rn = r.rn + 1) SELECT * FROM run)"""


@query(f"SELECT user_id, event_id, CASE op WHEN 'c' THEN 'created' WHEN 'u' THEN 'updated' ELSE 'deleted' END AS event FROM {FEED} WHERE kept AND op <> 'r'")
def change_feed(spark: SparkSession, sf: str) -> DataFrame:
    none = spark.createDataFrame([], REPLICA.schema)
    return cdc.feed(changes(spark, sf), none, REPLICA).select(F.col("row_key").cast("bigint").alias("user_id"), F.col("offset").alias("event_id"), "event")


@query(f"SELECT event_id AS \"offset\" FROM {LOG} WHERE kind = 'change' AND op = 'r'")
def snapshot_rows(spark: SparkSession, sf: str) -> DataFrame:
    return changes(spark, sf).where("op = 'r'").select("offset")


@query(f"SELECT count(*) AS records, count_if(kind = 'change') AS applied, count_if(kind = 'dead') AS dead_lettered, count_if(kind = 'tombstone') AS tombstones FROM {LOG}")
def replication_stats(spark: SparkSession, sf: str) -> DataFrame:
    n = lambda k: F.count_if(F.col("kind") == k)
    return cdc.classify(event_log(spark, sf), REPLICA).agg(F.count("*").alias("records"), n("change").alias("applied"), n("dead").alias("dead_lettered"), n("tombstone").alias("tombstones"))


@query(f"SELECT event_id AS \"offset\", 'not_signup_13' AS reason FROM {LOG} WHERE kind = 'change' AND op <> 'd' AND event_type = 'signup' AND version % 13 = 0")
def cdc_isolate_rejects(spark: SparkSession, sf: str) -> DataFrame:
    rows = changes(spark, sf).where("not is_delete").select("offset", "row.*").withColumn("bad", cdc.violations(REPLICA.checks))
    return rows.where("size(bad) > 0").select("offset", F.array_join("bad", ",").alias("reason"))


@query("SELECT event_type, error FROM (SELECT DISTINCT event_type, CASE event_type WHEN 'signup' THEN 'permanent' WHEN 'view' THEN 'transient' WHEN 'click' THEN 'permanent' WHEN 'purchase' THEN 'neither' ELSE 'transient' END AS error FROM events)")
def classify_errors(spark: SparkSession, sf: str) -> DataFrame:
    code = F.when(F.col("event_type") == "signup", "22003").when(F.col("event_type") == "view", "40001").when(F.col("event_type") == "click", "23502").when(F.col("event_type") == "purchase", "23505")
    return t(spark, sf, "events").select("event_type", cdc.error_class(code).alias("error")).distinct()


@query("SELECT user_id, least(3600, 30 * power(2, least(n, 30)))::BIGINT AS seconds FROM (SELECT user_id, count(*) % 10 AS n FROM events GROUP BY 1)")
def repair_backoff(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "events").groupBy("user_id").agg((F.count("*") % 10).alias("n")).select("user_id", cdc.backoff(F.col("n")).alias("seconds"))


@query("SELECT DISTINCT CAST(user_id AS VARCHAR) AS row_key FROM events WHERE event_id % 50 = 9 AND user_id <> 0")
def repair_seed(spark: SparkSession, sf: str) -> DataFrame:
    dead = cdc.classify(event_log(spark, sf), REPLICA).where("kind = 'dead'")
    return dead.select(cdc.get(F.try_parse_json("key"), "id", as_type="string").alias("row_key")).where("row_key is not null and row_key <> '0'").distinct()


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 AND c_custkey % 10 <> 0 THEN 'fixed' ELSE 'stored' END AS event_type, c_custkey AS version FROM customer")
def repair_parked(spark: SparkSession, sf: str) -> DataFrame:
    now = t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.when((F.col("c_custkey") % 7 == 0) & (F.col("c_custkey") % 10 != 0), "fixed").otherwise("stored").alias("event_type"), F.col("c_custkey").alias("version"))
    replica = now.where("id % 10 <> 0").withColumn("event_type", F.lit("stored"))
    parked = now.where("id % 7 = 0 or id % 10 = 0").select(F.col("id").cast("string").alias("row_key"))
    return cdc.repair(parked, now, replica, REPLICA)[0].select("id", "event_type", "version")


@query("SELECT user_id, deleted FROM (SELECT user_id, arg_max(op, event_id) = 'd' AS deleted, max(ts) AS last_at FROM " + LOG + " WHERE kind = 'change' GROUP BY 1) WHERE NOT (deleted AND last_at < TIMESTAMP '2024-01-30 12:00:00')")
def cdc_prune_tombstones(spark: SparkSession, sf: str) -> DataFrame:
    state = changes(spark, sf).groupBy(F.col("row_key").cast("bigint").alias("user_id")).agg(F.max_by("is_delete", "offset").alias("deleted"), F.max("timestamp").alias("updated_at"))
    return cdc.prune_tombstones(state, F.lit("2024-02-13 12:00:00").cast("timestamp")).select("user_id", "deleted")


@query("SELECT c_custkey, round(c_acctbal + coalesce(d, 0), 2) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS d FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def bulk_increment(spark: SparkSession, sf: str) -> DataFrame:
    deltas = t(spark, sf, "orders").select("o_custkey", F.lit(1).alias("delta"))
    return writes.increment(t(spark, sf, "customer").select("c_custkey", "c_acctbal"), deltas, CUSTOMER, "c_acctbal").select("c_custkey", F.round("c_acctbal", 2).alias("c_acctbal"))


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey % 5 = 0 THEN 'UPDATED' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def bulk_update(spark: SparkSession, sf: str) -> DataFrame:
    c = t(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    new = c.where("c_custkey % 5 = 0").select("c_custkey", F.lit("UPDATED").alias("c_mktsegment"))
    return writes.update(c, new.union(new.select(-F.col("c_custkey"), "c_mktsegment")), CUSTOMER)


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def bulk_delete(spark: SparkSession, sf: str) -> DataFrame:
    return writes.delete(t(spark, sf, "customer"), t(spark, sf, "orders").where("o_orderstatus = 'P'").select("o_custkey"), CUSTOMER).select("c_custkey")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'inserted' ELSE 'refused' END AS outcome, CASE WHEN c_custkey % 3 <> 0 THEN 'key is stored' END AS reason FROM customer WHERE c_custkey % 2 = 0")
def bulk_insert(spark: SparkSession, sf: str) -> DataFrame:
    c = t(spark, sf, "customer")
    _, rows, refused = writes.insert(c.where("c_custkey % 3 <> 0"), c.where("c_custkey % 2 = 0"), CUSTOMER)
    return rows.select("c_custkey", F.lit("inserted").alias("outcome"), F.lit(None).cast("string").alias("reason")).union(refused.select("c_custkey", F.lit("refused"), "reason"))


FILLED = "(SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS seg FROM customer)"


@query(f"SELECT c_custkey // 1000 * 1000 AS from_id, (c_custkey // 1000 + 1) * 1000 AS to_id, count_if(seg <> lower(seg)) AS n_changed FROM {FILLED} GROUP BY 1, 2")
def backfill_where_distinct(spark: SparkSession, sf: str) -> DataFrame:
    low = F.lower("c_mktsegment")
    c = t(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, low).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    return writes.backfill(c, CUSTOMER, "c_mktsegment", low, size=1000)[1]


#: Transfers one at a time: each waits for those before it on both of its accounts, and hands on their balances.
BANK = """(WITH RECURSIVE a AS (SELECT c_custkey AS account, CAST(round(c_acctbal * 5000) AS BIGINT) AS balance, c_custkey % 17 <> 0 AS active FROM customer),
o AS (SELECT o_orderkey AS id, o_custkey AS debit, o_custkey * 7 % (SELECT count(*) FROM customer) AS credit, CAST(round(o_totalprice * 100) AS BIGINT) - 500000 AS cents FROM orders),
j AS (SELECT o.*, d.balance AS d0, c.balance AS c0, CASE WHEN cents <= 0 THEN 'not positive' WHEN debit = credit THEN 'self' WHEN d.balance IS NULL OR c.balance IS NULL THEN 'unknown' WHEN NOT d.active OR NOT c.active THEN 'inactive' END AS refused FROM o LEFT JOIN a d ON d.account = debit LEFT JOIN a c ON c.account = credit),
s AS (SELECT id, account, lag(id) OVER (PARTITION BY account ORDER BY id) AS prev FROM (SELECT id, unnest([debit, credit]) AS account FROM j WHERE refused IS NULL)),
p AS MATERIALIZED (SELECT j.id, debit, credit, cents, d0, c0, x.prev AS pd, y.prev AS pc FROM j JOIN s x ON x.id = j.id AND x.account = debit JOIN s y ON y.id = j.id AND y.account = credit WHERE refused IS NULL),
run(id, debit, credit, dv, cv, ok) USING KEY (id) AS (SELECT id, debit, credit, d0 - CASE WHEN cents <= d0 THEN cents ELSE 0 END, c0 + CASE WHEN cents <= d0 THEN cents ELSE 0 END, cents <= d0 FROM p WHERE pd IS NULL AND pc IS NULL
UNION ALL SELECT id, debit, credit, d - CASE WHEN cents <= d THEN cents ELSE 0 END, c + CASE WHEN cents <= d THEN cents ELSE 0 END, cents <= d FROM (
SELECT p.id, p.debit, p.credit, p.cents, CASE WHEN pd IS NULL THEN d0 WHEN x.debit = p.debit THEN x.dv ELSE x.cv END AS d, CASE WHEN pc IS NULL THEN c0 WHEN y.debit = p.credit THEN y.dv ELSE y.cv END AS c
FROM p LEFT JOIN recurring.run x ON x.id = pd LEFT JOIN recurring.run y ON y.id = pc WHERE (pd IN (SELECT id FROM run) OR pc IN (SELECT id FROM run)) AND (pd IS NULL OR x.id IS NOT NULL) AND (pc IS NULL OR y.id IS NOT NULL))),
v AS (SELECT j.id, j.debit, j.credit, j.cents, coalesce(refused, CASE WHEN ok THEN 'posted' ELSE 'insufficient' END) AS verdict FROM j LEFT JOIN run ON run.id = j.id)"""


def bank(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = t(spark, sf, "customer")
    accounts = c.select(F.col("c_custkey").alias("account"), F.round(F.col("c_acctbal") * 5000).cast("bigint").alias("balance"), (F.col("c_custkey") % 17 != 0).alias("active"))
    transfers = t(spark, sf, "orders").crossJoin(F.broadcast(c.agg(F.count("*").alias("n")))).select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("debit"), (F.col("o_custkey") * 7 % F.col("n")).alias("credit"), (F.round(F.col("o_totalprice") * 100).cast("bigint") - 500000).alias("cents"))  # n: one row
    return ledger.post(transfers, accounts)


@query(f"{BANK} SELECT id, verdict FROM v)")
def post_transfers(spark: SparkSession, sf: str) -> DataFrame:
    return bank(spark, sf)[0].select("id", "verdict")


@query(f"{BANK} SELECT account, balance + coalesce(s, 0)::BIGINT AS balance FROM a LEFT JOIN (SELECT x, sum(y) AS s FROM (SELECT debit AS x, -cents AS y FROM v WHERE verdict = 'posted' UNION ALL SELECT credit, cents FROM v WHERE verdict = 'posted') GROUP BY 1) ON x = account)")
def posted_balances(spark: SparkSession, sf: str) -> DataFrame:
    return bank(spark, sf)[2].select("account", "balance")


def _shapes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """customer, and an older copy of it: a name of another name, a smaller key, no segment, a column that is gone since."""
    c = t(spark, sf, "customer")
    old = c.select(F.col("c_custkey").cast("int").alias("c_custkey"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").cast("bigint").alias("c_nationkey"), "c_name", F.when(F.col("c_custkey") % 3 == 0, True).alias("vip"))
    return c, old


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, CAST(NULL AS VARCHAR) AS c_mktsegment FROM customer")
def schema_align(spark: SparkSession, sf: str) -> DataFrame:
    now, old = _shapes(spark, sf)
    return schemas.align(old, now.schema, destructive=True)


@query("SELECT 'c_mktsegment' AS \"column\", 'added' AS kind, 'ADD COLUMN c_mktsegment string' AS fix, false AS destructive, count(c_mktsegment) AS n_values FROM customer UNION ALL SELECT 'c_acctbal', 'renamed', 'RENAME COLUMN balance TO c_acctbal', false, count(c_acctbal) FROM customer UNION ALL SELECT 'vip', 'dropped', 'DROP COLUMN vip', true, count_if(c_custkey % 3 = 0) FROM customer UNION ALL SELECT 'c_custkey', 'changed', 'ALTER COLUMN c_custkey TYPE bigint', false, count(*) FROM customer UNION ALL SELECT 'c_nationkey', 'changed', 'ALTER COLUMN c_nationkey TYPE int', true, count(*) FROM customer")
def schema_drift(spark: SparkSession, sf: str) -> DataFrame:
    now, old = _shapes(spark, sf)
    return schemas.drift(now, old)


@query("SELECT event_id, allowed, round(CASE WHEN allowed THEN 0 ELSE 3600 - epoch(ts) % 3600 END, 3) AS retry_after FROM (SELECT event_id, ts, row_number() OVER (PARTITION BY user_id, floor(epoch(ts) / 3600) ORDER BY ts, event_id) <= 2 AS allowed FROM events)")
def rate_window(spark: SparkSession, sf: str) -> DataFrame:
    return rates.rate_window(t(spark, sf, "events"), "user_id", "ts", "event_id", 2, 3600).select("event_id", "allowed", F.round("retry_after", 3).alias("retry_after"))


BUCKET = """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
b AS (SELECT event_id, user_id, t, rn, 3.0::DOUBLE AS have FROM e WHERE rn = 1
UNION ALL SELECT e.event_id, e.user_id, e.t, e.rn, CASE WHEN e.t - b.t >= 172800 THEN 3.0 ELSE least(3.0, CASE WHEN b.have >= 1 THEN b.have - 1 ELSE b.have END + (e.t - b.t) * (1.0::DOUBLE / 7200)) END FROM b JOIN e ON e.user_id = b.user_id AND e.rn = b.rn + 1)
SELECT event_id, have >= 1 AS allowed, round(CASE WHEN have >= 1 THEN 0 ELSE (1 - have) / (1.0::DOUBLE / 7200) END, 3) AS retry_after FROM b"""


@query(BUCKET)
def token_bucket(spark: SparkSession, sf: str) -> DataFrame:
    return rates.token_bucket(t(spark, sf, "events"), "user_id", "ts", "event_id", 1 / 7200, 3, 172_800).select("event_id", "allowed", F.round("retry_after", 3).alias("retry_after"))


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
b AS (SELECT event_id, user_id, rn, ts AS held, true AS kept FROM e WHERE rn = 1
UNION ALL SELECT e.event_id, e.user_id, e.rn, CASE WHEN e.ts >= b.held + INTERVAL 20 HOUR THEN e.ts ELSE b.held END, e.ts >= b.held + INTERVAL 20 HOUR FROM b JOIN e ON e.user_id = b.user_id AND e.rn = b.rn + 1)
SELECT user_id, event_id FROM b WHERE kept""")
def dedup_within_ttl(spark: SparkSession, sf: str) -> DataFrame:
    return rates.unique_within(t(spark, sf, "events"), "user_id", "ts", "event_id", 72_000, span=4).select("user_id", "event_id")


D = lambda spark, sf: t(spark, sf, "documents")


@query("""WITH t AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '\\W+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'license')) AS a, len(list_filter(w, lambda x: x = 'token')) AS b FROM t),
s AS (SELECT count(*) AS docs, avg(n) AS mean, count_if(a > 0) AS da, count_if(b > 0) AS db FROM c)
SELECT doc_id, round(ln(1 + (docs - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / mean)) + ln(1 + (docs - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / mean)), 6) AS score FROM c, s WHERE a > 0 OR b > 0""")
def search_score(spark: SparkSession, sf: str) -> DataFrame:
    return search.bm25(D(spark, sf), "text", "Token, license").select("doc_id", F.round("score", 6).alias("score"))



@query("SELECT doc_id, trim(regexp_replace(lower(source), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM documents")
def slug(spark: SparkSession, sf: str) -> DataFrame:
    return D(spark, sf).select("doc_id", text.slug(F.col("source")).alias("slug"))


@query("SELECT doc_id, regexp_replace(text, '[\\x00-\\x1f\\x7f-\\x9f]', '', 'g') AS text FROM documents")
def strip_control(spark: SparkSession, sf: str) -> DataFrame:
    return D(spark, sf).select("doc_id", text.strip_control(F.col("text")).alias("text"))


@query("SELECT doc_id, CASE WHEN strlen(text) <= 128 THEN text ELSE left(text, CAST(list_max(list_filter(range(0, 129), lambda k: strlen(left(text, CAST(k AS BIGINT))) <= 128)) AS BIGINT)) || '...' END AS label FROM documents")
def truncate_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return D(spark, sf).select("doc_id", text.truncate(F.col("text"), 128).alias("label"))


@query("SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents")
def ascii_lower(spark: SparkSession, sf: str) -> DataFrame:
    return D(spark, sf).select("doc_id", text.ascii_lower(F.col("text")).alias("text"))


@query("SELECT doc_id, len(items) AS n, coalesce(items[1], '') AS first FROM (SELECT doc_id, list_filter(list_transform(string_split(text, ','), lambda x: trim(x, ' ')), lambda x: x <> '') AS items FROM documents)")
def split_list(spark: SparkSession, sf: str) -> DataFrame:
    items = text.split_list(F.col("text"))
    return D(spark, sf).select("doc_id", F.size(items).cast("bigint").alias("n"), F.coalesce(F.try_element_at(items, F.lit(1)), F.lit("")).alias("first"))


@query("SELECT p_partkey, lower(regexp_replace(p_type, '[^A-Za-z0-9]+', '_', 'g')) AS snake FROM part")
def case_convert(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "part").select("p_partkey", text.snake(F.col("p_type")).alias("snake"))


@query("SELECT page_id, regexp_extract(url, '://([^/?#:]+)', 1) AS host FROM pages")
def url_host(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "pages").select("page_id", text.url_host(F.col("url")).alias("host"))


@query("SELECT page_id, CASE WHEN regexp_matches(url, '[?&]page=') THEN url ELSE split_part(url, '#', 1) || CASE WHEN contains(split_part(url, '#', 1), '?') THEN '&' ELSE '?' END || 'page=1' || regexp_extract(url, '#.*$') END AS url FROM pages")
def url_query_default(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "pages").select("page_id", text.with_query(F.col("url"), "page", "1").alias("url"))


@query("SELECT doc_id, regexp_matches(word, '^\\+[1-9][0-9]{7,14}$') AS phone, regexp_matches(word, '^[A-Za-z0-9._-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+$') AS email FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '+1' || lpad(CAST(doc_id AS VARCHAR), 9, '5') WHEN 1 THEN source || '@example.com' ELSE 'x' || source END AS word FROM documents)")
def valid_contacts(spark: SparkSession, sf: str) -> DataFrame:
    word = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("+1"), F.lpad(F.col("doc_id").cast("string"), 9, "5"))).when(F.col("doc_id") % 3 == 1, F.concat("source", F.lit("@example.com"))).otherwise(F.concat(F.lit("x"), "source"))
    return D(spark, sf).select("doc_id", text.valid_phone(word).alias("phone"), text.valid_email(word).alias("email"))


@query("SELECT c_custkey, sha256(c_name) AS plain, sha256('pepper:' || c_name) AS salted FROM customer")
def pseudonymize(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "customer").select("c_custkey", text.pseudonym(F.col("c_name")).alias("plain"), text.pseudonym(F.col("c_name"), "pepper").alias("salted"))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '[\\x01-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x9f]') THEN 'control' END AS refused, nfc_normalize(text) AS text FROM documents")
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return D(spark, sf).select("doc_id", text.unsafe(F.col("text")).alias("refused"), text.nfc(F.col("text")).alias("text"))


@query("SELECT event_id, json_type(props) = 'OBJECT' AS is_object, json_exists(props, '$.k') AS has_k, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_checks(spark: SparkSession, sf: str) -> DataFrame:
    names = F.json_object_keys("props")
    return t(spark, sf, "events").select("event_id", names.isNotNull().alias("is_object"), F.coalesce(F.array_contains(names, "k"), F.lit(False)).alias("has_k"), F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


CHECKS = {"status known": "o_orderstatus in ('F', 'O', 'P')", "price positive": "o_totalprice > 0", "open or old": "o_orderstatus <> 'O' or year(o_orderdate) >= 1997", "customer set": "o_custkey is not null"}


@query("SELECT 'status known' AS name, count_if(NOT (o_orderstatus IN ('F', 'O', 'P'))) AS violations FROM orders UNION ALL SELECT 'price positive', count_if(NOT (o_totalprice > 0)) FROM orders UNION ALL SELECT 'open or old', count_if(NOT (o_orderstatus <> 'O' OR year(o_orderdate) >= 1997)) FROM orders UNION ALL SELECT 'customer set', count_if(o_custkey IS NULL) FROM orders")
def constraint_report(spark: SparkSession, sf: str) -> DataFrame:
    one = t(spark, sf, "orders").agg(F.array(*[F.struct(F.lit(n).alias("name"), F.count_if(~F.expr(c)).alias("violations")) for n, c in CHECKS.items()]).alias("all"))
    return one.select(F.explode("all").alias("x")).select("x.*")


@query("SELECT o_orderkey, 'open or old' AS reason FROM orders WHERE o_orderstatus = 'O' AND year(o_orderdate) < 1997")
def validate_batch(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "orders").withColumn("bad", cdc.violations(CHECKS)).where("size(bad) > 0").select("o_orderkey", F.array_join("bad", ",").alias("reason"))


@query("SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2 HAVING count(*) > 1")
def unique_report(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT 'orders.o_custkey' AS fk, count(*) AS orphans FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'lineitem.l_orderkey', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def fk_report(spark: SparkSession, sf: str) -> DataFrame:
    fks = (("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"))
    return reduce(DataFrame.union, [relations.orphans(t(spark, sf, a), t(spark, sf, b), k, p).agg(F.lit(f"{a}.{k}").alias("fk"), F.count("*").alias("orphans")) for a, k, b, p in fks])


@query("SELECT o_custkey, o_orderpriority, min(o_orderkey) AS first FROM orders GROUP BY 1, 2")
def idempotent_entries(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("first"))
