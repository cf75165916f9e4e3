"""Total orders, keyset pages and cursors."""

from __future__ import annotations

import base64
import json
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime
from functools import reduce
from operator import and_, or_
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators.filters import UnknownField, apply, normalize_field
from millrace.plans.spec import TableSpec

PAGE, FIND = 30, 30
#: Rows of a range that page_numbers() puts in order in one task, and the most ranges.
RANGE, RANGES = 500_000, 256
Sort = list[tuple[str, str]]


class InvalidCursor(ValueError):
    """A cursor that isn't one of this order."""


def total_order(df: DataFrame, spec: TableSpec, fields: list[dict] | None = None) -> Sort:
    """Request's sort or the table's own, and the key, descending, to break ties."""
    asked = [(f.get("field", ""), f.get("order")) for f in fields] if fields else list(spec.default_sort)
    out: Sort = []
    for name, order in asked:
        name = name if name in df.columns else normalize_field(name)
        if name not in df.columns:
            raise UnknownField(name)
        out.append((name, "desc" if order == "desc" else "asc"))
    return out if any(n == spec.id_col for n, _ in out) else [*out, (spec.id_col, "desc")]


def order_by(sort: Sort, backward: bool = False) -> list[Column]:
    """Nulls last in either direction; the reverse order has them first, so that neighbours stay neighbours."""
    return [(F.col(f"`{n}`").asc_nulls_first() if o == "desc" else F.col(f"`{n}`").desc_nulls_first()) if backward else (F.col(f"`{n}`").desc_nulls_last() if o == "desc" else F.col(f"`{n}`").asc_nulls_last()) for n, o in sort]


def after(df: DataFrame, sort: Sort, values: list, backward: bool = False) -> Column:
    """Rows beyond the values: equal in the first columns, beyond in the next; one condition for any mix of directions."""
    types = dict(df.dtypes)
    ways, same = [], []
    for (name, order), value in zip(sort, values, strict=True):
        col = F.col(f"`{name}`")
        lit = F.lit(value).cast(types[name])
        if value is None:  # last: nothing is beyond it, everything before it
            if backward:
                ways.append(reduce(and_, [*same, col.isNotNull()]))
            same.append(col.isNull())
            continue
        up = (order == "asc") != backward
        beyond = col > lit if up else col < lit
        ways.append(reduce(and_, [*same, beyond if backward else beyond | col.isNull()]))
        same.append(col == lit)
    return reduce(or_, ways) if ways else F.lit(False)


def _text(v: object) -> str:
    return v.isoformat() if isinstance(v, date | datetime) else repr(v) if isinstance(v, float) else str(v)


def encode(row: Row, sort: Sort, backward: bool = False) -> str:
    values = [row[n] for n, _ in sort]
    body = {"v": ["" if v is None else _text(v) for v in values], "n": [v is None for v in values], "b": backward}
    return quote(base64.b64encode(json.dumps(body).encode()).decode())


def decode(cursor: str, sort: Sort) -> tuple[list[str | None], bool]:
    try:
        body = json.loads(base64.b64decode(unquote(cursor), validate=True))
        values, nulls, back = body["v"], body["n"], bool(body.get("b"))
    except (ValueError, KeyError, TypeError) as e:
        raise InvalidCursor("unreadable") from e
    if not isinstance(values, list) or not isinstance(nulls, list) or not len(values) == len(nulls) == len(sort):
        raise InvalidCursor("of another order")
    return [None if n else v for v, n in zip(values, nulls, strict=True)], back


@dataclass
class Page:
    rows: DataFrame
    next: str | None
    previous: str | None


def window(df: DataFrame, sort: Sort, size: int, cursor: tuple[list, bool] | None = None) -> DataFrame:
    """A page and one row more, in the direction of the cursor: a top-k, no full sort."""
    back = bool(cursor and cursor[1])
    rows = df.where(after(df, sort, cursor[0], back)) if cursor else df
    return rows.orderBy(*order_by(sort, back)).limit((size if size > 0 else PAGE) + 1)


def paginate(df: DataFrame, spec: TableSpec, request: dict | None = None, page_size: int = PAGE, cursor: str | None = None, scope: dict | None = None, project: Callable[[DataFrame], DataFrame] | None = None) -> Page:
    """One page with its cursors. Only the page (page_size + 1 rows) comes to the driver."""
    size = page_size if page_size > 0 else PAGE
    sort = total_order(df, spec, (request or {}).get("sortFields") or (scope or {}).get("sortFields"))
    at = decode(cursor, sort) if cursor else None
    rows = window(apply(df, spec, scope, request), sort, size, at).collect()
    more, rows = len(rows) > size, rows[:size]
    back = bool(at and at[1])
    rows = rows[::-1] if back else rows
    page = df.sparkSession.createDataFrame(rows, df.schema)
    forward, behind = (True, more) if back else (more, bool(at))
    return Page(project(page) if project else page, encode(rows[-1], sort) if rows and forward else None, encode(rows[0], sort, True) if rows and behind else None)


Project = Callable[[DataFrame], DataFrame]


def find(df: DataFrame, spec: TableSpec, request: dict | None = None, limit: int | None = FIND, scope: dict | None = None, project: Project | None = None) -> DataFrame:
    """The first rows by the order; limit None: all. project: what callers get to see of the rows, as with all readers."""
    sort = total_order(df, spec, (request or {}).get("sortFields") or (scope or {}).get("sortFields"))
    rows = apply(df, spec, scope, request).orderBy(*order_by(sort))
    rows = rows if limit is None else rows.limit(limit)
    return project(rows) if project else rows


def get_by_id(df: DataFrame, spec: TableSpec, value: object, project: Project | None = None) -> DataFrame:
    row = df.where(F.col(f"`{spec.id_col}`") == F.lit(value)).limit(1)
    return project(row) if project else row


def row_at_extreme(df: DataFrame, spec: TableSpec, field: str, largest: bool = True, project: Project | None = None) -> DataFrame:
    """The whole row with the largest or smallest value, nulls last, ties by the largest key."""
    row = df.orderBy(*order_by([(field, "desc" if largest else "asc"), (spec.id_col, "desc")])).limit(1)
    return project(row) if project else row


def _edges(df: DataFrame, sort: Sort, buckets: int) -> list[list]:
    """The last row's sort values of each of at most so many ranges of the order but the last."""
    keys = df.select(*[F.col(f"`{n}`") for n, _ in sort])
    parts = keys.repartitionByRange(buckets, *order_by(sort)).withColumn("_part", F.spark_partition_id())
    last = parts.withColumn("_last", F.row_number().over(W.partitionBy("_part").orderBy(*order_by(sort, True)))).where("_last = 1")
    rows = [r for r in last.orderBy("_part").collect()]
    return [[None if r[n] is None else _text(r[n]) for n, _ in sort] for r in rows[:-1]]


def page_numbers(df: DataFrame, sort: Sort, size: int, buckets: int | None = None) -> DataFrame:
    """All pages at once: rows are cut into ranges of the order, numbered there, and the ranges' sizes are added up.

    The ranges' edges are found once and are constants of the plan, so that sizes and rows are of the same ranges. The sort
    must be a total order. Rows of one range are numbered in one task; unless buckets says otherwise there is a range for
    RANGE rows, but no more than RANGES, as each is a condition of the plan.
    """
    buckets = buckets or min(RANGES, -(-df.count() // RANGE))
    edges = _edges(df, sort, buckets) if buckets > 1 else []

    def place(lo: int, hi: int) -> Column:  # how many edges a row is beyond, by halving
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(after(df, sort, edges[mid]), place(mid + 1, hi)).otherwise(place(lo, mid))

    parts = df.withColumn("_part", place(0, len(edges)))
    sizes = parts.groupBy("_part").count()
    before = sizes.withColumn("_before", F.coalesce(F.sum("count").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    rank = F.row_number().over(W.partitionBy("_part").orderBy(*order_by(sort)))
    numbered = parts.withColumn("_rank", rank).join(F.broadcast(before), "_part")  # a row a range
    row = F.col("_rank") + F.col("_before")
    return numbered.withColumn("row_number", row.cast("bigint")).withColumn("page", (F.floor((row - 1) / size) + 1).cast("bigint")).drop("_part", "_rank", "_before")


def count(df: DataFrame, spec: TableSpec, request: dict | None = None, scope: dict | None = None) -> DataFrame:
    return apply(df, spec, scope, request).agg(F.count("*").alias("n"))


def exists(df: DataFrame, spec: TableSpec, request: dict | None = None, scope: dict | None = None) -> DataFrame:
    return apply(df, spec, scope, request).limit(1).agg((F.count("*") > 0).alias("found"))
