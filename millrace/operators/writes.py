"""Writes as new versions of a table: insert, update, increment, delete and backfill by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from millrace.operators.cdc import violations
from millrace.plans.spec import TableSpec


class NoneDeleted(LookupError):
    """No row had the id."""


def insert(stored: DataFrame, new: DataFrame, spec: TableSpec) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(the table with the new rows, the rows as inserted, the refused ones with their reason).

    A request is refused as a whole row: without a key, with a key that is stored or stands twice in it, or breaking a
    check. Columns that it lacks are null, columns that the table lacks are ignored.
    """
    have = dict(new.dtypes)
    rows = new.select(*[(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in stored.schema.fields])
    key = F.col(f"`{spec.id_col}`")
    taken = stored.select(key.alias("_taken"))
    twice = rows.groupBy(key.alias("_key")).agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("_key").alias("_twice"))
    judged = rows.join(taken, key == F.col("_taken"), "left").join(twice, key == F.col("_twice"), "left").withColumn("_bad", F.array_join(violations(spec.checks), ","))
    reason = F.when(key.isNull(), "no key").when(F.col("_taken").isNotNull(), "key is stored").when(F.col("_twice").isNotNull(), "key stands twice").when(F.col("_bad") != "", F.concat(F.lit("checks: "), "_bad"))
    judged = judged.withColumn("reason", reason)
    good = judged.where("reason is null").select(*stored.columns)
    return stored.unionByName(good), good, judged.where("reason is not null").select(*stored.columns, "reason")


def update(stored: DataFrame, new: DataFrame, spec: TableSpec) -> DataFrame:
    """The table with all columns that new has but the key taken from it, for keys that are stored; the last row of a key
    that stands twice, by its values, counts."""
    columns = [c for c in new.columns if c in stored.columns and c != spec.id_col]
    by_key = new.groupBy(F.col(f"`{spec.id_col}`").alias("_key")).agg(F.max(F.struct(*columns)).alias("_new"))
    both = stored.join(by_key, F.col(f"`{spec.id_col}`") == F.col("_key"), "left")
    return both.select(*[F.when(F.col("_key").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(f"`{c}`")).alias(c) if c in columns else F.col(f"`{c}`") for c in stored.columns])


def increment(stored: DataFrame, deltas: DataFrame, spec: TableSpec, column: str) -> DataFrame:
    """deltas(key, delta) added up and to the column; a whole number stays one. A null column counts as nothing."""
    key, delta = deltas.columns[:2]
    total = deltas.groupBy(F.col(f"`{key}`").alias("_key")).agg(F.sum(f"`{delta}`").alias("_delta"))
    of = stored.schema[column].dataType
    if isinstance(of, IntegralType) and not isinstance(deltas.schema[delta].dataType, IntegralType):
        raise TypeError(f"{column} is a whole number, the deltas are not")
    new = (F.coalesce(F.col(f"`{column}`"), F.lit(0)) + F.col("_delta")).cast(of)
    both = stored.join(total, F.col(f"`{spec.id_col}`") == F.col("_key"), "left")
    return both.select(*[F.when(F.col("_delta").isNotNull(), new).otherwise(F.col(f"`{c}`")).alias(c) if c == column else F.col(f"`{c}`") for c in stored.columns])


def delete(stored: DataFrame, ids: DataFrame, spec: TableSpec, must: bool = False) -> DataFrame:
    """The table without the rows of the ids. must: raises if no row has one."""
    keys = ids.select(F.col(ids.columns[0]).alias("_gone"))
    same = F.col(f"`{spec.id_col}`") == F.col("_gone")
    if must and stored.join(keys, same, "left_semi").isEmpty():
        raise NoneDeleted(spec.name)
    return stored.join(keys, same, "left_anti")


def backfill(stored: DataFrame, spec: TableSpec, column: str, value: Column, size: int = 10_000, lo: int | None = None, hi: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(the table with the value where it differs, one row a range of `size` keys: from_id, to_id, n_changed).

    lo, hi: only keys from lo to before hi, so that a run can stop and go on.
    """
    key = F.col(f"`{spec.id_col}`")
    inside = (key >= lo if lo is not None else F.lit(True)) & (key < hi if hi is not None else F.lit(True))
    differs = inside & ~F.col(f"`{column}`").eqNullSafe(value)
    start = F.floor(key / size) * size
    report = stored.where(inside).groupBy(start.alias("from_id")).agg(F.count_if(differs).alias("n_changed")).select("from_id", (F.col("from_id") + size).alias("to_id"), "n_changed")
    return stored.withColumn(column, F.when(differs, value).otherwise(F.col(f"`{column}`"))), report
