"""Change logs and dead letters in the column layout of the Kafka source, as Parquet or JSON directories or format("kafka")."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCHEMA = "topic string, partition int, offset bigint, key string, value string, headers array<struct<key:string,value:binary>>, timestamp timestamp"
#: Headers that a dead letter has besides its own.
HEADERS = ("dlq.topic", "dlq.partition", "dlq.offset", "dlq.group", "dlq.reason", "dlq.timestamp", "dlq.attempts")


class TooMany(RuntimeError):
    """More dead letters than the limit; nothing is cut off."""


def topic(prefix: Column, schema: Column, table: Column) -> Column:
    return F.concat_ws(".", prefix, schema, table)


def topic_parts(name: Column) -> dict[str, Column]:
    """Read from the right, as a prefix may have dots itself."""
    parts = F.split(name, r"\.")
    return {"table_name": F.element_at(parts, -1), "schema_name": F.element_at(parts, -2), "prefix": F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 2), ".")}


def read_log(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(SCHEMA).format(fmt).load(path)


def stream_log(spark: SparkSession, path: str, fmt: str = "parquet", files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(SCHEMA).format(fmt).option("maxFilesPerTrigger", files_per_batch).load(path)


def publish(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.mode("append").format(fmt).save(path)


def dead_letters(records: DataFrame, group: str, attempts: int = 3) -> DataFrame:
    """records(log columns, reason) as records of `<topic>.dlq` with the headers of where and why; a reason has no row values."""
    values = (F.col("topic"), F.col("partition"), F.col("offset"), F.lit(group), F.col("reason"), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.lit(attempts))
    own = F.array(*[F.struct(F.lit(k).alias("key"), F.coalesce(v.cast("string"), F.lit("")).cast("binary").alias("value")) for k, v in zip(HEADERS, values, strict=True)])
    kept = F.coalesce("headers", F.array().cast("array<struct<key:string,value:binary>>"))
    return records.withColumn("headers", F.concat(kept, own)).withColumn("topic", F.concat("topic", F.lit(".dlq"))).drop("reason")


def header(name: str) -> Column:
    return F.element_at(F.filter("headers", lambda h: h["key"] == name), -1)["value"].cast("string")


def read_dead_letters(log: DataFrame, start: int | None = None, end: int | None = None, limit: int = 100_000) -> DataFrame:
    """In order of partition and offset; raises rather than cuts off."""
    if start is not None:
        log = log.where(F.col("offset") >= start)
    if end is not None:
        log = log.where(F.col("offset") < end)
    if log.limit(limit + 1).count() > limit:
        raise TooMany(f"more than {limit} dead letters")
    return log.orderBy("partition", "offset")


def order_violations(log: DataFrame, arrival: str) -> DataFrame:
    """Records whose offset isn't above that of the record that arrived before it in its partition."""
    w = W.partitionBy("topic", "partition").orderBy(arrival)
    return log.withColumn("previous", F.lag("offset").over(w)).where(F.col("offset") <= F.col("previous"))


def gaps(log: DataFrame, span: int = 100_000) -> DataFrame:
    """Missing offsets: topic, partition, after, before, missing. Offsets are put in order by ranges of so many, and then the ranges among themselves."""
    part = ["topic", "partition"]
    rows = log.select(*part, "offset", F.floor(F.col("offset") / span).alias("_span"))
    near = F.lag("offset").over(W.partitionBy(*part, "_span").orderBy("offset"))
    ends = rows.groupBy(*part, "_span").agg(F.max("offset").alias("_end"))
    ends = ends.withColumn("_far", F.lag("_end").over(W.partitionBy(*part).orderBy("_span"))).drop("_end")
    out = rows.withColumn("_near", near).join(ends, [*part, "_span"]).select(*part, F.coalesce("_near", "_far").alias("after"), F.col("offset").alias("before"))
    return out.where(F.col("before") - F.col("after") > 1).withColumn("missing", F.col("before") - F.col("after") - 1)
