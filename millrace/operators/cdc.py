"""Change data capture on DataFrames: envelopes are decoded, records classified, changes folded by key and merged.

Every record's value and key are parsed once, to a variant, and columns are read from it with their JSON types. The
result is what applying the changes one at a time would leave. Changes of a key are judged in the order of their offsets,
from the stored row: a newer stored version stays, a delete ends the row, a delete without a version is ordered by the
stream alone. With log positions (lsn) the highest wins, deletes included, and the fold is one max_by, which Spark
aggregates before it shuffles, so a hot key costs one row a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DataType, DateType, DecimalType, DoubleType, FloatType, IntegralType, StringType, TimestampType

from millrace.plans.spec import TableSpec

#: Fixed value: what stands in place of a large column that didn't change.
UNAVAILABLE = "__debezium_unavailable_value"
KINDS = ("change", "tombstone", "truncate", "unsupported", "dead")
#: Texts that stand for true and false.
TRUE, FALSE = ("1", "t", "T", "TRUE", "true", "True"), ("0", "f", "F", "FALSE", "false", "False")
_INSTANT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"


def get(json: Column, *path: str, as_type: str = "variant") -> Column:
    """What stands at a path of a variant; null if nothing does, or nothing of the type."""
    return F.try_variant_get(json, "$" + "".join(f"[{name!r}]" for name in path), as_type)


def text_of(json: Column, *path: str) -> Column:
    """The text at a path, if it is a JSON string."""
    x = get(json, *path)
    return F.when(F.schema_of_variant(x) == "STRING", get(json, *path, as_type="string"))


def fenced(df: DataFrame, columns: list[str]) -> DataFrame:
    """The same rows. Conditions on these columns aren't moved below it, where they would parse the records again."""
    return df.select(*[c for c in df.columns if c not in columns], F.inline(F.array(F.struct(*columns))))


def decode_envelope(log: DataFrame) -> DataFrame:
    """Adds op, schema_name, table_name, lsn, poison and tombstone, and before and after (variants).

    A value is the event, or has it under "payload". Keys that stand twice in an object make it poison.
    """
    d = log.withColumn("_value", F.try_parse_json("value"))
    d = d.withColumn("_body", F.when(get(F.col("_value"), "op").isNotNull(), F.col("_value")).otherwise(get(F.col("_value"), "payload")))
    body = F.col("_body")
    names = {
        "op": text_of(body, "op"), "before": get(body, "before"), "after": get(body, "after"), "schema_name": text_of(body, "source", "schema"),
        "table_name": text_of(body, "source", "table"), "lsn": get(body, "source", "lsn", as_type="bigint"),
    }
    d = d.withColumns(names).drop("_value", "_body")
    empty = F.col("value").isNull() | (F.col("value") == "")
    d = d.withColumns({"tombstone": empty, "poison": ~empty & (F.col("op").isNull() | (F.col("op") == ""))})
    return fenced(d, [*names, "tombstone", "poison"])


def decode_value(kind: Column, raw: Column, of: DataType, json_column: bool = False) -> Column:
    """A JSON value of a kind (as schema_of_variant names it), with its text, to the type; null where it doesn't fit."""
    text, whole, number = kind == "STRING", kind == "BIGINT", kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    nested = kind.rlike("^(OBJECT|ARRAY)")
    if isinstance(of, DateType):
        return F.when(whole, F.date_from_unix_date(raw.try_cast("int")))
    if isinstance(of, TimestampType):
        return F.when(text & raw.rlike(_INSTANT), F.try_to_timestamp(raw))
    if isinstance(of, BinaryType):
        return F.when(text, F.try_to_binary(raw, F.lit("base64")))
    if isinstance(of, BooleanType):
        return F.when((kind == "BOOLEAN") | text, F.when(raw.isin(*TRUE), True).when(raw.isin(*FALSE), False)).when(whole, raw != "0")
    if isinstance(of, IntegralType):
        return F.when((whole | text | kind.rlike(r"^DECIMAL\(\d+,0\)$")) & raw.rlike(r"^[+-]?\d+$"), raw.try_cast(of))
    if isinstance(of, FloatType | DoubleType | DecimalType):
        return F.when(number | text, raw.try_cast(of))
    if json_column:
        return raw
    return F.when(~nested, raw)


def decode_rows(d: DataFrame, images: dict[str, Column], spec: TableSpec) -> DataFrame:
    """Adds for each image (a variant of a row) `<name>_row`, a struct of the spec's columns, null without a row, and
    `<name>_bad`, the names of columns that don't decode. Unknown columns are ignored, missing ones are null."""
    fields = spec.schema.fields
    at = {(n, f.name): f"_{n}_{i}" for n in images for i, f in enumerate(fields)}
    d = d.withColumns({f"_{n}": c for n, c in images.items()})
    d = d.withColumns({at[n, f.name]: get(F.col(f"_{n}"), f.name) for n in images for f in fields})
    d = d.withColumns({f"{c}{end}": x for c in at.values() for end, x in (("k", F.schema_of_variant(c)), ("t", F.try_variant_get(c, "$", "string")))})
    decoded, wrong = {}, {}
    for n in images:
        for f in fields:
            kind, raw = F.col(f"{at[n, f.name]}k"), F.col(f"{at[n, f.name]}t")
            decoded[f"{at[n, f.name]}v"] = decode_value(kind, raw, f.dataType, spec.kinds.get(f.name) == "json")
            value = F.col(f"{at[n, f.name]}v")
            text = kind == "STRING"
            refused = (kind != "VOID") & value.isNull() | text & (raw == UNAVAILABLE)
            if isinstance(f.dataType, StringType):
                refused = refused | text & F.contains(raw, F.char(F.lit(0)))
            wrong[n, f.name] = F.when(refused, F.lit(f.name))
    d = d.withColumns(decoded)
    out = {}
    for n in images:
        out[f"{n}_row"] = F.when(F.col(f"_{n}").isNotNull() & ~F.is_variant_null(f"_{n}"), F.struct(*[F.col(f"{at[n, f.name]}v").alias(f.name) for f in fields]))
        out[f"{n}_bad"] = F.filter(F.array(*[wrong[n, f.name] for f in fields]), lambda x: x.isNotNull())
    d = d.withColumns(out)
    own = [f"_{n}" for n in images] + [f"{c}{end}" for c in at.values() for end in ("", "k", "t", "v")]
    return fenced(d.drop(*own), list(out))


def classify(log: DataFrame, spec: TableSpec, source_schema: str | None = None) -> DataFrame:
    """Adds kind, reason, is_delete, row, row_key, version. A reason has names of columns, never their values."""
    d = decode_envelope(log).withColumn("_parsed", F.try_parse_json("key"))
    parsed = F.col("_parsed")
    key = F.when(get(parsed, spec.id_col).isNull() & get(parsed, "payload").isNotNull(), get(parsed, "payload")).otherwise(parsed)
    d = decode_rows(d, {"new": F.col("after"), "old": F.col("before"), "key": key}, spec).drop("_parsed")
    d = d.withColumn("is_delete", F.col("op") == "d")
    id_of = lambda r: F.col(r)[spec.id_col]
    full_old = F.col("old_row").isNotNull() & (F.size("old_bad") == 0) & id_of("old_row").isNotNull()
    d = d.withColumn("row", F.when(F.col("is_delete"), F.when(full_old, F.col("old_row")).otherwise(F.col("key_row"))).otherwise(F.col("new_row")))
    version = F.col("row")[spec.version_col].cast("bigint") if spec.version_col else F.lit(None).cast("bigint")
    d = d.withColumns({"row_key": id_of("row").cast("string"), "version": F.when(F.col("is_delete") & ~full_old, F.lit(None)).otherwise(version)})
    no_key = F.col("row_key").isNull() | F.col("row_key").isin("", "0")
    foreign = F.col("table_name").isNotNull() & (F.col("table_name") != spec.name)
    if source_schema:
        foreign = foreign | (F.col("schema_name") != source_schema)
    known = F.col("op").isin("c", "u", "r", "d")
    reason = (
        F.when(F.col("tombstone"), F.lit(None))
        .when(F.col("poison"), F.lit("not a change event"))
        .when(foreign, F.lit("of another table"))
        .when(known & ~F.col("is_delete") & F.col("new_row").isNull(), F.lit("no row"))
        .when(known & ~F.col("is_delete") & (F.size("new_bad") > 0), F.concat(F.lit("columns: "), F.array_join("new_bad", ",")))
        .when(known & no_key, F.lit("no key"))
    )
    kind = F.when(F.col("tombstone"), "tombstone").when(F.col("reason").isNotNull(), "dead").when(F.col("op") == "t", "truncate").when(~known, "unsupported").otherwise("change")
    d = d.withColumn("reason", reason).withColumn("kind", kind).drop("new_row", "new_bad", "old_row", "old_bad", "key_row", "key_bad")
    return fenced(d, ["row", "row_key", "version", "is_delete", "reason", "kind"])


def violations(checks: dict[str, str]) -> Column:
    """Names of the checks (SQL conditions) that a row breaks; null counts as kept."""
    return F.filter(F.array(*[F.when(~F.expr(c), F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull()) if checks else F.array().cast("array<string>")


def survivors(changes: DataFrame, stored: DataFrame, spec: TableSpec) -> DataFrame:
    """changes(row_key, offset, is_delete, version[, lsn]) on stored(columns) -> row_key, offset, kept: which changes take effect.

    Stored null versions are oldest; an incoming null loses to any stored value; equal versions: the incoming wins.
    Where the spec goes by position, one with an lsn always takes effect: claim() and in_position() have judged it.
    A key's changes come to one task in order, after its stored row, one batch at a time; only its version is kept between them.
    """
    version = lambda c: (c.isNotNull().alias("has"), F.coalesce(c, F.lit(0)).cast("bigint").alias("v"))
    keys = changes.select("row_key").distinct()
    held = F.col(spec.version_col).cast("bigint") if spec.version_col else F.lit(None).cast("bigint")
    have = stored.select(F.col(spec.id_col).cast("string").alias("row_key"), F.lit(-1).cast("bigint").alias("offset"), F.lit(False).alias("gone"), *version(held), F.lit(True).alias("held"), F.lit(False).alias("placed"))
    placed = F.col("lsn").isNotNull() if spec.by_position else F.lit(False)
    rows = changes.select("row_key", F.col("offset").cast("bigint").alias("offset"), F.col("is_delete").alias("gone"), *version(F.col("version")), F.lit(False).alias("held"), placed.alias("placed"))
    # dealt by a value that neither side is dealt by: by row_key itself Spark may take the union for dealt already and then read its sides in unlike parts
    rows = rows.union(have.join(keys, "row_key", "left_semi")).repartition(F.xxhash64("row_key")).sortWithinPartitions("row_key", F.desc("held"), "offset")
    versioned = spec.version_col is not None

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, present, at = None, False, None
        for b in batches:
            kept = []
            for k, gone, has, v, held, placed in zip(b["row_key"], b["gone"], b["has"], b["v"], b["held"], b["placed"], strict=True):
                if k != key:
                    key, present, at = k, False, None
                guarded = versioned and not held and not placed and present and at is not None
                stale = guarded and (has and v != 0 and at > v if gone else not has or at > v)
                if not stale:
                    present, at = not gone, v if has and not gone else None
                kept.append(not stale)
            yield b.loc[~b["held"].to_numpy(bool), ["row_key", "offset"]].assign(kept=[x for x, h in zip(kept, b["held"], strict=True) if not h])

    return rows.mapInPandas(judge, "row_key string, offset long, kept boolean")


def fold(changes: DataFrame, stored: DataFrame, spec: TableSpec) -> DataFrame:
    """changes(row_key, offset, is_delete, version, row) on stored(columns) -> row_key, present, row, kept (surviving changes).

    row is that of the last surviving change (of a delete, its image or key), or the stored one if none survives.
    """
    by_key = survivors(changes, stored, spec).groupBy("row_key").agg(F.max(F.when(F.col("kept"), F.col("offset"))).alias("offset"), F.count_if("kept").alias("kept"))
    last = by_key.join(changes.select("row_key", F.col("offset").cast("bigint").alias("offset"), "is_delete", "row"), ["row_key", "offset"], "left")
    have = stored.select(F.col(spec.id_col).cast("string").alias("_k"), F.struct(*[f.name for f in spec.schema.fields]).alias("_stored"))
    both = last.join(have, F.col("row_key") == F.col("_k"), "left")
    some = F.col("kept") > 0
    return both.select("row_key", F.when(some, ~F.col("is_delete")).otherwise(F.col("_stored").isNotNull()).alias("present"), F.when(some, F.col("row")).otherwise(F.col("_stored")).alias("row"), "kept")


def feed(changes: DataFrame, stored: DataFrame, spec: TableSpec) -> DataFrame:
    """One event for each surviving change but those of snapshots: row_key, offset, event (created, updated, deleted), row."""
    kept = survivors(changes, stored, spec).where("kept").select("row_key", "offset")
    event = F.when(F.col("op") == "c", "created").when(F.col("op") == "u", "updated").when(F.col("op") == "d", "deleted")
    told = changes.where("op <> 'r'").withColumn("offset", F.col("offset").cast("bigint"))
    return told.join(kept, ["row_key", "offset"], "left_semi").select("row_key", "offset", event.alias("event"), "row")


def newest(changes: DataFrame, by_lsn: bool) -> DataFrame:
    """The last change of each key, by log position and offset, or by offset alone."""
    order = F.struct("lsn", "offset") if by_lsn else F.struct("offset")
    rest = [c for c in ("offset", "lsn", "is_delete", "version", "row") if c in changes.columns]
    return changes.groupBy("row_key").agg(F.max_by(F.struct(*rest), order).alias("last"), F.count("*").alias("changes")).select("row_key", "changes", "last.*")


def apply_rows(stored: DataFrame, result: DataFrame, spec: TableSpec) -> DataFrame:
    """result(row_key, present, row) put in place of the stored rows of its keys."""
    cols = sorted(f.name for f in spec.schema.fields)
    rest = stored.join(result.select("row_key"), F.col(spec.id_col).cast("string") == F.col("row_key"), "left_anti").select(*cols)
    return rest.unionByName(result.where("present").select(*[F.col(f"row.{c}").alias(c) for c in cols]))


def claim(incoming: DataFrame, state: DataFrame) -> DataFrame:
    """Of incoming(row_key, lsn, ...), those at or above the position that state(row_key, lsn) has for the key, or without one."""
    s = state.select(F.col("row_key").alias("_k"), F.col("lsn").alias("_lsn"))
    return incoming.join(s, F.col("row_key") == F.col("_k"), "left").where("_lsn is null or lsn is null or _lsn <= lsn").drop("_k", "_lsn")


def in_position(changes: DataFrame) -> DataFrame:
    """Of changes(row_key, offset, lsn, ...), those that no change of their key with a smaller offset is ahead of; without a position, all.

    With claim() before it, what claiming them one at a time would leave.
    """
    before = W.partitionBy("row_key").orderBy("offset").rowsBetween(W.unboundedPreceding, -1)
    return changes.withColumn("_ahead", F.max("lsn").over(before)).where("lsn is null or _ahead is null or _ahead <= lsn").drop("_ahead")


def row_states(changes: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """row_key, lsn, deleted, updated_at after changes(row_key, offset, lsn, is_delete, timestamp) on stored ones; a position never goes back."""
    now = changes.groupBy("row_key").agg(F.max("lsn").alias("lsn"), F.max_by("is_delete", "offset").alias("deleted"), F.max("timestamp").alias("updated_at"))
    if stored is None:
        return now
    held = stored.select(F.col("row_key").alias("_k"), F.col("lsn").alias("_lsn"))
    merged = now.join(held, F.col("row_key") == F.col("_k"), "left").select("row_key", F.greatest("lsn", "_lsn").alias("lsn"), "deleted", "updated_at")
    return merged.unionByName(stored.join(now, "row_key", "left_anti").select(*merged.columns))


def advance(log: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """(topic, partition, next_offset, last_record_at), never backwards."""
    now = log.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("next_offset"), F.max_by("timestamp", "offset").alias("last_record_at"))
    if stored is None:
        return now
    return now.unionByName(stored).groupBy("topic", "partition").agg(F.max("next_offset").alias("next_offset"), F.max_by("last_record_at", "next_offset").alias("last_record_at"))


def uncovered(log: DataFrame, checkpoints: DataFrame | None) -> DataFrame:
    """Records at or above the next offset of their partition; others were applied before."""
    if checkpoints is None:
        return log
    c = checkpoints.select(F.col("topic").alias("_t"), F.col("partition").alias("_p"), "next_offset")
    return log.join(c, (F.col("topic") == F.col("_t")) & (F.col("partition") == F.col("_p")), "left").where("next_offset is null or offset >= next_offset").drop("_t", "_p", "next_offset")


def regressions(log: DataFrame, checkpoints: DataFrame, minutes: int = 5) -> DataFrame:
    """Partitions whose covered records are dated more than so long after the last applied one: the log was made anew."""
    covered = log.join(checkpoints, ["topic", "partition"]).where("offset < next_offset")
    late = covered.groupBy("topic", "partition").agg(F.max("timestamp").alias("latest"), F.max("last_record_at").alias("last_record_at"))
    return late.where(F.col("latest") > F.col("last_record_at") + F.expr(f"interval {minutes} minutes"))


def prune_tombstones(state: DataFrame, now: Column, days: int = 14) -> DataFrame:
    return state.where(~(F.col("deleted") & (F.col("updated_at") < now - F.expr(f"interval {days} days"))))


def error_class(state: Column) -> Column:
    """Permanent, transient or neither, by SQLSTATE."""
    cls = F.substring(state, 1, 2)
    return F.when(cls.isin("22", "54") | state.isin("23502", "23514"), "permanent").when(state.isNull() | (state == "") | cls.isin("08", "25", "40", "53", "55", "57", "58", "XX"), "transient").otherwise("neither")


def backoff(attempts: Column, base: int = 30, cap: int = 3600) -> Column:
    """Seconds to the next attempt: doubling, capped."""
    return F.least(F.lit(cap).cast("double"), F.lit(base) * F.pow(F.lit(2.0), F.least(attempts, F.lit(30)))).cast("bigint")


def repair(parked: DataFrame, source: DataFrame, replica: DataFrame, spec: TableSpec) -> tuple[DataFrame, DataFrame]:
    """parked(row_key): the replica with the source's current rows of these keys, and the keys whose rows break a check."""
    cols = sorted(f.name for f in spec.schema.fields)
    keys = parked.select("row_key").distinct()
    key = F.col(spec.id_col).cast("string")
    now = source.withColumn("row_key", key).join(keys, "row_key", "left_semi").withColumn("_bad", violations(spec.checks))
    still = now.where(F.size("_bad") > 0).select("row_key", F.array_join("_bad", ",").alias("reason"))
    healed = keys.join(still, "row_key", "left_anti")
    rest = replica.withColumn("row_key", key).join(healed, "row_key", "left_anti").select(*cols)
    return rest.unionByName(now.where(F.size("_bad") == 0).select(*cols)), still


def missing_columns(spec: TableSpec, target: DataFrame) -> list[str]:
    """All columns of the spec that the target lacks."""
    return sorted({f.name for f in spec.schema.fields} - set(target.columns))


def equal_rows(cols: list[str], a: str, b: str) -> Column:
    return reduce(and_, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in cols])
