"""Related rows packed into structs and arrays, and joins that check."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.plans.spec import Relation, TableSpec
from millrace.sources.files import shared_folder


def preload(df: DataFrame, relation: Relation, other: DataFrame) -> DataFrame:
    """The related row as a struct (null if none), or the related rows as an array (empty if none), by their columns' order."""
    packed = other.select(F.col(f"`{relation.foreign}`").alias("_key"), F.struct(*[F.col(f"`{c}`") for c in other.columns]).alias(relation.name))
    if relation.many:
        packed = packed.groupBy("_key").agg(F.array_sort(F.collect_list(relation.name)).alias(relation.name))
    out = df.join(packed, df[relation.local] == packed["_key"], "left").drop("_key")
    if relation.many:
        out = out.withColumn(relation.name, F.coalesce(relation.name, F.array().cast(out.schema[relation.name].dataType)))
    return out


def preload_paths(df: DataFrame, spec: TableSpec, paths: list[str] | None, load: Callable[[str], DataFrame], specs: dict[str, TableSpec], defaults: tuple[str, ...] = ()) -> DataFrame:
    """Relations by path (`nation.region`). No list: the defaults; [""]: none; unknown paths are left out."""
    for path in defaults if paths is None else [p for p in paths if p]:
        first, _, rest = path.partition(".")
        relation = next((r for r in spec.relations if r.name.lower() == first.replace("_", "").lower() or r.name == first), None)
        if relation is None:
            continue
        other = load(relation.table)
        if rest and relation.table in specs:
            other = preload_paths(other, specs[relation.table], [rest], load, specs)
        df = preload(df, relation, other)
    return df


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows whose key is set and has no parent."""
    keys = parent.select(F.col(parent_key).alias("_parent"))
    return child.where(F.col(child_key).isNotNull()).join(keys, F.col(child_key) == F.col("_parent"), "left_anti")


def differing(key: str, columns: list[str], want: DataFrame, have: DataFrame) -> DataFrame:
    """Keys whose rows differ: key, state (missing, extra, changed), columns that differ, comma-joined."""
    w = want.select(F.col(key).alias("_k"), F.struct(*columns).alias("_w"))
    h = have.select(F.col(key).alias("_h"), F.struct(*columns).alias("_o"))
    both = w.join(h, w["_k"] == h["_h"], "full_outer")
    state = F.when(F.col("_h").isNull(), "missing").when(F.col("_k").isNull(), "extra")
    diff: list[Column] = [F.when(~F.col(f"_w.{c}").eqNullSafe(F.col(f"_o.{c}")), F.lit(c)) for c in columns]
    changed = F.array_join(F.filter(F.array(*diff), lambda x: x.isNotNull()), ",")
    out = both.select(F.coalesce("_k", "_h").alias(key), F.coalesce(state, F.when(changed != "", "changed")).alias("state"), F.when(state.isNull(), changed).otherwise("").alias("differs"))
    return out.where(F.col("state").isNotNull())


def in_sync(key: str, columns: list[str], source: DataFrame, replica: DataFrame) -> DataFrame:
    """One row: n_source, n_replica, missing, extra, changed, in_sync. Equal digests of equal numbers of rows end it early."""
    a, b = (digest(df, [key, *columns]) for df in (source, replica))
    if a.exceptAll(b).isEmpty():
        return a.select(F.col("n_rows").alias("n_source"), F.col("n_rows").alias("n_replica"), *[F.lit(0).cast("bigint").alias(c) for c in ("missing", "extra", "changed")], F.lit(True).alias("in_sync"))
    n = lambda state: F.count_if(F.col("state") == state).alias(state)
    found = differing(key, columns, source, replica).agg(n("missing"), n("extra"), n("changed"), (F.count("*") == 0).alias("in_sync"))
    sizes = a.select(F.col("n_rows").alias("n_source"), F.lit(1).alias("_one")).join(b.select(F.col("n_rows").alias("n_replica"), F.lit(1).alias("_one")), "_one")
    return sizes.join(found.withColumn("_one", F.lit(1)), "_one").drop("_one")  # a row each


def ancestry(df: DataFrame, key: str, parent: str, name: str) -> DataFrame:
    """df(key, parent, name) with parent_name, root and depth of each row of a forest; a row for each chain of rows from it to a root.

    Each round joins what is known of a row's chain to what is known from its end on, so chains double and there are as many
    rounds as the depth has binary digits; rows of a cycle, or below a parent that isn't there, belong to no tree and have
    no root and depth. What a round finds is written and read: plans that go on from round to round carry constraints that
    double with each.
    """
    path = f"{shared_folder(df.sparkSession)}/ancestry-{uuid.uuid4().hex}"
    rows = df.select(key, F.col(parent).alias("_up"), name)

    def split(chains: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
        chains.write.parquet(f"{path}/{n}")
        out = df.sparkSession.read.schema(chains.schema).parquet(f"{path}/{n}")
        return out.where("_at is null"), out.where("_at is not null")

    # the chain of a key's _n rows of one parent: its top so far, what stands above that (null at a root), its steps, and how many chains of rows it stands for
    known = ["_key", "_up", "_n", "_top", "_at", "_steps"]
    one = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key"), "_up").agg(F.count("*").cast("double").alias("_n"))
    new, going = split(one.select("_key", "_up", "_n", F.col("_key").alias("_top"), F.col("_up").alias("_at"), F.lit(0).cast("bigint").alias("_steps"), F.lit(1.0).alias("_chains")), n := 0)
    rooted = new
    while not new.isEmpty():  # each round finds all levels up to twice the depth; where it finds none, none are deeper
        above = rooted.union(going).select(F.col("_key").alias("_on"), F.struct("_top", "_at", "_steps", (F.col("_n") * F.col("_chains")).alias("_chains")).alias("_a"))
        longer = going.join(above, F.col("_at") == F.col("_on")).select("_key", "_up", "_n", "_a._top", "_a._at", (F.col("_steps") + F.col("_a._steps") + 1).alias("_steps"), (F.col("_chains") * F.col("_a._chains")).alias("_chains"))
        new, going = split(longer.groupBy(*known).agg(F.sum("_chains").alias("_chains")), n := n + 1)
        rooted = rooted.union(new)
    trees = rooted.select(F.col("_key").alias("_of"), F.col("_up").alias("_over"), "_top", "_steps", "_chains")
    parents = rows.select(F.col(key).alias("_key"), F.col("_up").alias("_above"), F.col(name).alias("parent_name"))
    parents = parents.join(trees, (F.col("_key") == F.col("_of")) & F.col("_above").eqNullSafe(F.col("_over")), "left").select("_key", "parent_name", "_top", "_steps", "_chains")
    top = F.col("_up").isNull()
    out = rows.join(parents, F.col("_up") == F.col("_key"), "left").withColumn("_each", F.explode(F.sequence(F.lit(1).cast("bigint"), F.coalesce(F.col("_chains").cast("bigint"), F.lit(1)))))
    return out.select(key, name, "parent_name", F.when(top, F.col(key)).otherwise(F.col("_top")).alias("root"), F.when(top, 0).otherwise(F.col("_steps") + 1).cast("int").alias("depth"))


def digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """A digest of the rows in any order: their number, the xor and the sum of their 64-bit hashes; no sort, one partial aggregate."""
    marked = [F.coalesce(F.col(c).cast("string"), F.lit("\x01null")) for c in sorted(columns)]
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *marked)), 1, 15), 16, 10).cast("bigint")
    return df.select(h.alias("h")).agg(F.count("*").alias("n_rows"), F.bit_xor("h").alias("xor_hash"), F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("sum_hash"))
