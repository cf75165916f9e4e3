"""Differences of schemas, tables aligned to a schema, and drift between two copies with the fix it needs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType


class Destructive(ValueError):
    """An alignment would lose data and wasn't allowed to."""


@dataclass(frozen=True)
class Change:
    """kind: added, dropped, renamed or changed. was, now: types; old: the name before, of a renamed column."""

    kind: str
    column: str
    was: DataType | None = None
    now: DataType | None = None
    old: str | None = None

    @property
    def destructive(self) -> bool:
        """Whether values may be lost: a column is dropped, or its type doesn't take all that the old one had."""
        return self.kind == "dropped" or self.kind == "changed" and not widens(self.was, self.now)

    @property
    def fix(self) -> str:
        if self.kind == "added":
            return f"ADD COLUMN {self.column} {self.now.simpleString()}"
        if self.kind == "dropped":
            return f"DROP COLUMN {self.column}"
        if self.kind == "renamed":
            return f"RENAME COLUMN {self.old} TO {self.column}"
        return f"ALTER COLUMN {self.column} TYPE {self.now.simpleString()}"


#: Numbers that each take all values of those before them; text takes everything.
_WIDER = ("tinyint", "smallint", "int", "bigint")


def widens(was: DataType, now: DataType) -> bool:
    a, b = was.simpleString(), now.simpleString()
    if a == b or b == "string" or (a, b) in (("float", "double"), ("date", "timestamp"), ("date", "timestamp_ntz")):
        return True
    if a in _WIDER and b in _WIDER:
        return _WIDER.index(a) <= _WIDER.index(b)
    return b == "double" and a in _WIDER[:3]


def diff(old: StructType, new: StructType) -> list[Change]:
    """What turns old into new. A dropped and an added column are one renamed if each is the only one of its type."""
    was, now = ({f.name: f.dataType for f in s.fields} for s in (old, new))
    gone, come = [c for c in was if c not in now], [c for c in now if c not in was]
    alone = lambda names, types, of: [c for c in names if types[c] == of]
    renamed = {c: alone(gone, was, now[c])[0] for c in come if len(alone(come, now, now[c])) == 1 and len(alone(gone, was, now[c])) == 1}
    out = [Change("renamed", c, now[c], now[c], old) for c, old in renamed.items()]
    out += [Change("added", c, now=now[c]) for c in come if c not in renamed]
    out += [Change("dropped", c, was=was[c]) for c in gone if c not in renamed.values()]
    return out + [Change("changed", c, was[c], now[c]) for c in was if c in now and was[c] != now[c]]


def align(df: DataFrame, schema: StructType, destructive: bool = False) -> DataFrame:
    """The rows in the shape of the schema: columns renamed, cast (null where a value doesn't fit), added as null, dropped."""
    changes = diff(df.schema, schema)
    lost = [c.fix for c in changes if c.destructive]
    if lost and not destructive:
        raise Destructive("; ".join(lost))
    old = {c.column: c.old for c in changes if c.kind == "renamed"}
    own = set(df.columns)
    return df.select(*[(F.col(f"`{old.get(f.name, f.name)}`").try_cast(f.dataType) if old.get(f.name, f.name) in own else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])


def drift(source: DataFrame, target: DataFrame) -> DataFrame:
    """One row a difference of the target from the source: column, kind, fix, destructive, n_values (what is at stake: the
    values that the column has on the side that has it)."""
    out = None
    for c in diff(target.schema, source.schema):
        side, name = (target, c.column) if c.kind in ("dropped", "changed") else (source, c.column)
        one = side.agg(F.count(f"`{name}`").alias("n_values")).select(F.lit(c.column).alias("column"), F.lit(c.kind).alias("kind"), F.lit(c.fix).alias("fix"), F.lit(c.destructive).alias("destructive"), "n_values")
        out = one if out is None else out.union(one)
    if out is None:
        return source.sparkSession.createDataFrame([], "column string, kind string, fix string, destructive boolean, n_values long")
    return out
