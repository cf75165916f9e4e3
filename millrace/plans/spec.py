"""What the operators know about a table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql.types import ArrayType, DataType, DateType, DayTimeIntervalType, IntegralType, StructType, TimestampNTZType, TimestampType


@dataclass(frozen=True)
class Relation:
    """name: field that holds the related row or rows; local and foreign: key columns; many: several rows."""

    name: str
    table: str
    local: str
    foreign: str
    many: bool = False


@dataclass(frozen=True)
class TableSpec:
    """A table with one key column. kinds: column -> instant, date, timestamptz or clock, where its type doesn't tell.

    checks: name -> SQL condition that rows keep. by_position: a change that has a log position is judged by it alone, not by the row's version.
    """

    name: str
    id_col: str
    schema: StructType | None = None
    version_col: str | None = None
    default_sort: tuple[tuple[str, str], ...] = (("updated_at", "desc"),)
    kinds: dict[str, str] = field(default_factory=dict)
    relations: tuple[Relation, ...] = ()
    checks: dict[str, str] = field(default_factory=dict)
    by_position: bool = False

    def kind(self, column: str, of: DataType) -> str | None:
        if column in self.kinds:
            return self.kinds[column]
        if isinstance(of, DateType):
            return "date"
        return "timestamptz" if isinstance(of, TimestampType | TimestampNTZType) else None

    def validate(self) -> None:
        """Raises unless the table can be replicated: key and version columns there, no arrays, no ambiguous times."""
        if self.schema is None:
            raise ValueError(f"{self.name}: no schema")
        types = {f.name: f.dataType for f in self.schema.fields}
        if self.id_col not in types:
            raise ValueError(f"{self.name}: no key column {self.id_col}")
        if self.version_col and not isinstance(types.get(self.version_col), IntegralType | TimestampType):
            raise ValueError(f"{self.name}: version column {self.version_col} must be a whole number or a time")
        bad = [n for n, t in types.items() if isinstance(t, ArrayType | TimestampNTZType | DayTimeIntervalType)]
        if bad:
            raise ValueError(f"{self.name}: columns that can't be replicated: {', '.join(sorted(bad))}")
