"""Structured filters: a JSON-shaped list of terms becomes one Column, so Catalyst pushes it down."""

from __future__ import annotations

import base64
import json
import re
import unicodedata
from collections.abc import Callable
from functools import reduce
from operator import and_, or_
from typing import Any
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, TimestampType

from millrace.operators import dates
from millrace.plans.spec import TableSpec

COMPARE = ("equal", "notEqual", "gt", "gte", "lt", "lte", "before", "after")
TEXT = ("contains", "notContains", "startsWith", "endsWith")
Custom = Callable[[DataFrame, Any], Column]


class FilterError(ValueError):
    """A term that can't be compiled."""


class UnknownField(FilterError):
    """A field that the table doesn't have."""


def normalize_field(name: str) -> str:
    """camelCase to snake_case; everything but letters, digits and _ becomes _, runs of which are one."""
    snake = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name).lower()
    return re.sub(r"_+", "_", re.sub(r"[^a-z0-9_]", "_", snake)).strip("_")


def clean_value(value: Any) -> Any:
    """Text in NFC; NUL and lone surrogates are refused."""
    if isinstance(value, str):
        if "\x00" in value or any(0xD800 <= ord(c) < 0xE000 for c in value):
            raise FilterError("unsafe text")
        return unicodedata.normalize("NFC", value)
    if isinstance(value, list | tuple):
        return [clean_value(v) for v in value]
    if isinstance(value, dict):
        return {k: clean_value(v) for k, v in value.items()}
    return value


def _list(value: Any) -> list:
    if not isinstance(value, list) or any(v is None for v in value):
        raise FilterError("a list without nulls is needed")
    return value


def _bounds(value: Any) -> tuple[Any, Any]:
    lo, hi = (value.get("from"), value.get("to")) if isinstance(value, dict) else value if isinstance(value, list | tuple) and len(value) == 2 else (None, None)
    if lo is None or hi is None:
        raise FilterError("a range needs both bounds")
    return lo, hi


def tokens(col: Column) -> Column:
    return F.filter(F.split(F.lower(col.cast("string")), r"\W+"), lambda x: x != "")


def _plain(col: Column, mode: str, value: Any) -> Column:
    text = col.cast("string")
    table: dict[str, Callable[[], Column]] = {
        "equal": lambda: col == value, "notEqual": lambda: col != value, "gt": lambda: col > value, "gte": lambda: col >= value,
        "lt": lambda: col < value, "lte": lambda: col <= value, "before": lambda: col < value, "after": lambda: col > value,
        "contains": lambda: text.contains(str(value)), "notContains": lambda: ~text.contains(str(value)),
        "startsWith": lambda: text.startswith(str(value)), "endsWith": lambda: text.endswith(str(value)),
    }
    return table[mode]()


def _temporal(col: Column, kind: str, data_type: str, mode: str, value: Any, tz: str | None, instant: bool) -> Column | None:
    """None if the value is no date or clock: it is then compared as it is."""
    if data_type == "time":
        read = lambda v: dates.parse_clock(v, tz)
        test = lambda p, m: _plain(dates.clock_of(col, kind, p[1]), m, p[0])
    else:
        read = lambda v: dates.parse(v, tz)
        test = lambda p, m: dates.condition(col, kind, m, p, instant)
    if mode in COMPARE:
        return test(p, mode) if (p := read(value)) else None
    if mode == "range":
        lo, hi = map(read, _bounds(value))
        return test(lo, "gte") & test(hi, "lte") if lo and hi else None
    if mode in ("inside", "outside") and value:
        parsed = [read(v) for v in _list(value)]
        if not all(parsed):
            return None
        hit = reduce(or_, (test(p, "equal") for p in parsed))
        return hit if mode == "inside" else ~hit
    return None


def compile_term(df: DataFrame, spec: TableSpec, term: dict, tz: str | None = None) -> Column:
    """Raises FilterError for a term that means nothing, UnknownField for a column that isn't there."""
    mode, value = term.get("mode", "equal"), term.get("value")
    if mode == "custom":
        made = term["custom"](df, value) if callable(term.get("custom")) else None
        if made is None:
            raise FilterError("a custom filter needs a function that gives a condition")
        return made
    name = term.get("field") or ""
    if mode == "search" and not name:
        texts = [F.col(f"`{f.name}`") for f in df.schema.fields if isinstance(f.dataType, StringType)]
        return F.arrays_overlap(tokens(F.concat_ws(" ", *texts)), tokens(F.lit(clean_value(str(value)))))
    name = name if name in df.columns else normalize_field(name)
    if name not in df.columns:
        raise UnknownField(name)
    col = F.col(f"`{name}`")
    if mode == "isEmpty":
        return col.isNull() | (col.cast("string") == "")
    if mode == "isNotEmpty":
        return col.isNotNull() & (col.cast("string") != "")
    if value is None:
        raise FilterError(f"{mode} needs a value")
    value = clean_value(value)
    of = df.schema[name].dataType
    kind = spec.kind(name, of)
    if term.get("dataType") in ("date", "time") and kind:
        made = _temporal(col, kind, term["dataType"], mode, value, term.get("timezone") or tz, isinstance(of, TimestampType))
        if made is not None:
            return made
    if mode in COMPARE or mode in TEXT:
        return _plain(col, mode, value)
    if mode == "inside":
        return col.isin(_list(value)) if _list(value) else F.lit(False)
    if mode == "outside":
        return ~col.isin(_list(value)) if _list(value) else F.lit(True)
    if mode == "range":
        lo, hi = _bounds(value)
        return col.between(lo, hi)
    if mode == "search":
        return F.arrays_overlap(tokens(col), tokens(F.lit(str(value))))
    raise FilterError(f"unknown mode {mode}")


def compile_filter(df: DataFrame, spec: TableSpec, request: dict | None, strict: bool = True) -> Column:
    """All terms joined by the request's logic (AND unless OR). Not strict: terms of unknown fields are left out."""
    made = []
    for term in (request or {}).get("filters") or []:
        try:
            made.append(compile_term(df, spec, term, (request or {}).get("timezone")))
        except UnknownField:
            if strict:
                raise
    if not made:
        return F.lit(True)
    return reduce(or_ if str(request.get("logic") or "").upper() == "OR" else and_, made)


def apply(df: DataFrame, spec: TableSpec, scope: dict | None = None, request: dict | None = None) -> DataFrame:
    """The caller's fixed scope and the request's own filter: a request can't leave the scope."""
    return df.where(compile_filter(df, spec, scope, True)).where(compile_filter(df, spec, request, False))


def from_request(query: dict[str, str]) -> dict:
    """filter and sort of a query string: URL-escaped base64 of JSON. No filter is an empty AND; a sort replaces the filter's."""

    def decode(text: str) -> Any:
        raw = unquote(text)
        return json.loads(base64.b64decode(raw + "=" * (-len(raw) % 4)))

    out = decode(query["filter"]) if query.get("filter") else {"filters": [], "logic": "AND"}
    if query.get("sort"):
        out["sortFields"] = decode(query["sort"])
    for s in out.get("sortFields") or []:
        s["order"] = s["order"] if s.get("order") in ("asc", "desc") else "asc"
    return out
