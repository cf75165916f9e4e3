from datetime import datetime

import pytest

from millrace.operators import dates, paging
from millrace.operators import filters as flt
from millrace.plans.spec import TableSpec

SPEC = TableSpec("ships", "id", default_sort=(("updated_at", "desc"),))
COLUMNS = ("id", "name", "class", "tons", "docked", "port", "crew")
ROWS = [
    (11, "Aurora", "ferry", 812.5, True, "Oslo", 14), (12, "albatross", "tug", 40.0, False, None, 3), (13, "50%_off", "barge", 0.0, True, "", None), (14, "Ålesund", "ferry", 990.0, False, "Bergen", 21),
    (15, "Mary's Hope", "tug", 40.0, True, "oslo", 3), (16, "B\\ack", "barge", -5.0, False, "Kiel", 0), (17, "Zephyr", "yacht", 12.25, True, None, None), (18, "aurora II", "yacht", 12.25, False, "Osloport", 6),
    (19, "Tern", "ferry", 400.0, True, "Kiel", 14), (20, "Ø", "tug", 0.0, False, "", 1), (21, "off_50%", "barge", 77.0, True, "Bergen", 9),
]


@pytest.fixture(scope="module")
def ships(spark):
    rows = [(*r, datetime(2024, 1, r[0])) for r in ROWS]
    return spark.createDataFrame(rows, "id long, name string, class string, tons double, docked boolean, port string, crew int, updated_at timestamp_ntz").cache()


def ids(df):
    return sorted(r.id for r in df.collect())


#: What a mode means for a value that may be None, in plain Python.
MEANS = {
    "equal": lambda v, x: v is not None and v == x, "notEqual": lambda v, x: v is not None and v != x, "gt": lambda v, x: v is not None and v > x, "gte": lambda v, x: v is not None and v >= x,
    "lt": lambda v, x: v is not None and v < x, "lte": lambda v, x: v is not None and v <= x, "contains": lambda v, x: v is not None and x in v, "notContains": lambda v, x: v is not None and x not in v,
    "startsWith": lambda v, x: v is not None and v.startswith(x), "endsWith": lambda v, x: v is not None and v.endswith(x), "inside": lambda v, x: v in x and v is not None,
    "outside": lambda v, x: not x or v is not None and v not in x, "range": lambda v, x: v is not None and x["from"] <= v <= x["to"], "isEmpty": lambda v, x: v in (None, ""), "isNotEmpty": lambda v, x: v not in (None, ""),
}


@pytest.mark.parametrize(
    ("field", "mode", "value"),
    [
        ("class", "equal", "tug"), ("name", "equal", "A\u030alesund"), ("tons", "equal", 0), ("crew", "notEqual", 14), ("port", "notEqual", "Kiel"), ("tons", "gt", 40), ("tons", "gte", 40), ("crew", "lt", 3), ("tons", "lte", 0),
        ("name", "contains", "0%_"), ("name", "contains", "\\"), ("port", "contains", "oslo"), ("name", "notContains", "a"), ("port", "notContains", "slo"), ("name", "startsWith", "a"), ("name", "startsWith", "_"), ("name", "endsWith", "%"),
        ("class", "inside", []), ("class", "inside", ["tug", "yacht"]), ("crew", "outside", []), ("crew", "outside", [14, 3]), ("tons", "range", {"from": 0, "to": 77}), ("port", "isEmpty", None), ("crew", "isNotEmpty", None),
    ],
)
def test_modes(ships, field, mode, value):
    import unicodedata

    x = unicodedata.normalize("NFC", value) if isinstance(value, str) else value
    want = [r[0] for r in ROWS if MEANS[mode](r[COLUMNS.index(field)], x)]
    request = {"filters": [{"field": field, "mode": mode, "value": value}]}
    assert ids(flt.apply(ships, SPEC, request)) == want
    assert paging.count(ships, SPEC, request).first().n == len(want)
    assert paging.exists(ships, SPEC, request).first().found == bool(want)
    walked, cursor = [], None
    while True:
        page = paging.paginate(ships, SPEC, request, 4, cursor)
        walked += [r.id for r in page.rows.collect()]
        cursor = page.next
        if not cursor:
            break
    assert sorted(walked) == want


def test_search_and_plain_text_of_a_date_field(ships):
    assert ids(flt.apply(ships, SPEC, {"filters": [{"mode": "search", "value": "kiel"}]})) == [16, 19]
    assert ids(flt.apply(ships, SPEC, {"filters": [{"field": "class", "mode": "equal", "value": "tug", "dataType": "date"}]})) == [12, 15, 20]


def test_request_sort_beats_scope_sort(ships):
    scope, request = {"sortFields": [{"field": "tons", "order": "asc"}]}, {"sortFields": [{"field": "crew", "order": "desc"}]}
    assert paging.paginate(ships, SPEC, request, 2, scope=scope).rows.first().id == 14
    assert paging.paginate(ships, SPEC, None, 2, scope=scope).rows.first().id == 16
    assert paging.find(ships, SPEC, None, 1, scope, lambda df: df.select("name")).first() == ("B\\ack",)
    assert paging.get_by_id(ships, SPEC, 20, lambda df: df.select("name")).first().name == "Ø"


def test_page_numbers_of_many_rows(spark):
    """Every row has one number, in the order, whatever columns come along and however many tie."""
    n = 400_000
    df = spark.range(n).selectExpr("id", "cast(hash(id) % 50 as int) AS score", "if(id % 11 = 0, null, cast(id % 7 as string)) AS tier", "repeat('x', 20) AS pad", "sha2(cast(id as string), 256) AS more").repartition(7)
    sort = [("score", "desc"), ("tier", "asc"), ("id", "desc")]
    got = paging.page_numbers(df, sort, 1000, buckets=24)
    row = got.selectExpr("count(*)", "count(distinct row_number)", "min(row_number)", "max(row_number)", "max(page)").first()
    assert tuple(row) == (n, n, 1, n, 400)
    want = df.selectExpr("id", "row_number() over (order by score desc nulls last, tier asc nulls last, id desc) AS w")
    assert got.join(want, "id").where("row_number <> w").isEmpty()


@pytest.mark.parametrize("term", [{"field": "name", "mode": "equal"}, {"field": "class", "mode": "inside", "value": [None]}, {"field": "crew", "mode": "range", "value": {"from": 1}}, {"field": "name", "mode": "nope", "value": 1}, {"mode": "custom"}, {"field": "name", "mode": "equal", "value": "a\x00"}])
def test_refused(ships, term):
    with pytest.raises(flt.FilterError):
        flt.compile_term(ships, SPEC, term)


def test_unknown_field(ships):
    bad = {"filters": [{"field": "nope", "mode": "equal", "value": 1}]}
    with pytest.raises(flt.UnknownField):
        flt.apply(ships, SPEC, bad)
    assert len(ids(flt.apply(ships, SPEC, None, bad))) == len(ROWS)


@pytest.mark.parametrize("order", ["asc", "desc"])
def test_walk_with_nulls_forward_and_back(ships, order):
    request = {"sortFields": [{"field": "crew", "order": order}, {"field": "class", "order": "asc"}]}
    sort = paging.total_order(ships, SPEC, request["sortFields"])
    want = [r.id for r in ships.orderBy(*paging.order_by(sort)).collect()]
    seen, cursor, back = [], None, None
    while True:
        page = paging.paginate(ships, SPEC, request, 3, cursor)
        seen.append([r.id for r in page.rows.collect()])
        cursor, back = page.next, page.previous
        if not cursor:
            break
    assert sum(seen, []) == want
    for i in range(len(seen) - 2, -1, -1):
        page = paging.paginate(ships, SPEC, request, 3, back)
        assert [r.id for r in page.rows.collect()] == seen[i]
        back = page.previous
    assert back is None


def test_cursor_of_another_order(ships):
    page = paging.paginate(ships, SPEC, {"sortFields": [{"field": "class", "order": "asc"}]}, 2)
    with pytest.raises(paging.InvalidCursor):
        paging.decode(page.next, [("id", "asc")])
    with pytest.raises(paging.InvalidCursor):
        paging.decode("not a cursor", [("id", "asc")])


@pytest.mark.parametrize(
    ("zone", "day", "lo", "hi"),
    [
        ("Asia/Manila", "2024-01-01", "2023-12-31 16:00:00", "2024-01-01 16:00:00"),
        ("America/New_York", "2024-03-10", "2024-03-10 05:00:00", "2024-03-11 04:00:00"),
        ("America/New_York", "2024-11-03", "2024-11-03 04:00:00", "2024-11-04 05:00:00"),
        ("+05:30", "2024-01-01", "2023-12-31 18:30:00", "2024-01-01 18:30:00"),
        (None, "2024-02-29", "2024-02-29 00:00:00", "2024-03-01 00:00:00"),
    ],
)
def test_days(zone, day, lo, hi):
    assert [str(x) for x in dates.parse(day, zone).bounds()] == [lo, hi]


@pytest.mark.parametrize("zone", ["EST", "Local", "+15:00", "-13", "Asia/Nowhere"])
def test_zones_refused(zone):
    with pytest.raises(dates.BadDate):
        dates.zone(zone)


@pytest.mark.parametrize(("text", "want"), [("03/04/2024", "2024-03-04"), ("13/04/2024", "2024-04-13"), ("3.4.2024", "2024-04-03"), ("3-4-2024", "2024-04-03"), ("2024/3/4", "2024-03-04"), ("03/04/24", None), ("2024-02-30", None)])
def test_layouts(text, want):
    assert str(dates.parse_day(text)) == str(want)
