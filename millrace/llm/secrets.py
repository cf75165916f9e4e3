"""Secret scans (1), native: candidate values, and how many repositories and owners of the corpus hold each.

A value that many owners hold, in more repositories than owners' own values, is a widely copied example; any other is
owner-specific and looks live. Copies of a text count once, whoever holds them. Many owners are one in SHARE of the
corpus's, MANY at most; more repositories are more than nine in ten of the values of at most max_owners owners have.
Candidates are found with Java regular expressions; positions are code points, end exclusive, from the lengths of
matches and of what lies between them. Kinds of BASE are always reported. Those of MORE only if they look live and
overlap no base span. Values are compared by SHA-256 and never leave as text.

Nulls and empty texts: no spans. A null owner or repository counts as one of its own. Repeated rows are scanned
each for itself, and count once. No rows: no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.shared import one_name, scratch

#: Kind, pattern, the group that holds the value, least length of the value.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Formats of services' credentials.
MORE = (
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("google", r"AIza[A-Za-z0-9_-]{35,}", 0, 39),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 29),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+", 0, 60),
)
#: A copied value stands with one in SHARE of all owners, or with MANY.
SHARE, MANY = 4, 16
#: Copied values are broadcast up to this number; more are shuffled to the candidates.
BROADCAST_VALUES = 500_000
#: Values that one fold goes over: a fold copies what it has gathered at each step, so arrays are folded in slices.
SLICE = 256
#: Code points of a piece of a text that is cut.
CUT = 1000
_SPAN = "array<struct<s:bigint,rank:int,kind:string,e:bigint,hash:string>>"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value made once a row: within a function over an array it would be made for each element."""
    return F.transform(F.array(value), use)[0]


def before(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Of array<bigint> what op makes of 0 and all values before each, in slices and then among the slices."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("all"))
    step = lambda value: lambda acc, x: F.struct(op(acc["at"], value(x)).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all"))

    def run(v: Column) -> Column:
        slices = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / SLICE).cast("int")), lambda i: F.slice(v, i * SLICE + 1, F.lit(SLICE)))
        own = F.transform(slices, lambda part: F.aggregate(part, start, step(lambda x: x)))
        return once(own, lambda o: F.flatten(F.zip_with(o, F.aggregate(o, start, step(lambda x: x["at"]))["all"], lambda part, base: F.transform(part["all"], lambda x: op(base, x)))))

    return once(values, lambda v: F.when(F.size(v) > 0, run(v)).otherwise(F.array().cast("array<bigint>")))


def spans(text: Column, kind: str, rank: int, pattern: str, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches whose value has the least length, as structs of start, rank, kind, end, hash."""
    hits = lambda group: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    def placed(found: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(found)), lambda x: F.length(x).cast("bigint"))
        lengths = F.zip_with(gaps, found, lambda gap, hit: F.struct(gap.alias("gap"), F.length(hit).cast("bigint").alias("hit")))
        return once(lengths, lambda x: F.zip_with(x, before(F.transform(x, lambda y: y["gap"] + y["hit"]), lambda a, b: a + b), lambda y, past: F.struct((past + y["gap"]).alias("s"), (past + y["gap"] + y["hit"]).alias("e"))))

    def full(found: Column) -> Column:
        one = lambda p, v: F.struct(p["s"].alias("s"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), p["e"].alias("e"), F.when(F.length(v) >= least, F.sha2(v, 256)).alias("hash"))
        return F.filter(F.zip_with(placed(found), hits(group) if group else found, one), lambda x: x["hash"].isNotNull())

    return once(hits(0), lambda found: F.when(F.size(found) > 0, full(found)).otherwise(F.array()).cast(_SPAN))


def scan(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_col: str) -> DataFrame:
    """A written table of one row a document: row, doc_id, owner, repo, base and more spans, and the digest of a text that has any."""
    d = one_name(docs, {"doc_id": id_col, "text": text_col, "owner": owner_col, "repo": repo_col})
    text = F.coalesce("text", F.lit(""))
    base = F.array_sort(F.concat(*[spans(text, k, i, p, g, n) for i, (k, p, g, n) in enumerate(BASE)]))
    more = F.concat(*[spans(text, k, i + len(BASE), p, g, n) for i, (k, p, g, n) in enumerate(MORE)])
    d = d.select(F.monotonically_increasing_id().alias("row"), "doc_id", "owner", "repo", "text", base.alias("base"), more.alias("more"))
    return scratch(d.withColumn("text", F.when(F.expr("size(base) > 0 or size(more) > 0"), F.sha2("text", 256))), "spans")


def frequency(candidates: DataFrame) -> DataFrame:
    """candidates(hash, text, owner, repo) -> (hash, repos, owners): distinct ones, pre-aggregated so that no hash is hot.

    A text counts for the first of its owners and repositories, however many copies of it there are."""
    texts = candidates.groupBy("hash", "text").agg(F.min(F.struct("owner", "repo")).alias("at"))
    repos = texts.groupBy("hash", "at.owner", "at.repo").agg(F.lit(1).alias("one"))
    owners = repos.groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    return owners.groupBy("hash").agg(F.sum("repos").alias("repos"), F.count("*").alias("owners"))


def copied(counts: DataFrame, all_owners: int, max_owners: int) -> Column:
    """Whether a value of counts(hash, repos, owners), written, is a widely copied example, by both of its counts."""
    many = max(max_owners + 1, min(MANY, -(-all_owners // SHARE)))
    usual = counts.where(F.col("owners") <= max_owners).agg(F.percentile("repos", F.lit(0.9))).first()[0]
    return (F.col("owners") >= many) & (F.col("repos") > F.lit(usual or 0.0))


def apart(each: DataFrame) -> DataFrame:
    """each(row, span, ...) without MORE spans that overlap a base span of their row: none that starts before ends behind their start, and none starts within."""
    own = W.partitionBy("row")
    base = F.col("span.rank") < len(BASE)
    at = each.withColumns({"_s": F.col("span.s"), "_from": F.when(base, F.col("span.s")), "_to": F.when(base, F.col("span.e"))})
    at = at.withColumn("_held", F.max("_to").over(own.orderBy("_s").rangeBetween(W.unboundedPreceding, 0)))
    at = at.withColumn("_next", F.min("_from").over(own.orderBy(F.desc("_s")).rangeBetween(W.unboundedPreceding, 0)))
    free = ~(F.coalesce(F.col("_held") > F.col("_s"), F.lit(False)) | F.coalesce(F.col("_next") < F.col("span.e"), F.lit(False)))
    return at.where(base | free).select(*each.columns)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", max_owners: int = 1) -> DataFrame:
    """One row a document: row, doc_id, text (its digest), base and spans (arrays of s, rank, kind, e, hash, by start and kind), n_live, n_copied.

    n_live and n_copied count its spans whose value is not, or is, a widely copied example; one that at most max_owners
    owners hold never is. MORE spans that are copied or that overlap a base span are in neither.
    """
    table = scan(docs, id_col, text_col, owner_col, repo_col)
    each = table.where("size(base) > 0 or size(more) > 0").select("row", "text", "owner", "repo", F.explode(F.concat("base", "more")).alias("span"))
    each = scratch(apart(each).withColumn("hash", F.col("span.hash")), "candidates")
    counts = scratch(frequency(each), "counts")
    examples = scratch(counts.where(copied(counts, table.select("owner").distinct().count(), max_owners)).select("hash", F.lit(True).alias("example")), "examples")
    few = examples.count() <= BROADCAST_VALUES
    judged = each.join(F.broadcast(examples) if few else examples, "hash", "left").withColumn("live", F.isnull("example"))
    extra = F.col("span.rank") >= len(BASE)
    by_row = judged.groupBy(F.col("row").alias("of")).agg(
        F.collect_list(F.when(extra & F.col("live"), F.col("span"))).alias("added"),
        F.count_if("live").alias("n_live"),
        F.count_if(~F.col("live") & ~extra).alias("n_copied"),
    )
    out = table.join(by_row, F.col("row") == F.col("of"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    every = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(_SPAN))))
    return out.select("row", "doc_id", "text", "base", every.alias("spans"), zero("n_live"), zero("n_copied"))


def joined(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def digest(found: DataFrame) -> DataFrame:
    n = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *[n(k) for k, *_ in BASE], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), "n_live", "n_copied")


def redact(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", mark: str = "[SECRET]", **how: object) -> DataFrame:
    """The same rows and columns, every span of the text replaced by the mark; overlapping spans by one.

    Spans follow from the text and the values' counts, so rows of one id and text have the same, and are joined by both:
    rows of one id, or of none, with other texts have their own. Rows without spans come through as they are.
    """
    found = find_secrets(docs, id_col, text_col, **how).where("size(spans) > 0")
    found = found.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), F.col("spans").alias("_spans")).dropDuplicates(["_id", "_text"])
    text = F.col(f"`{text_col}`")
    held = before(F.transform("_spans", lambda x: x["e"]), F.greatest)  # where what stands before a span ends
    gaps = F.filter(F.zip_with(held, "_spans", lambda a, x: F.struct(a.alias("s"), x["s"].alias("e"))), lambda g: g["e"] >= g["s"])
    tail = F.array(F.struct(F.array_max(F.transform("_spans", lambda x: x["e"])).alias("s"), F.length(text).cast("bigint").alias("e")))
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))
    kept = once(pieces, lambda p: F.array_join(F.transform(F.concat(gaps, tail), lambda g: cut(p, g["s"], g["e"])), mark))
    joined_ = docs.join(found, F.col(f"`{id_col}`").eqNullSafe(F.col("_id")) & F.sha2(text, 256).eqNullSafe(F.col("_text")), "left")
    return joined_.withColumn(text_col, F.when(F.col("_spans").isNull(), text).otherwise(kept)).select(*[F.col(f"`{c}`") for c in docs.columns])


def cut(pieces: Column, start: Column, end: Column) -> Column:
    """Code points start to end of a text that stands in pieces of CUT each."""
    first, last = F.floor(start / CUT).cast("int"), F.floor((end - 1) / CUT).cast("int")
    part = lambda x, i: F.substring(x, F.greatest(start - (first + i) * CUT, F.lit(0)).cast("int") + 1, F.least(end - (first + i) * CUT, F.lit(CUT)).cast("int") - F.greatest(start - (first + i) * CUT, F.lit(0)).cast("int"))
    return F.when(end > start, F.array_join(F.transform(F.slice(pieces, first + 1, last - first + 1), part), "")).otherwise("")
