"""Quotation linking (5), native: quoted passages of messages are joined to the messages that said them first.

A line's quote level is the number of ">" that it begins with (spaces between them don't count). A passage is a run
of lines of one level; an empty line or an attribution ("On ... wrote:") ends it. It is normalised (markers off, lower case,
white space to one space, trimmed) and hashed, as a whole and by its lines and sentences, if these have MIN_WORDS words. All
are joined to (conversation, hash) of whole bodies, paragraphs, lines and sentences of messages; each such key has one row,
that of the earliest turn. A passage that isn't found as a whole is of the turn that most of its lines and sentences are
found in, of equal ones the latest: so part of a paragraph, or lines wrapped anew, still link. A message replies to the
latest turn that its passages of the lowest level were found in, if that is before its own; else to the turn before it.

Rows with equal conversation and turn are messages of one turn. Null or empty texts have an empty body. A null
conversation or turn has no parent. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.shared import one_name, scratch

MARK = r"^([ \t]*>)+[ \t]?"
ATTRIBUTION = r"^[ \t]*On .+ wrote:[ \t]*$"
#: Turns whose order is found in one group; of larger conversations the groups are then put in order.
SPAN = 4096
#: Lines and sentences of fewer words than this aren't searched for alone.
MIN_WORDS = 3


def level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARK, 0), "[^>]", ""))


def norm(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+", -1)


def parse(messages: DataFrame) -> DataFrame:
    """messages(conv_id, turn, role, text) -> written table: row, conv_id, turn, role, body, max_level, quoted (line, level, text)."""
    text = F.coalesce("text", F.lit(""))
    lines = F.split(text, "\n", -1)
    # what stands before and after a quotation are two paragraphs
    own = F.array_join(F.transform(lines, lambda x: F.when((level(x) == 0) & ~x.rlike(ATTRIBUTION), x).otherwise("")), "\n")
    own = F.regexp_replace(F.regexp_replace(own, r"\n[ \t]*(\n[ \t]*)+(?=\n)", "\n"), r"^\s+|\s+$", "")
    bare = lambda x: F.regexp_replace(x, MARK, "")
    cited = F.filter(
        F.transform(lines, lambda x, i: F.struct(i.alias("line"), F.when(bare(x).rlike(ATTRIBUTION), 0).otherwise(level(x)).alias("level"), norm(bare(x)).alias("text"))),
        lambda x: (x["level"] > 0) & (x["text"] != ""),
    )
    has = text.contains(">") | text.contains(" wrote:")
    body = F.when(has, own).otherwise(F.trim(text))
    quoted = F.when(has, cited).otherwise(F.array().cast("array<struct<line:int,level:int,text:string>>"))
    d = messages.select(F.monotonically_increasing_id().alias("row"), "conv_id", "turn", "role", body.alias("body"), quoted.alias("quoted"))
    return scratch(d.withColumn("max_level", F.coalesce(F.array_max(F.transform("quoted", lambda x: x["level"])), F.lit(0))), "messages")


def passages(parsed: DataFrame) -> DataFrame:
    """(row, conv_id, turn, level, run, whole, hash): of each passage, the whole and its lines and sentences; the lines of
    one message are put in order together."""
    each = parsed.select("row", "conv_id", "turn", F.explode("quoted").alias("q")).select("row", "conv_id", "turn", "q.*")
    run = F.col("line") - F.row_number().over(W.partitionBy("row", "level").orderBy("line"))
    grouped = each.withColumn("run", run).groupBy("row", "conv_id", "turn", "level", "run")
    texts = grouped.agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]).alias("lines"))
    texts = texts.withColumn("said", F.array_join("lines", " "))
    parts = F.filter(F.array_except(F.concat("lines", sentences(F.col("said"))), F.array("said")), lambda x: F.size(F.split(x, " ")) >= MIN_WORDS)
    unit = lambda whole: lambda x: F.struct(F.lit(whole).alias("whole"), F.md5(x).alias("hash"))
    units = F.concat(F.transform(F.array("said"), unit(True)), F.transform(parts, unit(False)))
    return texts.select("row", "conv_id", "turn", "level", "run", F.explode(units).alias("u")).select("row", "conv_id", "turn", "level", "run", "u.*")


def sayings(parsed: DataFrame) -> DataFrame:
    """(conv_id, hash, first_turn), a written table: every whole body, paragraph, line and sentence, with the earliest turn that says it."""
    paragraphs = F.split("body", r"\n[ \t]*\n", -1)
    parts = F.transform(F.concat(F.array("body"), paragraphs, F.split("body", "\n", -1)), norm)
    parts = F.array_distinct(F.concat(parts, F.flatten(F.transform(paragraphs, lambda x: sentences(norm(x))))))
    each = parsed.where("body <> ''").select("conv_id", "turn", F.explode(F.filter(parts, lambda x: x != "")).alias("part"))
    return scratch(each.groupBy("conv_id", F.md5("part").alias("hash")).agg(F.min("turn").alias("first_turn")), "sayings")


def linked(parsed: DataFrame) -> DataFrame:
    """(of, n_quotes, n_linked, said): of each row with passages, how many it has and how many were found, and in which turn
    those of the lowest level were."""
    found = passages(parsed).join(sayings(parsed), ["conv_id", "hash"], "left")
    hit = F.when(F.col("first_turn") < F.col("turn"), F.col("first_turn")).alias("hit")
    votes = found.groupBy("row", "level", "run", hit).agg(F.max("whole").alias("whole"), F.count("*").alias("n"))
    best = F.max_by("hit", F.when(F.col("hit").isNotNull(), F.struct("whole", "n", "hit")))
    runs = votes.groupBy("row", "level", "run").agg(best.alias("said"))
    lowest = F.min(F.when(F.col("said").isNotNull(), F.struct("level", (-F.col("said")).alias("last"))))
    return runs.groupBy(F.col("row").alias("of")).agg(F.count("*").alias("n_quotes"), F.count("said").alias("n_linked"), (-lowest["last"]).alias("said"))


def turns_before(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, before): the turn before each, by groups of SPAN turns and then among the groups."""
    t = parsed.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.floor(F.col("turn") / SPAN).alias("span")).distinct()
    inside = t.withColumn("near", F.lag("turn").over(W.partitionBy("conv_id", "span").orderBy("turn")))
    ends = t.groupBy("conv_id", "span").agg(F.max("turn").alias("last"))
    ends = ends.withColumn("far", F.lag("last").over(W.partitionBy("conv_id").orderBy("span"))).select("conv_id", "span", "far")
    return inside.join(ends, ["conv_id", "span"]).select("conv_id", "turn", F.coalesce("near", "far").alias("before"))


def roots(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, parent) -> (conv_id, turn, root_turn, depth), the path halved each round. What has found its
    root is done and joins no more, so late rounds don't bring a whole conversation to its root."""
    at = scratch(turns.select("conv_id", "turn", F.coalesce("parent", "turn").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("bigint").alias("depth"), F.isnull("parent").alias("done")), "paths")
    while not at.where("not done").isEmpty():
        above = at.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("done").alias("top"))
        moved = at.where("not done").join(above, ["conv_id", "up"]).select("conv_id", "turn", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), F.col("top").alias("done"))
        at = scratch(at.where("done").union(moved), "paths")
    return at.select("conv_id", "turn", F.col("up").alias("root_turn"), "depth")


def reply_key() -> Column:
    """A text that puts the messages of a conversation in reply order: by root, depth and turn, each a fixed number of digits."""
    digits = lambda c: F.lpad(F.lower(F.hex(F.col(c).cast("bigint").bitwiseXOR(F.lit(-(2**63))))), 16, "0")
    return F.concat(digits("root_turn"), digits("depth"), digits("turn"))


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a message: conv_id, turn, role, body without quotes, n_quotes, n_linked, max_level, parent_turn, root_turn, depth, reply_key.

    Ordered by conv_id and reply_key, a message stands after all that it replies to.
    """
    parsed = parse(one_name(messages, {"conv_id": conv_col, "turn": turn_col, "role": role_col, "text": text_col}))
    rows = parsed.drop("quoted").join(linked(parsed), F.col("row") == F.col("of"), "left").join(turns_before(parsed), ["conv_id", "turn"], "left")
    rows = scratch(rows.withColumn("parent_turn", F.coalesce("said", "before")), "replies")
    turns = rows.where("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.max("parent_turn").alias("parent"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    out = rows.join(roots(turns), ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", "role", "body", zero("n_quotes"), zero("n_linked"), F.col("max_level").cast("bigint").alias("max_level"), "parent_turn", "root_turn", "depth", reply_key().alias("reply_key"))
