"""Text search with a score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-case runs of word characters."""
    return F.filter(F.split(F.lower(text), r"\W+"), lambda x: x != "")


def bm25(df: DataFrame, field: str, query: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The rows that have any of the query's tokens, with their score.

    Row counts of the tokens and the mean length come from one aggregate over all rows; only that row is broadcast. A null
    text has no tokens. A query without tokens matches nothing.
    """
    from re import findall

    terms = sorted(set(findall(r"[a-z0-9_]+", query.lower())))
    if not terms:
        return df.withColumn("score", F.lit(0.0)).limit(0)
    own = tokens(F.coalesce(F.col(f"`{field}`"), F.lit("")))
    rows = df.withColumn("_tokens", own).withColumns({f"_tf{i}": F.size("_tokens") - F.size(F.array_remove("_tokens", t)) for i, t in enumerate(terms)}).withColumn("_length", F.size("_tokens")).drop("_tokens")
    stats = rows.agg(F.count("*").alias("_n"), F.avg("_length").alias("_mean"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(terms))])
    found = rows.where(reduce(Column.__or__, [F.col(f"_tf{i}") > 0 for i in range(len(terms))])).crossJoin(F.broadcast(stats))  # one row
    idf = lambda i: F.log(1 + (F.col("_n") - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5))
    part = lambda i: idf(i) * F.col(f"_tf{i}") * (k1 + 1) / (F.col(f"_tf{i}") + k1 * (1 - b + b * F.col("_length") / F.col("_mean")))
    score = reduce(Column.__add__, [part(i) for i in range(len(terms))])
    return found.select(*[F.col(f"`{c}`") for c in df.columns], score.alias("score"))
