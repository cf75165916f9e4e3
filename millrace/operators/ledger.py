"""Transfers posted into ledger legs and balances, with the verdicts that posting them one at a time would give."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.sources.files import shared_folder

#: Times that bounds are narrowed before what is settled is written.
PASSES = 3


def _written(df: DataFrame) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/transfers-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _narrowed(live: DataFrame) -> DataFrame:
    """live(row, id, debit, credit, cents, balance, verdict) with the verdicts that bounds of the balances before each transfer settle.

    A balance is at least what it is if every open transfer out of the account is posted and none into it, and at most
    what the opposite makes it. The first open transfer has equal bounds, so each pass settles one at least.
    """
    side = lambda account, sign: F.struct(F.col(account).alias("account"), F.lit(sign).alias("sign"))
    sides = live.withColumn("_side", F.explode(F.array(side("debit", -1), side("credit", 1))))
    before = W.partitionBy("_side.account").orderBy("id", "row").rowsBetween(W.unboundedPreceding, -1)
    total = lambda sign, condition: F.coalesce(F.sum(F.when((F.col("_side.sign") == sign) & condition, F.col("cents"))).over(before), F.lit(0))
    posted, open_ = F.coalesce(F.col("verdict") == "posted", F.lit(False)), F.col("verdict").isNull()
    sure = F.col("balance") + total(1, posted) - total(-1, posted)
    bounds = sides.withColumns({"_least": sure - total(-1, open_), "_most": sure + total(1, open_)}).where("_side.sign = -1")
    settled = F.when(F.col("cents") <= F.col("_least"), "posted").when(F.col("cents") > F.col("_most"), "insufficient")
    return bounds.withColumn("verdict", F.coalesce("verdict", settled)).select(*live.columns)


def judge_transfers(transfers: DataFrame, accounts: DataFrame) -> DataFrame:
    """transfers(id, debit, credit, cents) on accounts(account, balance, active) with verdict: not positive, self,
    unknown, inactive, insufficient or posted.

    Transfers are judged one at a time in the order of id: what an account has received before counts, refused transfers
    don't. Bounds of the balances are narrowed in passes until every transfer is settled: as many as posted transfers hang
    on one another at most, few where balances suffice. An account's transfers are put in order in one task.
    """
    side = lambda name: accounts.select(F.col("account").alias(name), F.col("balance").alias(f"{name}_balance"), F.col("active").alias(f"{name}_active"))
    both = transfers.join(side("debit"), "debit", "left").join(side("credit"), "credit", "left")
    refused = (
        F.when(~(F.col("cents") > 0) | F.col("cents").isNull(), "not positive")
        .when(F.col("debit") == F.col("credit"), "self")
        .when(F.col("debit_balance").isNull() | F.col("credit_balance").isNull(), "unknown")
        .when(~F.col("debit_active") | ~F.col("credit_active"), "inactive")
    )
    both = both.select(F.monotonically_increasing_id().alias("row"), "id", "debit", "credit", "cents", F.col("debit_balance").alias("balance"), refused.alias("verdict"))
    live = _written(both)
    done = [live.where("verdict is not null")]
    live = live.where("verdict is null")
    while not live.where("verdict is null").isEmpty():
        for _ in range(PASSES):
            live = _narrowed(live)
        live = _written(live)
        done.append(live.where("verdict = 'insufficient'"))
        live = live.where("verdict is null or verdict = 'posted'")
    return reduce(DataFrame.union, [*done, live]).select("id", "debit", "credit", "cents", "verdict")


def legs(posted: DataFrame) -> DataFrame:
    """Two legs of each transfer: transfer_id, account, cents (negative on the account that sends)."""
    two = F.array(F.struct(F.col("debit").alias("account"), (-F.col("cents")).alias("cents")), F.struct(F.col("credit").alias("account"), F.col("cents").alias("cents")))
    return posted.select(F.col("id").alias("transfer_id"), F.inline(two))


def post(transfers: DataFrame, accounts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(transfers with their verdicts, legs of the posted ones, accounts with their new balances)."""
    judged = judge_transfers(transfers, accounts)
    entries = legs(judged.where("verdict = 'posted'"))
    change = entries.groupBy(F.col("account").alias("_account")).agg(F.sum("cents").alias("_cents"))
    after = accounts.join(change, F.col("account") == F.col("_account"), "left").select("account", (F.col("balance") + F.coalesce("_cents", F.lit(0))).alias("balance"), "active")
    return judged, entries, after
