"""Files that jobs write: facts by year, and CSV of a projection."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

YEAR = "_year"
#: Fixed value: what stands for null in CSV.
NULL = "\\N"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where it is unset and all is one machine, as in tests, one of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir isn't set: executors need a folder that all share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
        base = spark.sparkContext.getCheckpointDir()
    return base


def write_by_year(df: DataFrame, ts: str, path: str) -> None:
    """A fact table in one directory a year; rows without a time go to the null one."""
    df.withColumn(YEAR, F.year(ts)).repartition(YEAR, F.hash(*df.columns) % 16).write.partitionBy(YEAR).parquet(path)


def read_years(spark: SparkSession, path: str, *years: int) -> DataFrame:
    """Only the directories of the years are read."""
    return spark.read.parquet(path).where(F.col(YEAR).isin(*years)).drop(YEAR)


def write_csv(df: DataFrame, path: str, columns: dict[str, Column | str] | None = None, header: bool = True) -> None:
    """CSV of the columns (name -> expression; all of the table's if none are given); a null is \\N, so an empty text stays one."""
    rows = df if columns is None else df.select(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()])
    rows.write.option("header", header).option("escape", '"').option("nullValue", NULL).option("emptyValue", '""').csv(path)


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("header", header).option("escape", '"').option("multiLine", True).option("nullValue", NULL).option("emptyValue", "").csv(path)
