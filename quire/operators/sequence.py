"""Ordered operators as windows: ranks, islands, gaps, tails, firsts, running sums. Every order ends in a unique key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reading_rank(lines: DataFrame, page: str = "page_id", order: str = "ord") -> DataFrame:
    """W1. 1-based rank within the page."""
    return lines.select(page, order, F.row_number().over(Window.partitionBy(page).orderBy(order)).cast("long").alias("rank_"))


def islands(flags: DataFrame, least: int = 3) -> DataFrame:
    """W3. Maximal runs of true rows of that length or more. flags: strip_id, row_no, flat."""
    w = Window.partitionBy("strip_id").orderBy("row_no")
    run = F.row_number().over(w) - F.row_number().over(Window.partitionBy("strip_id", "flat").orderBy("row_no"))
    out = flags.withColumn("run", run).where("flat").groupBy("strip_id", "run").agg(F.min("row_no").alias("first_row"), F.max("row_no").alias("last_row"), F.count("*").alias("n"))
    return out.where(F.col("n") >= least).drop("run")


def interval_gaps(boxes: DataFrame, least: int = 4) -> DataFrame:
    """W4. Gaps between the x intervals of a page's boxes: width and middle."""
    w = Window.partitionBy("page_id").orderBy("x", "box_id").rowsBetween(Window.unboundedPreceding, -1)
    out = boxes.withColumn("reach", F.max(F.col("x") + F.col("w")).over(w)).where(F.col("x") - F.col("reach") > least)
    return out.select("page_id", (F.col("x") - F.col("reach")).alias("width"), F.floor((F.col("x") + F.col("reach")) / 2).alias("middle"))


def last_of_each(lines: DataFrame, n: int = 6, page: str = "page_id", order: str = "ord") -> DataFrame:
    """W9. The last n rows of each page."""
    w = Window.partitionBy(page).orderBy(F.desc(order))
    return lines.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def first_of_each(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """W10. The first row of each key: an aggregate, so that a frequent key needs no sort."""
    first = F.min(F.struct(*order)).alias("_f")
    return rows.groupBy(key).agg(first).select(key, *[F.col(f"_f.{c}") for c in order])


def running_balance(ledger: DataFrame) -> DataFrame:
    """W12. The balance after each row, by account and seq."""
    signed = F.when(F.col("kind") == "credit", F.col("coins")).when(F.col("kind") == "spend", -F.col("coins")).otherwise(0)
    return ledger.select("uid", "seq", F.sum(signed).over(Window.partitionBy("uid").orderBy("seq")).cast("long").alias("balance"))


def newest(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """O2, O5. The newest n rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")
