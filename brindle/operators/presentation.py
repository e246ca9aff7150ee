"""Bounded views of long lists that say how much they leave out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Items shown of a list, and characters shown of an item.
ITEMS, WARNING_CHARS, TERM_CHARS = 8, 160, 80


def sampled(rows: DataFrame, group: str, first: Column, order: str, limit: int = ITEMS) -> DataFrame:
    """Up to ``limit`` rows of each group, those with ``first`` before others; adds ``nth`` and ``total``."""
    nth = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("_first"), order))
    totals = rows.groupBy(group).agg(F.count("*").alias("total"))
    return rows.withColumn("_first", first).withColumn("nth", nth).where(F.col("nth") <= limit).join(totals, group).drop("_first")


def shortened(items: Column, limit: int = ITEMS, chars: int = TERM_CHARS) -> Column:
    """The first items of an array, each cut, with the array's size."""
    return F.struct(F.transform(F.slice(items, 1, limit), lambda x: F.substring(x, 1, chars)).alias("items"), F.size(items).alias("total"))
