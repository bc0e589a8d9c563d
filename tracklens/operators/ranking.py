"""Counts and ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def frequency(rows: DataFrame, column: str, name: str = "n") -> DataFrame:
    """How often each value occurs; nulls don't count."""
    return rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias(name))


def ranked(rows: DataFrame, last: int, *order, first: int = 1, name: str = "rank") -> DataFrame:
    """Rows ``first`` to ``last`` in a total order with their rank.

    Only the top ``last`` rows reach the one task that numbers them.
    """
    top = rows.orderBy(*order).limit(last)
    return top.withColumn(name, F.row_number().over(Window.orderBy(*order))).where(F.col(name) >= first)


def top_per_group(rows: DataFrame, group: str, k: int, *order, name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col(name) <= k)
