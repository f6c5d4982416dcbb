"""Tables of experiment runs: best of a group, means by a setting, pivots, agreement of columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stack(tables: list[DataFrame]) -> DataFrame:
    """Rows of all tables by name, missing columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def best(runs: DataFrame, by: list[str], score: str, tie: str) -> DataFrame:
    """The run of the highest score of each group; runs without a score don't count."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), tie)
    return runs.na.drop(subset=[score]).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def means(runs: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    return runs.groupBy(*by).agg(*(F.avg(c).alias(c) for c in columns)).orderBy(*by)


def highest(runs: DataFrame, rows: str, columns: str, values: list[str], score: str) -> DataFrame:
    """The highest score by two settings, one of them as columns."""
    return runs.groupBy(rows).pivot(columns, values).agg(F.max(score))


def frequent_confusions(pairs: DataFrame, most: int = 10) -> DataFrame:
    """The most frequent wrong ``(label, predicted)``."""
    wrong = pairs.where(F.col("label") != F.col("predicted")).groupBy("label", "predicted").agg(F.count("*").alias("n"))
    return wrong.orderBy(F.desc("n"), "label", "predicted").limit(most)
