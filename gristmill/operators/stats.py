"""Exact nearest-rank percentiles, top values, wide tables and thresholds from what there is.

The input is long: metric_values(metric, value, ...), as unpivot() makes it of any table of metrics.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.operators.ordered import running_sum

PERCENTS = (50, 90, 95, 99)


def unpivot(df: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    """(ids, metric, value) with a row for each metric; nulls have none."""
    return df.unpivot([F.col(i) for i in ids], [F.col(m).cast("bigint").alias(m) for m in metrics], "metric", "value").where("value is not null")


def percentiles(values: DataFrame, by: tuple[str, ...] = ("metric",)) -> DataFrame:
    """n, p50, p90, p95, p99 and max of each metric: the value at rank ceil(p / 100 * n).

    From counts of distinct values and their running sums over partitions by range: exact, and a task holds no more than its
    range of values, however many a metric has and however many rows have one.
    """
    counts = values.groupBy(*by, "value").agg(F.count("*").alias("n"))
    ranked = running_sum(counts, list(by), [F.asc("value")], "n")
    totals = ranked.groupBy(*(F.col(b).alias(f"_{b}") for b in by)).agg(F.max("upto").alias("total"))
    ranked = ranked.join(totals, reduce(Column.__and__, (F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by)))
    at = lambda p: F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * p / 100), F.col("value"))).alias(f"p{p}")
    return ranked.groupBy(*by).agg(F.max("total").alias("n"), *map(at, PERCENTS), F.max("value").alias("max"))


def top(values: DataFrame, n: int, key: str, by: tuple[str, ...] = ("metric",)) -> DataFrame:
    """The n largest values of each metric, ties by key; Spark keeps n rows a task before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("value"), F.asc(key)))
    return values.withColumn("rank", rank).where(F.col("rank") <= n)


def wide(functions: DataFrame) -> DataFrame:
    """One row a function, in the order of paths and lines: what a table of functions shows."""
    name = F.substring_index("file", "/", -1).alias("file")
    return functions.orderBy("file", "line").select(name, F.col("name").alias("unit"), F.col("statements").alias("stmts"), F.col("arguments").alias("args"), F.col("max_indentation").alias("depth"), "branches", F.col("local_variables").alias("vars"), "calls")


def mimic(values: DataFrame, percent: int = 95) -> DataFrame:
    """(metric, threshold): each metric's percentile, 1 at least."""
    return percentiles(values).select("metric", F.greatest(F.col(f"p{percent}"), F.lit(1).cast("bigint")).alias("threshold"))
