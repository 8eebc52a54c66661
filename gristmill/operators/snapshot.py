"""Shrink constraints: one metric must come down to a target, no other may grow over its baseline."""

from __future__ import annotations

import tomllib
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The metrics of a snapshot, in order.
METRICS = ("files", "code_units", "statements", "graph_nodes", "graph_edges")


def long(snapshot: DataFrame) -> DataFrame:
    """(metric, value) of a one-row table of totals."""
    return snapshot.unpivot([], [F.col(m).cast("bigint").alias(m) for m in METRICS if m in snapshot.columns], "metric", "value")


def check(baseline: DataFrame, current: DataFrame, metric: str, target: int) -> DataFrame:
    """(metric, limit, value, is_target): metrics over their limit, that is the target for `metric`, else the baseline."""
    limit = F.when(F.col("metric") == metric, F.lit(target).cast("bigint")).otherwise(F.col("baseline"))
    both = current.join(F.broadcast(baseline.withColumnRenamed("value", "baseline")), "metric")
    return both.select("metric", limit.alias("limit"), "value", (F.col("metric") == metric).alias("is_target")).where("value > limit")


def parse_target(text: str, current: dict[str, int]) -> tuple[str, int]:
    """metric=value of a known metric, below what it is now."""
    name, sep, value = text.partition("=")
    if not sep or name not in METRICS or not value.strip().isdigit():
        raise ValueError(f"expected one of {', '.join(METRICS)} = a whole number, not {text!r}")
    if int(value) >= current[name]:
        raise ValueError(f"{name} is {current[name]}; a target must be below that")
    return name, int(value)


def save(path: str | Path, metric: str, target: int, baseline: dict[str, int]) -> None:
    rows = [f'metric = "{metric}"', f"target = {target}", "", "[baseline]", *(f"{m} = {baseline[m]}" for m in METRICS)]
    Path(path).write_text("\n".join(rows) + "\n", "utf-8")


def load(path: str | Path) -> tuple[str, int, dict[str, int]] | None:
    """None if the file is missing or not what save() writes."""
    try:
        data = tomllib.loads(Path(path).read_text("utf-8"))
        baseline = {m: int(data["baseline"][m]) for m in METRICS}
        return (data["metric"], int(data["target"]), baseline) if data["metric"] in METRICS else None
    except (OSError, tomllib.TOMLDecodeError, UnicodeDecodeError, KeyError, TypeError, ValueError):
        return None
