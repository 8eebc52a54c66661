"""Operators along an order: values carried on, as-of joins, islands, interval joins, global ranks.

A key with very many rows is split by time: each slice is worked off by itself, and what it hands on, one row a slice, is
carried to the next ones in a second small step. Global orders are range-partitioned; what comes before a partition is a sum
of counts, so that no task ever holds more than its own range.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.spans import covers
from gristmill.sources.tables import cut

SLICE = "1 day"
#: Rows of one interval bin that are joined in one place; bins with more are dealt to several.
BIN_ROWS = 100_000
#: Widths of interval bins: each level's is so many times that of the one below.
WIDER = 8


def _slice(time: str, width: str) -> Column:
    return F.window(F.col(time).cast("timestamp"), width)["start"].cast("long")


def carry_last(rows: DataFrame, key: list[str], time: str, order: list[str], value: Column, name: str, inclusive: bool = True, width: str = SLICE) -> DataFrame:
    """rows with `name`: the last value that isn't null of the key's rows up to each row, itself included or not, by time and
    then `order`. Rows without a time are left out; null keys are keys of their own."""
    held = rows.where(F.col(time).isNotNull()).withColumn("_slice", _slice(time, width)).withColumn("_value", value)
    one = Window.partitionBy(*key, "_slice").orderBy(time, *order)
    local = held.withColumn("_local", F.last("_value", True).over(one.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)))
    handed = held.groupBy(*key, "_slice").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(time, *order))).alias("_last"))
    before = Window.partitionBy(*key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    handed = handed.select(*(F.col(k).alias(f"_{k}") for k in key), F.col("_slice").alias("_of"), F.last("_last", True).over(before).alias("_before"))
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key), F.col("_slice") == F.col("_of"))
    return local.join(handed, same, "left").select(*rows.columns, F.coalesce("_local", "_before").alias(name))


def asof_join(left: DataFrame, right: DataFrame, key: list[str], time: str, right_time: str, right_order: list[str], width: str = SLICE) -> DataFrame:
    """Each row of left with `match`, the last row of right of the same key whose time isn't after its own, as a struct; null if there is none.

    Of right's rows of one time the last by right_order counts. Rows of left without a time or with a null key have no match.
    """
    payload = F.struct(*(F.col(c) for c in right.columns))
    able = F.col(time).isNotNull()
    for k in key:
        able = able & F.col(k).isNotNull()
    row_type, match_type = left.select(F.struct(*left.columns).alias("x")).schema["x"].dataType, right.select(payload.alias("x")).schema["x"].dataType
    a = left.where(able).select(*key, F.col(time).alias("_time"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(match_type).alias("_match"))
    b = right.select(*key, F.col(right_time).alias("_time"), F.lit(0).alias("_side"), F.lit(None).cast(row_type).alias("_row"), payload.alias("_match"))
    both = a.unionByName(b)
    rank = F.struct(*(F.col(f"_match.{c}").alias(c) for c in right_order))
    found = carry_last(both.withColumn("_rank", rank), key, "_time", ["_side", "_rank"], F.col("_match"), "match", True, width)
    found = found.where("_side = 1").select("_row.*", "match")
    return found.unionByName(left.where(~F.coalesce(able, F.lit(False))).withColumn("match", F.lit(None).cast(found.schema["match"].dataType)))


def islands(rows: DataFrame, key: list[str], time: str, order: list[str], gap: str, width: str = SLICE) -> DataFrame:
    """rows with `island`, the time of the first row of the run that each belongs to: a run ends where more than `gap` follows."""
    seen = carry_last(rows, key, time, order, F.col(time), "_previous", False, width)
    begins = F.col("_previous").isNull() | (F.col(time) > F.col("_previous") + F.expr(f"INTERVAL {gap}"))
    return carry_last(seen, key, time, order, F.when(begins, F.col(time)), "island", True, width).drop("_previous")


def _level(length: Column, base: int) -> Column:
    """The first level whose bins are wider than an interval, so that it lies in two of them at most."""
    return F.greatest(F.lit(0), F.ceil(F.log(float(WIDER), (length + 1) / F.lit(float(base)))).cast("int"))


def interval_join(left: DataFrame, right: DataFrame, key: list[str], base: int, bin_rows: int = BIN_ROWS) -> DataFrame:
    """All pairs of rows of left(key, l_from, l_to, ...) and right(key, r_from, r_to, ...) of one key whose intervals, of whole
    numbers and with both ends, have a point in common. `key` may be empty; null keys pair with none.

    An interval is put into bins as wide as the longer one of a pair needs, of which it meets two at most, so that a long
    one isn't cut into many; the pair comes from the bin of the later start alone. `base` is the width of the smallest bins.
    Bins with many rows of left are dealt to several places, by a hash of the row, to each of which right's rows go. Empty intervals pair with none.
    """
    sides = []
    for rows, a, b in ((left, "l_from", "l_to"), (right, "r_from", "r_to")):
        sides.append(rows.where(F.col(a) <= F.col(b)).withColumn("_own", _level(F.col(b) - F.col(a), base)))
    levels = sorted({r[0] for s in sides for r in s.select("_own").distinct().collect()})  # some twenty at most, by the logarithm

    def binned(rows: DataFrame, a: str, b: str) -> DataFrame:
        level = F.explode(F.filter(F.array(*map(F.lit, levels or [0])), lambda x: x >= F.col("_own"))).alias("_level")
        out = rows.select("*", level).withColumn("_width", (F.lit(base) * F.pow(F.lit(float(WIDER)), F.col("_level"))).cast("long"))
        out = out.select("*", F.explode(F.sequence(F.expr(f"cast(floor({a} / _width) as bigint)"), F.expr(f"cast(floor({b} / _width) as bigint)"))).alias("_bin"))
        return out

    at = [*key, "_level", "_bin"]
    a, b = binned(sides[0], "l_from", "l_to"), binned(sides[1], "r_from", "r_to")
    hot = cut(a.groupBy(*at).agg(F.count("*").alias("_n")).where(F.col("_n") > bin_rows).select(*at, F.ceil(F.col("_n") / bin_rows).cast("int").alias("_parts")))
    hot = F.broadcast(hot) if hot.count() <= 100_000 else hot  # a row for each bin_rows rows at most
    parts = F.coalesce("_parts", F.lit(1))
    a = a.join(hot, at, "left").withColumn("_part", F.pmod(F.xxhash64(*left.columns), parts).cast("int")).drop("_parts")
    b = b.join(hot, at, "left").select("*", F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part")).drop("_parts")
    b = b.withColumnsRenamed({"_own": "_r_own", "_width": "_r_width"})
    found = a.join(b, [*at, "_part"]).where((F.col("l_from") <= F.col("r_to")) & (F.col("r_from") <= F.col("l_to")))
    found = found.where((F.col("_level") == F.greatest("_own", "_r_own")) & (F.col("_bin") == F.expr("cast(floor(greatest(l_from, r_from) / _width) as bigint)")))
    return found.select(*key, *(c for c in left.columns if c not in key), *(c for c in right.columns if c not in key))


def covered(points: DataFrame, spans: DataFrame, base: int, bin_rows: int = BIN_ROWS) -> DataFrame:
    """points(at, own, ...) with `n`, the number of spans(r_from, r_to, other) with both ends that each lies in and whose `other` is not
    its `own`, and `first`, the smallest of these; points without such a span are left out, and nulls and empty spans count for
    nothing. at, r_from, r_to, own and other are bigints. interval_join() and two aggregates say the same, pair by pair.

    A span lies in two bins at most of the first width above its length, a point in one of each width. Bins with many spans or
    points are dealt to parts of both. A point's rows tell it apart and are added up in the end, one for each width and part.
    """
    spans = spans.where("r_from <= r_to and other is not null").withColumn("_level", _level(F.col("r_to") - F.col("r_from"), base))
    levels = sorted(r[0] for r in spans.select("_level").distinct().collect()) or [0]  # some twenty at most, by the logarithm
    width = (F.lit(base) * F.pow(F.lit(float(WIDER)), F.col("_level"))).cast("long")
    bin_of = lambda c: F.floor(F.col(c) / F.col("_width")).cast("long")
    names = [c for c in points.columns if c not in ("at", "own")]
    a = points.where("at is not null and own is not null").select(*points.columns, F.explode(F.array(*map(F.lit, levels))).alias("_level")).withColumn("_width", width)
    a = a.select("_level", bin_of("at").alias("_bin"), F.lit(True).alias("_point"), "at", F.col("at").alias("to"), F.col("own").alias("who"), F.struct(*names).alias("_row"))
    b = spans.withColumn("_width", width).select("*", F.explode(F.sequence(bin_of("r_from"), bin_of("r_to"))).alias("_bin"))
    b = b.select("_level", "_bin", F.lit(False).alias("_point"), F.col("r_from").alias("at"), F.col("r_to").alias("to"), F.col("other").alias("who"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"))
    both = a.unionByName(b)
    many = lambda c: F.ceil(F.count_if(c) / bin_rows).cast("int")
    hot = both.groupBy("_level", "_bin").agg(many(F.col("_point")).alias("_x"), many(~F.col("_point")).alias("_y")).where("_x > 1 or _y > 1")
    hot = cut(hot.select("_level", "_bin", F.greatest("_x", F.lit(1)).alias("_x"), F.greatest("_y", F.lit(1)).alias("_y")))
    hot = F.broadcast(hot) if hot.count() <= 100_000 else hot
    x, y = F.coalesce("_x", F.lit(1)), F.coalesce("_y", F.lit(1))
    dealt = both.join(hot, ["_level", "_bin"], "left").withColumn("_hash", F.xxhash64("at", "to", "who", "_row"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.when(F.col("_point"), y).otherwise(x) - 1)).alias("_other"))
    part = lambda own, n: F.when(own, F.pmod("_hash", n)).otherwise(F.col("_other")).cast("int")
    dealt = dealt.select("_level", "_bin", part(F.col("_point"), x).alias("_px"), part(~F.col("_point"), y).alias("_py"), "_point", "at", "to", "who", "_row")

    def run(t: pa.Table) -> pa.Table:
        side = t.column("_point")
        p, s = t.filter(side), t.filter(pa.compute.invert(side))
        n, first = covers(*(p.column(c).to_numpy() for c in ("at", "who")), *(s.column(c).to_numpy() for c in ("at", "to", "who")))
        out = pa.table([p.column("_row"), p.column("at"), p.column("who"), pa.array(n), pa.array(first)], names=["_row", "at", "own", "n", "first"])
        return out.filter(pa.array(n > 0))

    row_type = a.schema["_row"].dataType.simpleString()
    found = dealt.groupBy("_level", "_bin", "_px", "_py").applyInArrow(run, f"_row {row_type}, at bigint, own bigint, n bigint, first bigint")
    summed = found.groupBy("_row", "at", "own").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    return summed.select("_row.*", "at", "own", "n", "first")


def running_sum(rows: DataFrame, by: list[str], order: list[Column], n: str, name: str = "upto") -> DataFrame:
    """rows with `name`: the sum of column n over the rows of the same `by` up to each one, in `order`, without a window.

    Rows are partitioned by ranges of by and order and summed in each partition. A partition's border cuts one group at most;
    what such groups have in the partitions before, no more than two rows a partition, is added by a join.
    """
    spread = rows.repartitionByRange(*(F.col(b) for b in by), *order) if by or order else rows
    spread = spread.sortWithinPartitions(*(F.col(b) for b in by), *order).withColumn("_part", F.spark_partition_id())
    schema = spread.withColumn(name, F.lit(0).cast("long")).schema
    fields = [spread.columns.index(b) for b in by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, bool)
            first = [batch.column(i)[0] for i in fields]
            new[0] = held is None or first != held
            for i in fields:
                c = batch.column(i)
                same = pa.compute.equal(c[1:], c[:-1]).fill_null(False).to_numpy(zero_copy_only=False)
                both_null = (pa.compute.is_null(c[1:]).to_numpy(zero_copy_only=False)) & (pa.compute.is_null(c[:-1]).to_numpy(zero_copy_only=False))
                new[1:] |= ~(same | both_null)
            values = batch.column(spread_columns.index(n)).to_numpy(zero_copy_only=False).astype(np.int64)
            sums = np.cumsum(values) + (0 if new[0] else total)
            starts = np.flatnonzero(new)
            if len(starts):
                # what was summed before each group's first row of this batch is taken off again
                offset = sums[starts] - values[starts]
                which = np.cumsum(new) - 1
                sums = sums - np.where(which >= 0, offset[np.maximum(which, 0)], 0)
            held, total = [batch.column(i)[batch.num_rows - 1] for i in fields], int(sums[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums)], names=[*spread_columns, name])

    spread_columns = spread.columns
    local = cut(spread.mapInArrow(run, schema))
    ends = local.groupBy("_part", *by).agg(F.max(name).alias("_sum"))
    if by:
        ends = ends.join(ends.groupBy(*by).agg(F.count("*").alias("_parts")).where("_parts > 1").drop("_parts").withColumnsRenamed({b: f"_{b}" for b in by}), reduce(Column.__and__, (F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by)), "left_semi")
    rows_before, running = [], {}
    for r in sorted(ends.collect(), key=lambda r: r["_part"]):
        group = tuple(r[b] for b in by)
        rows_before.append((*group, r["_part"], running.get(group, 0)))
        running[group] = running.get(group, 0) + r["_sum"]
    kinds = ", ".join([*(f"_{b} {local.schema[b].dataType.simpleString()}" for b in by), "_of int", "_before bigint"])
    before = F.broadcast(local.sparkSession.createDataFrame(rows_before, kinds))
    same = reduce(Column.__and__, (F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by), F.col("_part") == F.col("_of"))
    return local.join(before, same, "left").select(*rows.columns, (F.col(name) + F.coalesce("_before", F.lit(0))).alias(name))


def global_rank(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """rows with `name`, their number from 1 in the order, which must tell all rows apart; no task sees more than its range."""
    return running_sum(rows.withColumn("_one", F.lit(1).cast("long")), [], order, "_one", name).drop("_one")
