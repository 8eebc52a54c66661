"""Grouping sets as a lattice, mergeable sketches, multiset differences, shredded JSON."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.sources.tables import cut


def lattice(rows: DataFrame, dims: list[str], sums: list[str], distinct: str, sets: list[tuple[str, ...]] | None = None) -> DataFrame:
    """(dims, grouping, n, sums, n_distinct) for all subsets of dims, or for `sets`: rows are read once.

    Rows are first summed by all dims and the value to be counted, which leaves one row for each that occurs (the first phase
    of a distinct count); every coarser level is summed from the smallest level made so far that has its dims, and counted
    from there. `grouping` has a bit for each dim that is summed away, the last dim's the lowest; those dims are null.
    """
    wanted = sets if sets is not None else [c for k in range(len(dims), -1, -1) for c in combinations(dims, k)]
    made = {tuple(dims): cut(rows.groupBy(*dims, distinct).agg(F.count("*").alias("n"), *(F.sum(s).alias(s) for s in sums)))}
    sizes = {tuple(dims): made[tuple(dims)].count()}
    out = []
    for level in sorted(wanted, key=len, reverse=True):
        if level not in made:
            finer = min((k for k in made if set(level) <= set(k)), key=lambda k: (sizes[k], len(k)))
            made[level] = cut(made[finer].groupBy(*level, distinct).agg(F.sum("n").alias("n"), *(F.sum(s).alias(s) for s in sums)))
            sizes[level] = made[level].count()
        grouping = sum(1 << i for i, d in enumerate(reversed(dims)) if d not in level)
        kept = [F.col(d) if d in level else F.lit(None).cast(rows.schema[d].dataType).alias(d) for d in dims]
        totals = made[level].groupBy(*level).agg(F.sum("n").alias("n"), *(F.sum(s).alias(s) for s in sums), F.count(distinct).alias("n_distinct"))
        out.append(totals.select(*kept, F.lit(grouping).cast("long").alias("grouping"), "n", *sums, "n_distinct"))
    return reduce(DataFrame.unionByName, out)


#: A sketch of 2 ** LOG_K buckets; its relative standard error is about 1.04 / sqrt(2 ** LOG_K).
LOG_K = 14


def sketches(rows: DataFrame, by: list[str], value: str, log_k: int = LOG_K) -> DataFrame:
    """(by, sketch): a mergeable sketch of the distinct values of each group, to be stored as rows."""
    return rows.groupBy(*by).agg(F.hll_sketch_agg(value, log_k).alias("sketch"))


def merged(stored: DataFrame, by: list[str], log_k: int = LOG_K) -> DataFrame:
    """(by, estimate, low, high): distinct values of coarser groups from stored sketches, and bounds of three standard errors."""
    error = 3 * 1.04 / 2 ** (log_k / 2)
    found = stored.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))
    return found.select(*by, "estimate", F.floor(F.col("estimate") * (1 - error)).alias("low"), F.ceil(F.col("estimate") * (1 + error)).alias("high"))


def snapshot_diff(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """(columns, removed, added, kept): how many copies of each row only the old table has, only the new one, or both.

    Counts are summed in each task before a row is shuffled, so a row with very many copies is one row a task. removed is what
    EXCEPT ALL gives, added the same the other way round, kept INTERSECT ALL. Nulls are equal to each other.
    """
    both = old.select(*columns, F.lit(1).alias("_old"), F.lit(0).alias("_new")).unionByName(new.select(*columns, F.lit(0).alias("_old"), F.lit(1).alias("_new")))
    counts = both.groupBy(*columns).agg(F.sum("_old").alias("_old"), F.sum("_new").alias("_new"))
    zero = F.lit(0).cast("long")
    return counts.select(*columns, F.greatest(zero, F.col("_old") - F.col("_new")).alias("removed"), F.greatest(zero, F.col("_new") - F.col("_old")).alias("added"), F.least("_old", "_new").alias("kept"))


def shredded(rows: DataFrame, column: str, fields: dict[str, str]) -> DataFrame:
    """rows with the column parsed once as a variant, and its fields (name: type) as columns of their own.

    `<column>_kind` says what it is: `null`, `bad` for text that is no JSON, else the type of its top, as in OBJECT<...>. A field that
    isn't there, or isn't of the type, is null.
    """
    held = rows.withColumn("_variant", F.try_parse_json(column))
    kind = F.when(F.col(column).isNull(), "null").when(F.col("_variant").isNull(), "bad").otherwise(F.schema_of_variant("_variant"))
    return held.select(*rows.columns, kind.alias(f"{column}_kind"), *(F.try_variant_get("_variant", f"$.{name}", kind).alias(name) for name, kind in fields.items()))


def json_schema(rows: DataFrame, column: str) -> str:
    """The type that holds all values of a column of JSON texts, summed up over all rows; bad texts count as nulls."""
    return rows.agg(F.schema_of_variant_agg(F.try_parse_json(column))).first()[0]


