"""Static test coverage: definitions that tests name.

definitions(name, kind, file, line, containing_class), refs(test_file, test_name, ref).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def covering(definitions: DataFrame, refs: DataFrame) -> DataFrame:
    """Distinct (file, name, containing_class, line, test_file, test_name): tests that name a definition or its class.

    Two equi-joins and their union; one join on either condition would compare all with all.
    """
    key = ["file", "name", "containing_class", "line"]
    tests = refs.select("test_file", "test_name", "ref").distinct()
    own = definitions.select(*key).join(tests, F.col("name") == F.col("ref"))
    of_class = definitions.where("containing_class is not null").select(*key).join(tests, F.col("containing_class") == F.col("ref"))
    return own.select(*key, "test_file", "test_name").union(of_class.select(*key, "test_file", "test_name")).distinct()


def covered(definitions: DataFrame, refs: DataFrame) -> DataFrame:
    """definitions with `covered`: whether any test file names them or their class. A name in several files counts for all."""
    names = refs.select("ref").distinct()
    a, b = names.withColumn("by_name", F.lit(True)), names.select(F.col("ref").alias("class_ref"), F.lit(True).alias("by_class"))
    both = definitions.join(a, F.col("name") == F.col("ref"), "left").join(b, F.col("containing_class") == F.col("class_ref"), "left")
    return both.select(*definitions.columns, (F.col("by_name").isNotNull() | F.col("by_class").isNotNull()).alias("covered"))


def unreferenced(definitions: DataFrame, refs: DataFrame) -> DataFrame:
    return covered(definitions, refs).where("not covered").drop("covered")


def coverage_pct(definitions: DataFrame, refs: DataFrame) -> DataFrame:
    """(total, covered, pct): the truncated percentage; 100 of no definitions."""
    n = covered(definitions, refs).agg(F.count("*").alias("total"), F.coalesce(F.sum(F.col("covered").cast("bigint")), F.lit(0)).cast("bigint").alias("covered"))
    return n.select("total", "covered", F.when(F.col("total") == 0, 100).otherwise(F.floor(F.col("covered") * 100 / F.col("total"))).cast("bigint").alias("pct"))


def show_tests(definitions: DataFrame, refs: DataFrame, untested: bool = True, most: int = 3, with_file: bool = True) -> DataFrame:
    """(file, line, name, containing_class, n_tests, tests): the first tests by name, and how many more there are."""
    key = ["file", "name", "containing_class", "line"]
    test = F.concat_ws("::", "test_file", "test_name") if with_file else F.col("test_name")
    found = covering(definitions, refs).select(*key, "test_file", test.alias("test")).distinct()
    # the number, and the first few: Spark keeps that many of a definition's tests a task before it shuffles
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("test", "test_file"))
    head = found.withColumn("rank", rank).where(F.col("rank") <= most).groupBy(*key).agg(F.array_join(F.sort_array(F.collect_list("test")), ", ").alias("head"))
    number = found.groupBy(*key).agg(F.count("*").alias("n"))
    both = number.alias("a").join(head.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key])
    by = both.select(*(F.col(f"a.{k}").alias(f"of_{k}") for k in key), "n", "head")
    same = [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in key]
    out = definitions.join(by, same, "left" if untested else "inner")
    n = F.coalesce("n", F.lit(0))
    tests = F.when(n == 0, "UNTESTED").when(n > most, F.concat("head", F.format_string(" +%d more", n - most))).otherwise(F.col("head"))
    return out.select("file", "line", "name", "containing_class", n.cast("bigint").alias("n_tests"), tests.alias("tests"))
