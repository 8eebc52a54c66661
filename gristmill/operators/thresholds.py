"""Metrics against thresholds: violations, focus, exit status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.operators import graph
from gristmill.operators.stats import unpivot

#: Metric column -> (metric of the violation, threshold that counts, what it is called, advice), in the order of report.
FUNCTION_CHECKS = {
    "statements": ("statements_per_function", "statements_per_function", "statements", "Break into smaller, focused functions."),
    "arguments_positional": ("positional_args", "arguments_positional", "positional arguments", "Consider using keyword-only arguments, a config object, or the builder pattern."),
    "arguments_keyword_only": ("keyword_only_args", "arguments_keyword_only", "keyword-only arguments", "Consider grouping related parameters into a config object."),
    "max_indentation": ("max_indentation_depth", "max_indentation_depth", "indentation depth", "Extract nested logic into helper functions or use early returns."),
    "nested_function_depth": ("nested_function_depth", "nested_function_depth", "nested functions", "Move nested functions to module level or use classes."),
    "branches": ("branches_per_function", "branches_per_function", "branches", "Consider using polymorphism, lookup tables, or the strategy pattern."),
    "local_variables": ("local_variables_per_function", "local_variables_per_function", "local variables", "Extract related variables into a data class or split the function."),
    "max_try_block_statements": ("statements_per_try_block", "statements_per_try_block", "statements in try block", "Keep try blocks narrow: wrap only the code that can raise the specific exception."),
    "boolean_parameters": ("boolean_parameters", "boolean_parameters", "boolean parameters", "Use keyword-only arguments, an enum, or separate functions instead of boolean flags."),
    "decorators": ("decorators_per_function", "annotations_per_function", "decorators", "Consider consolidating decorators or simplifying the function's responsibilities."),
    "max_return_values": ("return_values_per_function", "return_values_per_function", "return values", "Consider returning a named tuple, dataclass, or structured object instead of multiple values."),
    "calls": ("calls_per_function", "calls_per_function", "calls", "Extract some calls into helper functions to reduce coordination complexity."),
}
FILE_CHECKS = {
    "statements": ("statements_per_file", "statements_per_file", "statements", "Split into multiple modules with focused responsibilities."),
    "interface_types": ("interface_types_per_file", "interface_types_per_file", "interface types", "Move interfaces (Protocols/ABCs) into a dedicated module."),
    "concrete_types": ("concrete_types_per_file", "concrete_types_per_file", "concrete types", "Consider splitting types into separate modules by responsibility."),
    "imports": ("imported_names_per_file", "imported_names_per_file", "imports", "Consider reducing dependencies or splitting the module."),
    "functions": ("functions_per_file", "functions_per_file", "functions", "Split into multiple modules with focused responsibilities."),
}
CLASS_CHECKS = {"methods": ("methods_per_class", "methods_per_class", "methods", "Consider extracting groups of related methods into separate classes.")}
#: Messages, and the advice on graphs.
MESSAGE = "%s has %d %s (threshold: %d)"
CYCLE = ("Import cycle with %d modules: %s (threshold: %d)", "Break the cycle by introducing an interface or restructuring imports.")
INDIRECT = ("Module '%s' has %d indirect dependencies (threshold: %d)", "Reduce coupling by narrowing imports or introducing facades.")
DEPTH = ("Dependency depth is %d (threshold: %d)", "Flatten the module hierarchy or reduce chained imports.")
VIOLATION = ("file", "line", "unit_name", "metric", "value", "threshold", "message", "suggestion")


def check(metrics: DataFrame, thresholds: DataFrame, checks: dict[str, tuple[str, str, str, str]]) -> DataFrame:
    """Violations of wide metrics (lang, file, line, unit_name, whose, metric columns): value > threshold. The thresholds, at
    most languages x metrics rows, are broadcast; a null threshold drops its rows in the join. whose: the message's subject."""
    long = unpivot(metrics, ["lang", "file", "line", "unit_name", "whose"], list(checks))
    of = lambda k: F.create_map(*(F.lit(x) for m, v in checks.items() for x in (m, v[k])))[F.col("metric")]
    rank = F.create_map(*(F.lit(x) for i, k in enumerate(checks) for x in (k, i)))
    long = long.select("lang", "file", "line", "unit_name", "whose", of(0).alias("metric"), of(1).alias("limit"), of(2).alias("called"), of(3).alias("suggestion"), rank[F.col("metric")].alias("rank"), "value")
    limit = F.broadcast(thresholds.where("threshold is not null").select(F.col("lang").alias("of"), F.col("metric").alias("limit"), "threshold"))
    over = long.join(limit, (F.col("lang") == F.col("of")) & (long["limit"] == limit["limit"])).where("value > threshold")
    return over.select("file", "line", "unit_name", "metric", "value", "threshold", F.format_string(MESSAGE, "whose", "value", "called", "threshold").alias("message"), "suggestion", "rank")


def file_violations(files: DataFrame, thresholds: DataFrame) -> DataFrame:
    """files(lang, file, statements, interface_types, concrete_types, imports, functions): imports of __init__.py aren't counted."""
    name = F.substring_index("file", "/", -1)
    rows = files.withColumn("imports", F.when(name != "__init__.py", F.col("imports"))).withColumn("line", F.lit(1)).withColumn("unit_name", name).withColumn("whose", F.lit("File"))
    return check(rows, thresholds, FILE_CHECKS)


def function_violations(functions: DataFrame, thresholds: DataFrame) -> DataFrame:
    """functions(lang, file, line, name, inside_class, metrics): methods have no limit on positional arguments."""
    kind = F.when(F.col("inside_class"), "Method").otherwise("Function")
    rows = functions.withColumn("arguments_positional", F.when(~F.col("inside_class"), F.col("arguments_positional"))).withColumn("unit_name", F.col("name"))
    return check(rows.withColumn("whose", F.format_string("%s '%s'", kind, "name")), thresholds, FUNCTION_CHECKS)


def class_violations(classes: DataFrame, thresholds: DataFrame) -> DataFrame:
    rows = classes.withColumn("unit_name", F.col("name")).withColumn("whose", F.format_string("Class '%s'", "name"))
    return check(rows, thresholds, CLASS_CHECKS)


def graph_violations(modules: DataFrame, edges: DataFrame, limits: dict[str, int | None], reached: DataFrame | None = None) -> DataFrame:
    """Cycles larger than cycle_size, modules with more indirect dependencies than the limit, and, if the graph has no
    cycle, its longest path. Limits are one language's."""
    at = lambda unit, metric, value, limit, message, hint: (F.lit("(graph)").alias("file"), F.lit(0).alias("line"), unit.alias("unit_name"), F.lit(metric).alias("metric"), value.cast("bigint").alias("value"), F.lit(limit).cast("bigint").alias("threshold"), message.alias("message"), F.lit(hint).alias("suggestion"))
    spark, found = modules.sparkSession, []
    if (limit := limits.get("cycle_size")) is not None:
        rings = graph.cycles(edges).where(F.col("size") > limit).groupBy("component", "size").agg(F.array_join(F.sort_array(F.collect_list("module")), " -> ").alias("unit"))
        found.append(rings.select(*at(F.col("unit"), "cycle_size", F.col("size"), limit, F.format_string(CYCLE[0], "size", "unit", F.lit(limit)), CYCLE[1])))
    if (limit := limits.get("indirect_dependencies")) is not None:
        many = graph.indirect_dependencies(modules, edges, reached).where(F.col("indirect") > limit)
        found.append(many.select(*at(F.col("module"), "indirect_dependencies", F.col("indirect"), limit, F.format_string(INDIRECT[0], "module", "indirect", F.lit(limit)), INDIRECT[1])))
    if (limit := limits.get("dependency_depth")) is not None and (longest := graph.longest_path(edges)) is not None and longest > limit:
        found.append(spark.range(1).select(*at(F.lit("graph"), "dependency_depth", F.lit(longest), limit, F.format_string(DEPTH[0], F.lit(longest), F.lit(limit)), DEPTH[1])))
    if not found:
        return spark.createDataFrame([], "file string, line int, unit_name string, metric string, value bigint, threshold bigint, message string, suggestion string")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def focus(violations: DataFrame, path: str) -> DataFrame:
    """Those of a file or of the files under a folder."""
    path = path.rstrip("/")
    return violations.where((F.col("file") == path) | F.col("file").startswith(path + "/"))
