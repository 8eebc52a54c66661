"""Report lines and graph drawings."""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.text import escape_dot, escape_html, slug
from gristmill.operators.graph import coarsen


def violation_lines(violations: DataFrame) -> DataFrame:
    line = F.concat(F.lit("VIOLATION:"), F.concat_ws(":", "metric", "file", F.col("line").cast("string"), "unit_name"), F.lit(": "), F.concat_ws(" ", "message", "suggestion"))
    return violations.select(line.alias("line"))


def duplication_lines(members: DataFrame, summary: DataFrame, places: int = 1000) -> DataFrame:
    """members(cluster_id, file, start_line, name), summary(cluster_id, n, similarity): one line a cluster, in the order of
    places. A line names no more than `places` of them, and says how many it leaves out: it is for reading."""
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy("file", "start_line", "name"))
    first = members.withColumn("rank", rank).where(F.col("rank") <= places)
    where = first.groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("rank", "file", "start_line", "name"))).alias("at"))
    listed = F.array_join(F.transform("at", lambda x: F.concat_ws(":", x["file"], x["start_line"].cast("string"))), ", ")
    more = F.when(F.col("n") > places, F.format_string(", +%d more", F.col("n") - places)).otherwise("")
    at = F.col("at")[0]
    text = F.format_string("VIOLATION:duplication:%s:%d:%s: %d%% similar, %d copies: [%s%s]. Factor out repeated patterns into shared functions.", at["file"], at["start_line"], at["name"], F.floor(F.col("similarity") * 100), "n", listed, more)
    return where.join(summary, "cluster_id").select(text.alias("line"))


def coverage_line(pct: int, threshold: int, missing: int, total: int) -> str:
    return f"GATE_FAILED:test_coverage: {pct}% (threshold: {threshold}%). {missing} of {total} definitions lack test references."


def summary_line(totals: dict[str, int]) -> str:
    return "Analyzed: " + ", ".join(f"{v} {k}" for k, v in totals.items())


def shrink_line(metric: str, limit: int, value: int, is_target: bool) -> str:
    return f"GATE_FAILED:shrink: {metric} {value} > {limit} {'(target not met)' if is_target else '(constraint exceeded baseline)'}"


def pair_lines(pairs: DataFrame, chunks: DataFrame) -> DataFrame:
    """pairs(i, j, similarity), chunks(chunk_id, file, start_line): the sides in the order of their places."""
    side = lambda x: chunks.select(F.col("chunk_id").alias(x), F.struct("file", "start_line").alias(f"at_{x}"))
    both = pairs.join(side("i"), "i").join(side("j"), "j").select("similarity", F.least("at_i", "at_j").alias("a"), F.greatest("at_i", "at_j").alias("b"))
    return both.select(F.format_string("%s:%d <-> %s:%d (%d%% similar)", "a.file", "a.start_line", "b.file", "b.start_line", F.floor(F.col("similarity") * 100)).alias("line"))


def test_lines(shown: DataFrame, covered: DataFrame, untested: bool = False) -> DataFrame:
    """(file, line, name, text): of show_tests(with_file=False) and covered(): definitions with their tests, and, if asked for,
    those that no test file names. What only a test file names outside its tests is tested, too."""
    key = ["file", "line", "name", "containing_class"]
    flags = covered.select(*(F.col(k).alias(f"of_{k}") for k in key), "covered").distinct()
    both = shown.join(flags, [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in key])
    tested = F.when(F.col("n_tests") > 0, F.format_string("TESTED:%s:%s <- [%s]", "file", "name", "tests")).otherwise(F.format_string("TESTED:%s:%s", "file", "name"))
    text = F.when(F.col("covered"), tested).otherwise(F.format_string("UNTESTED:%s:%d:%s", "file", "line", "name"))
    return both.where(F.lit(untested) | F.col("covered")).select("file", "line", "name", text.alias("text"))


def stats_lines(rows: list[dict]) -> list[str]:
    """The table of percentiles() rows, in the order of METRICS."""
    width, at = 38, ("n", "p50", "p90", "p95", "p99", "max")
    head = "Metric".ljust(width) + "".join(x.rjust(7) for x in ("Count", "50%", "90%", "95%", "99%", "Max"))
    by = {r["metric"]: r for r in rows}
    body = [METRICS[m][1].ljust(width) + "".join(str(by[c][k]).rjust(7) for k in at) for m in METRICS if (c := METRICS[m][0]) in by]
    return ["gristmill stats - Summary Statistics", "", head, "-" * len(head), *body]


#: Metric of the statistics -> (its name in this engine's tables, its title), in the order of the report.
METRICS = {
    "statements_per_function": ("statements", "Statements per function"),
    "arguments_per_function": ("arguments", "Arguments (total)"),
    "arguments_positional": ("arguments_positional", "Arguments (positional)"),
    "arguments_keyword_only": ("arguments_keyword_only", "Arguments (keyword-only)"),
    "max_indentation_depth": ("max_indentation", "Max indentation depth"),
    "branches_per_function": ("branches", "Branches per function"),
    "local_variables_per_function": ("local_variables", "Local variables per function"),
    "returns_per_function": ("returns", "Returns per function"),
    "nested_function_depth": ("nested_function_depth", "Nested function depth"),
    "boolean_parameters": ("boolean_parameters", "Boolean parameters"),
    "calls_per_function": ("calls", "Calls per function"),
    "methods_per_class": ("methods", "Methods per class"),
    "statements_per_file": ("statements_per_file", "Statements per file"),
    "functions_per_file": ("functions", "Functions per file"),
    "interface_types_per_file": ("interface_types", "Interface types per file"),
    "concrete_types_per_file": ("concrete_types", "Concrete types per file"),
    "imported_names_per_file": ("imports", "Imported names per file"),
    "fan_in": ("fan_in", "Fan-in (per module)"),
    "fan_out": ("fan_out", "Fan-out (per module)"),
    "transitive_deps": ("transitive_deps", "Transitive deps (per module)"),
    "dependency_depth": ("dependency_depth", "Dependency depth (per module)"),
}


#: format -> (lines before, node, edge, lines after). What drawing tools read.
DRAWINGS = {
    "mermaid": (["graph LR"], '  {id}["{html}"]', "  {a_id} --> {b_id}", []),
    "dot": (["digraph modules {", "  rankdir=LR;", "  node [shape=box];"], '  "{dot}";', '  "{a_dot}" -> "{b_dot}";', ["}"]),
}
SUFFIXES = {".dot": ("dot", "{}"), ".mmd": ("mermaid", "{}"), ".mermaid": ("mermaid", "{}"), ".md": ("mermaid", "```mermaid\n{}```\n"), ".markdown": ("mermaid", "```mermaid\n{}```\n")}


def _templated(template: str, forms: dict[str, Column]) -> Column:
    """A column of the template's text with the named columns in its places."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(forms[x] if i % 2 else F.lit(x) for i, x in enumerate(parts)))


def _forms(name: str, prefix: str = "") -> dict[str, Column]:
    return {prefix + "id": slug(F.col(name)), prefix + "html": escape_html(F.col(name)), prefix + "dot": escape_dot(F.col(name))}


def drawing_lines(modules: DataFrame, edges: DataFrame, form: str) -> tuple[DataFrame, DataFrame]:
    """The lines of nodes and of edges, each in order by name."""
    _, node, edge, _ = DRAWINGS[form]
    nodes = modules.select("module").union(edges.select("src")).union(edges.select("dst")).distinct().orderBy("module").select(_templated(node, _forms("module")).alias("line"))
    links = edges.select("src", "dst").distinct().orderBy("src", "dst").select(_templated(edge, _forms("src", "a_") | _forms("dst", "b_")).alias("line"))
    return nodes, links


def drawing(modules: DataFrame, edges: DataFrame, form: str) -> Iterator[str]:
    """The drawing line by line; rows come to the driver one partition at a time."""
    before, _, _, after = DRAWINGS[form]
    yield from before
    for lines in drawing_lines(modules, edges, form):
        yield from (r["line"] for r in lines.toLocalIterator())
    yield from after


def mermaid(modules: DataFrame, edges: DataFrame) -> str:
    return "".join(f"{x}\n" for x in drawing(modules, edges, "mermaid"))


def dot(modules: DataFrame, edges: DataFrame) -> str:
    return "".join(f"{x}\n" for x in drawing(modules, edges, "dot"))


def write_graph(path: str | Path, modules: DataFrame, edges: DataFrame, zoom: float = 1.0) -> None:
    """A drawing for people, in the form that the suffix asks for in any case; coarsen a large graph first."""
    kind = Path(path).suffix.lower()
    if kind not in SUFFIXES:
        raise ValueError(f"Unsupported extension '{kind}'. Use .dot, .mmd/.mermaid, or .md")
    if zoom < 1:
        modules, edges = coarsen(modules, edges, zoom)
    form, around = SUFFIXES[kind]
    before, after = around.split("{}")
    with open(path, "w", encoding="utf-8") as f:
        f.write(before)
        f.writelines(f"{x}\n" for x in drawing(modules, edges, form))
        f.write(after)
