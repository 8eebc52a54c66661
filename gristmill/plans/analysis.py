"""A folder of code from files to violations, clusters, coverage and totals: what the command line runs."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.operators import coverage, duplication, graph, metrics, thresholds
from gristmill.sources import discovery
from gristmill.sources.config import Gate, load_thresholds, threshold_table
from gristmill.sources.nodes import nodes, parse_errors
from gristmill.sources.tables import cut


@dataclass
class Analysis:
    """files(file_id, path, lang, source); everything else is derived, and what several results need is checkpointed."""

    files: DataFrame
    limits: dict | None = None
    gate: Gate = Gate()

    @cached_property
    def nodes(self) -> DataFrame:
        return cut(nodes(self.files).repartition("file_id"))

    @cached_property
    def errors(self) -> DataFrame:
        return parse_errors(self.files)

    @cached_property
    def function_rows(self) -> DataFrame:
        return cut(metrics.function_metrics(self.nodes))

    @cached_property
    def class_rows(self) -> DataFrame:
        return metrics.class_metrics(self.nodes)

    @cached_property
    def file_rows(self) -> DataFrame:
        return cut(metrics.file_metrics(self.nodes))

    @cached_property
    def modules(self) -> DataFrame:
        """Of files whose paths give one name, the last path's."""
        named = self.files.select("file_id", "path", "lang", graph.module_name(F.col("path")).alias("module"))
        return cut(named.groupBy("module").agg(F.max_by("path", "path").alias("path"), F.max_by("lang", "path").alias("lang")))

    @cached_property
    def edges(self) -> DataFrame:
        src = self.files.select("file_id", graph.module_name(F.col("path")).alias("src"))
        named = metrics.imports(self.nodes).join(src, "file_id").select("src", "name")
        return cut(graph.dependency_edges(graph.resolve_imports(named, self.modules)))

    @cached_property
    def violations(self) -> DataFrame:
        limits = load_thresholds([]) if self.limits is None else self.limits
        rows = threshold_table(self.files.sparkSession, limits)
        at = lambda df: df.withColumn("file", F.col("path"))
        found = [thresholds.file_violations(self.file_rows, rows), thresholds.function_violations(at(self.function_rows), rows), thresholds.class_violations(at(self.class_rows), rows)]
        found = [f.select(*thresholds.VIOLATION) for f in found]
        graphs = thresholds.graph_violations(self.modules, self.edges, next(iter(limits.values()), {})).select(*thresholds.VIOLATION)
        return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(graphs)

    @cached_property
    def chunks(self) -> DataFrame:
        return cut(metrics.chunks(self.nodes, self.files))

    @cached_property
    def classes(self) -> tuple[DataFrame, DataFrame]:
        return duplication.classes(cut(duplication.signatures(self.chunks)))

    @cached_property
    def class_pairs(self) -> DataFrame:
        return cut(duplication.class_pairs(self.classes[1], min_similarity=self.gate.min_similarity))

    @cached_property
    def pairs(self) -> DataFrame:
        """All pairs of copies, for a report of them."""
        return duplication.duplicate_pairs(cut(duplication.signatures(self.chunks)), min_similarity=self.gate.min_similarity)

    @cached_property
    def clusters(self) -> DataFrame:
        return cut(duplication.clusters(self.classes[0], self.class_pairs))

    @cached_property
    def cluster_summary(self) -> DataFrame:
        return duplication.cluster_summary(self.classes[0], self.class_pairs, self.clusters)

    @cached_property
    def tests(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(definitions outside tests, references of test files by test, all references of test files)."""
        by_use = metrics.test_files(self.nodes).withColumn("by_use", F.lit(True))
        path = F.col("path")
        marked = self.files.select("file_id", "path").join(by_use, "file_id", "left")
        test_paths = marked.where(discovery.is_test_file(path) | discovery.in_test_folder(path) | F.coalesce("by_use", F.lit(False))).select("path")
        definitions = metrics.definitions(self.nodes).join(test_paths, F.col("file") == F.col("path"), "left_anti")
        by_test = metrics.test_references(self.nodes).join(test_paths, F.col("test_file") == F.col("path"), "left_semi")
        every = metrics.references(self.nodes).join(test_paths, "path", "left_semi").select(F.col("path").alias("test_file"), F.lit("").alias("test_name"), "ref")
        return cut(definitions), cut(by_test), cut(every)

    @cached_property
    def coverage(self) -> DataFrame:
        return coverage.coverage_pct(self.tests[0], self.tests[2])

    @cached_property
    def values(self) -> DataFrame:
        """(metric, value) of functions, classes, files and the graph."""
        own = metrics.metric_values(self.function_rows, self.class_rows, self.file_rows)
        degree = graph.degrees(self.modules, self.edges).select(F.col("fan_in").cast("bigint"), F.col("fan_out").cast("bigint"))
        far = graph.indirect_dependencies(self.modules, self.edges).select(F.col("indirect").alias("transitive_deps"), F.col("eccentricity").alias("dependency_depth"))
        for df in (degree, far):
            own = own.unionByName(df.unpivot([], df.columns, "metric", "value"))
        return own

    @cached_property
    def totals(self) -> DataFrame:
        return metrics.totals(self.file_rows, metrics.code_units(self.nodes), self.modules, self.edges)
