"""Metrics of code over small sources of all languages, as the star schema has no code; see code_sql for the SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators import metrics, stats
from gristmill.plans import code_sql
from gristmill.plans.analysis import Analysis
from gristmill.sources.config import load_thresholds
from gristmill.sources.nodes import nodes

PY = '''import os, sys as s
from .models import A, B
from abc import ABC

def f(a, b=True, *args, c=1):
    x = a
    if b:
        y = g(x)
    return x, y

class P(ABC):
    def m(self): pass

class C:
    @property
    def go(self, q: int, r=False):
        try:
            self.z = h()
            w = 1
        except ValueError:
            return None
        def inner():
            return 1, 2, 3
        for i in q:
            while i:
                if i:
                    return (1, 2, 3, 4)
        return w
'''
JS = """import a, {b} from './x.js';
export class A extends B { constructor(x) { super(x); this.y = 1 } async go(a, b = true) { if (a) { return f(b) } else if (b) { throw new E() } else { x = 2; } for (const k of z) { g(k) } } }
function* gen(a) { var q = 1; switch (a) { case 1: foo(); break; default: bar() } try { h() } catch (e) { i() } }
"""
TS = "interface P { a: string }\nclass C { private x: number = 1; m(a: string, b?: boolean): void { return this.n(a) } }\nfunction f(a: boolean = true): string { return 'a' }\n"
PHP = """<?php
use A\\B\\C, D;
interface I {}
class T extends U { public function m($a, $b = true) { $x = 1; if ($a) { echo $b; } elseif ($c) { return $this->k($a); } else { foreach ($a as $q) { T::z(); } } throw new E('x'); } }
function f(&$a) { return array_map(fn($x) => $x + 1, $a); }
"""
GO = """package m
import (
	"fmt"
	q "a/b"
)
type S struct { a int }
type I interface { F() }
func (s *S) Do(a int, b string) (int, error) {
	x := fmt.Sprint(a)
	if x == "" {
		return 1, nil
	} else {
		y = 2
	}
	for i := 0; i < 3; i++ {
		fmt.Println(i)
	}
	return 0, err
}
"""
TEST = """import unittest
from pkg.a import f, C

def test_f(x: int = 1):
    helper = C()
    assert f(x).total == helper.go(2)

class TestC(unittest.TestCase):
    def test_go(self):
        @wraps
        def inner(): return C.go
        self.assertTrue(inner())
    def other(self): return missing

def check(): return f
"""
SAMPLES = [("tests/test_a.py", "python", TEST), ("pkg/a.py", "python", PY), ("web/a.js", "javascript", JS), ("web/b.ts", "typescript", TS), ("p/a.php", "php", PHP), ("g/a.go", "go", GO)]


def _files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *s) for i, s in enumerate(SAMPLES)], "file_id bigint, path string, lang string, source string")


def code_function_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.function_metrics(nodes(_files(spark))).drop("file_id", "fn")


def code_class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.class_metrics(nodes(_files(spark))).drop("file_id")


def code_file_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.file_metrics(nodes(_files(spark))).drop("file_id")


def code_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.code_units(nodes(_files(spark))).drop("file_id")


def code_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.imports(nodes(_files(spark))).select("file_id", "name")


def code_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.definitions(nodes(_files(spark)))


def code_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark)
    return metrics.chunks(nodes(files), files).select("file", "name", "start_line", "end_line", "source")


def code_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.references(nodes(_files(spark)))


def code_test_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.test_references(nodes(_files(spark)))


def code_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.wide(metrics.function_metrics(nodes(_files(spark))).withColumnRenamed("path", "file"))


def code_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Analysis(_files(spark)).violations


def code_strict_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With 0 as the limit of each metric that applies, so that every check of files, functions and classes speaks; the graph's
    limits stay away."""
    graphs = ("cycle_size", "indirect_dependencies", "dependency_depth")
    return Analysis(_files(spark), {lang: {k: None if v is None or k in graphs else 0 for k, v in x.items()} for lang, x in load_thresholds([]).items()}).violations


def code_metric_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Analysis(_files(spark)).values.groupBy("metric", "value").agg(F.count("*").alias("n"))


def code_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.percentiles(Analysis(_files(spark)).values)


def code_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Analysis(_files(spark)).totals


QUERIES = {
    f.__name__: f
    for f in (
        code_function_metrics, code_class_metrics, code_file_metrics, code_units, code_imports, code_definitions, code_chunks, code_references, code_test_references, code_wide,
        code_violations, code_strict_violations, code_metric_values, code_statistics, code_totals,
    )
}
#: What the sources import, by hand.
_IMPORTS = [(0, "unittest"), (0, "pkg.a"), (1, "os"), (1, "sys"), (1, ".models"), (1, "abc"), (2, "./x.js"), (4, "A\\B\\C"), (4, "D"), (5, "fmt"), (5, "a/b")]
ORACLES = code_sql.oracles(SAMPLES, "SELECT file_id::BIGINT AS file_id, name FROM (VALUES " + ", ".join(f"({i}, '{x}')" for i, x in _IMPORTS) + ") t(file_id, name)")
