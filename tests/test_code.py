"""Parsers, metrics over nodes, imports, definitions, coverage and the whole analysis on small sources."""

import pytest
from pyspark.sql import functions as F

from gristmill import cli
from gristmill.operators import metrics
from gristmill.plans.analysis import Analysis
from gristmill.plans.code import GO, JS, PHP, PY, TS
from gristmill.sources.nodes import nodes, parse_errors
from gristmill.sources.parsers import braces, python

SOURCES = [("pkg/a.py", "python", PY), ("web/a.js", "javascript", JS), ("web/b.ts", "typescript", TS), ("p/a.php", "php", PHP), ("g/a.go", "go", GO), ("bad.py", "python", "def ("), ("none.py", "python", "")]


@pytest.fixture(scope="module")
def tree(spark):
    files = spark.createDataFrame([(i, *r) for i, r in enumerate(SOURCES)], "file_id bigint, path string, lang string, source string")
    return files, nodes(files).cache()


def test_function_metrics(tree):
    rows = {(r["path"], r["name"]): r for r in metrics.function_metrics(tree[1]).collect()}
    pick = lambda k, *m: tuple(rows[k][x] for x in m)
    f = ("pkg/a.py", "f")
    # what the rules say of the small example: statements count an assignment twice
    assert pick(f, "statements", "arguments", "arguments_positional", "arguments_keyword_only", "boolean_parameters", "max_indentation", "branches", "returns", "calls", "local_variables", "max_return_values", "nested_function_depth", "decorators", "max_try_block_statements") == (5, 3, 2, 1, 1, 1, 1, 1, 1, 2, 2, 0, 0, 0)
    go = ("pkg/a.py", "go")
    assert rows[go]["inside_class"] and pick(go, "arguments", "boolean_parameters", "decorators", "max_indentation", "nested_function_depth", "returns", "max_return_values", "max_try_block_statements", "local_variables", "calls") == (2, 1, 1, 3, 1, 4, 4, 4, 1, 1)
    assert ("pkg/a.py", "inner") not in rows
    js = ("web/a.js", "go")
    assert pick(js, "branches", "calls", "returns", "max_indentation") == (2, 3, 1, 4)  # if, else, if, else
    assert pick(("web/a.js", "gen"), "branches", "calls", "local_variables", "max_try_block_statements") == (1, 4, 1, 1)
    assert pick(("web/b.ts", "m"), "arguments", "calls") == (2, 1) and pick(("web/b.ts", "f"), "boolean_parameters") == (1,)
    assert pick(("p/a.php", "m"), "arguments", "boolean_parameters", "branches", "calls", "local_variables", "returns") == (2, 1, 2, 2, 1, 1)
    assert pick(("g/a.go", "Do"), "branches", "calls", "returns", "max_return_values", "arguments") == (1, 2, 2, 2, 0)


def test_class_and_file_metrics(tree):
    classes = {(r["path"], r["name"]): r["methods"] for r in metrics.class_metrics(tree[1]).collect()}
    # a decorated method is a child of its decorated definition, not of the class body
    assert classes == {("pkg/a.py", "P"): 1, ("pkg/a.py", "C"): 0, ("web/a.js", "A"): 2, ("web/b.ts", "C"): 1, ("p/a.php", "T"): 1}
    got = {r["file"]: (r["functions"], r["interface_types"], r["concrete_types"], r["imports"]) for r in metrics.file_metrics(tree[1]).collect()}
    # a relative import counts its names less one
    assert got == {"pkg/a.py": (3, 1, 1, 4), "web/a.js": (3, 0, 1, 1), "web/b.ts": (2, 1, 1, 0), "p/a.php": (2, 1, 1, 2), "g/a.go": (1, 1, 1, 1), "none.py": (0, 0, 0, 0), "bad.py": (0, 0, 0, 0)}


def test_first_parameter_with_a_type(spark):
    files = spark.createDataFrame([(0, "a.py", "python", "def f(a: int, b: str = 'x', *, c: bool = True): pass\ndef g(q: int = 3): pass\n")], "file_id bigint, path string, lang string, source string")
    got = {r["name"]: (r["arguments"], r["arguments_positional"], r["arguments_keyword_only"], r["boolean_parameters"]) for r in metrics.function_metrics(nodes(files)).collect()}
    assert got == {"f": (3, 2, 1, 1), "g": (1, 1, 0, 0)}


def test_tests_by_content(spark):
    """Python alone, an import at the top, a function at any depth."""
    sources = [
        ("a.py", "python", "import pytest\nclass A:\n    def test_x(self): pass\n"), ("b.py", "python", "def f():\n    import unittest\n    def test_x(): pass\n"), ("c.py", "python", "from unittest import mock\nx = 1\n"),
        ("d.py", "python", "from my import pytest_tools\ndef test_y(): pass\n"), ("e.js", "javascript", "import x from 'pytest';\nfunction test_x() {}\n"), ("f.py", "python", "import pytest\nclass test_z: pass\n"),
    ]
    files = spark.createDataFrame([(i, *s) for i, s in enumerate(sources)], "file_id bigint, path string, lang string, source string")
    assert sorted(r["file_id"] for r in metrics.test_files(nodes(files)).collect()) == [0, 3]


def test_errors_are_kept_apart(tree):
    assert [r["path"] for r in parse_errors(tree[0]).collect()] == ["bad.py"]
    assert [r["type"] for r in tree[1].where("path = 'bad.py'").orderBy("pre").collect()] == ["module", "ERROR"]


def test_python_parses_on():
    """A broken line takes nothing else with it; every other node keeps its place."""
    whole = "import os\n\ndef f(a):\n    x = 1\n    return x\n\nclass C:\n    def m(self):\n        return 2\n\ndef g():\n    return f(3)\n"
    for broken in ("    x = = 1", "    x = (1", "    for in y:", "    x = 'open", "    ) ]", "    print 'a'", "  x = 1"):
        rows = python.parse(whole.replace("    x = 1", broken))
        at = {r["text"]: r["start_byte"] for r in rows if r["field"] == "name"}
        assert {"f", "C", "m", "g"} <= set(at) and any(r["type"] == "ERROR" for r in rows), broken
        assert whole.replace("    x = 1", broken).encode()[at["g"] : at["g"] + 1] == b"g"
    assert not any(r["type"] == "ERROR" for r in python.parse(whole))
    rows = python.parse("def f(:\n    return 1\n\ndef g():\n    return 2\n")
    assert "g" in {r["text"] for r in rows if r["field"] == "name"}
    for bad in ("(", "def (", "\0", '"' * 3, "x\n  y\n z", "if", ")" * 50, "    a", "\\"):
        assert python.parse(bad)[0]["type"] == "module"


def test_units_imports_definitions(tree):
    units = {(r["path"], r["kind"], r["name"]) for r in metrics.code_units(tree[1]).collect()}
    assert {("pkg/a.py", "module", "a"), ("pkg/a.py", "function", "f"), ("pkg/a.py", "class", "C"), ("pkg/a.py", "method", "go"), ("pkg/a.py", "function", "inner"), ("web/a.js", "method", "constructor"), ("p/a.php", "method", "m")} <= units
    found = {(r["file_id"], r["name"]) for r in metrics.imports(tree[1]).collect()}
    assert found == {(0, "os"), (0, "sys"), (0, ".models"), (0, "abc"), (1, "./x.js"), (3, "A\\B\\C"), (3, "D"), (4, "fmt"), (4, "a/b")}
    assert {n for i, n in ((r["file_id"], r["name"]) for r in metrics.imports(tree[1], compatible=True).collect()) if i in (1, 3)} == set()
    own = {(r["name"], r["kind"], r["containing_class"]) for r in metrics.definitions(tree[1]).where("file = 'pkg/a.py'").collect()}
    assert own == {("f", "function", None), ("C", "class", None), ("go", "method", "C")}


def test_chunks_are_cut_by_bytes(spark):
    files = spark.createDataFrame([(0, "a.py", "python", "# äöü\ndef f():\n    return 'é'\n")], "file_id bigint, path string, lang string, source string")
    assert [r["source"] for r in metrics.chunks(nodes(files), files).collect()] == ["def f():\n    return 'é'"]


@pytest.mark.parametrize("lang,source", [("python", PY), ("javascript", JS), ("typescript", TS), ("php", PHP), ("go", GO)])
def test_trees_are_well_formed(lang, source):
    rows = python.parse(source) if lang == "python" else braces.parse(lang, source)
    for i, r in enumerate(rows):
        assert r["pre"] == i and r["last"] >= i and len(r["anc"]) == len(r["anc_types"])
        assert r["anc"] == ([] if r["parent"] is None else rows[r["parent"]]["anc"] + [r["parent"]])
        assert r["anc_types"] == [rows[a]["type"] for a in r["anc"]] and all(rows[a]["last"] >= r["last"] for a in r["anc"])


@pytest.mark.parametrize("source", ["", "{", "(((", "function f(", "class", "if (", "'open", "/* open", "switch (a) { case", "a => {", "=", "x = = ;", "}"])
def test_broken_sources_end(source):
    for lang in ("javascript", "typescript", "php", "go"):
        braces.parse(lang, ("<?php " if lang == "php" else "") + source)


def test_folder(spark, tmp_path, capsys):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "node_modules").mkdir()
    body = "    total = 0\n    for x in items:\n        total += x\n    if total:\n        return total\n    return 1\n"
    (tmp_path / "pkg/__init__.py").write_text("")
    (tmp_path / "pkg/a.py").write_text("from pkg import b\nimport pkg.b\n\ndef first(items):\n" + body)
    (tmp_path / "pkg/b.py").write_text("def second(items):\n" + body + "\ndef lost():\n    pass\n")
    (tmp_path / "pkg/_c.py").write_text("def many(a, b, c, d, e, f):\n    return 1\n")
    (tmp_path / "pkg/test_a.py").write_text("from pkg.a import first\n\ndef test_first():\n    assert first([1]) == second\n")
    (tmp_path / "node_modules/x.js").write_text("function f() {}")
    code = cli.main(["check", str(tmp_path)])
    out = capsys.readouterr().out
    assert code == 1 and "VIOLATION:positional_args:pkg/_c.py:1:many" in out and "VIOLATION:duplication:" in out and "GATE_FAILED:test_coverage: 50%" in out
    assert "5 files" in out
    assert cli.main(["show-tests", str(tmp_path), "--untested"]) == 0
    out = capsys.readouterr().out
    assert "TESTED:pkg/a.py:first <- [test_first]" in out.splitlines() and "UNTESTED:pkg/b.py:9:lost" in out.splitlines()
    assert "TESTED:pkg/b.py:second <- [test_first]" in out
    assert cli.main(["dry", str(tmp_path)]) == 0 and "pkg/a.py:4 <-> pkg/b.py:1 (" in capsys.readouterr().out
    assert cli.main(["stats", str(tmp_path)]) == 0 and "Statements per function" in capsys.readouterr().out
    assert cli.main(["viz", str(tmp_path), "--out", str(tmp_path / "g.dot")]) == 0
    assert '"pkg.a" -> "pkg.b"' in (tmp_path / "g.dot").read_text()


def test_snapshot_of_folder(spark, tmp_path, capsys):
    (tmp_path / "a.py").write_text("def f():\n    return 1\n")
    assert cli.main(["shrink-start", str(tmp_path), "--target", "statements=0"]) == 0
    assert cli.main(["shrink-check", str(tmp_path)]) == 1
    assert "GATE_FAILED:shrink: statements 1 > 0 (target not met)" in capsys.readouterr().out
    assert cli.main(["mimic", str(tmp_path)]) == 0 and "[thresholds]" in capsys.readouterr().out


def test_totals(spark, tree):
    got = Analysis(tree[0].where("lang = 'python'")).totals.first().asDict()
    assert (got["files"], got["code_units"], got["graph_nodes"]) == (3, 9, 3)
    assert got["statements"] == metrics.file_metrics(tree[1].where("lang = 'python'")).agg(F.sum("statements")).first()[0]


def test_stream(spark, tmp_path):
    """Files come twice; their nodes are written once a batch."""
    from gristmill.streaming.incremental import new_files, node_stream

    files = spark.createDataFrame([(0, "a.py", "python", "x = 1\n"), (1, "b.py", "python", "y = 2\n"), (2, "a.py", "python", "x = 1\n")], "file_id bigint, path string, lang string, source string")
    files.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(files.schema).parquet(str(tmp_path / "in"))
    node_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).where("type = 'module'").count() == 2
    # a later batch with a file that is known, one that has changed and a new one
    more = spark.createDataFrame([(3, "a.py", "python", "x = 1\n"), (4, "b.py", "python", "y = 3\n"), (5, "c.py", "python", "z = 1\n")], files.schema)
    more.write.mode("append").parquet(str(tmp_path / "in"))
    node_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).where("type = 'module'").groupBy("path").count().collect()
    assert sorted(map(tuple, got)) == [("a.py", 1), ("b.py", 2), ("c.py", 1)]
    known = spark.createDataFrame([("x",)], "content string")
    assert new_files(files, known).count() == 3
