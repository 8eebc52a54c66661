"""Operators against values computed by hand, and properties that must hold."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.functions import minhash, text
from gristmill.operators import coverage, duplication, graph, report, snapshot, stats, thresholds
from gristmill.sources import config, discovery


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_text(spark):
    assert one(spark, text.normalize_code(F.lit(" Foo  12\n\tBAR34x "))) == "foo n barnx"
    assert one(spark, text.line_count(F.lit("a\nb\n"))) == 3
    assert one(spark, text.slug(F.lit("9a.B"))) == "n9a_b" and one(spark, text.escape_html(F.lit('<a&"b">'))) == "&lt;a&amp;&quot;b&quot;&gt;"
    assert one(spark, text.candidate_list(F.array(*map(F.lit, "abcde")))) == "a, b, c, +2 more"


def test_hash_values():
    assert minhash.seeds(3).tolist() == [11400714819323198485, 4354685564936845354, 15755400384260043839]
    assert minhash.shingle_values("abc", 3).tolist() == [96354] and minhash.shingle_values("ab", 3).tolist() == [3105] and not len(minhash.shingle_values("", 3))
    assert minhash.hash64(np.array([96354], np.uint64), minhash.seeds(3))[0].tolist() == [419230460132757167, 17688888708887925549, 1192936154377423512]


def test_duplicates(spark):
    f1 = "def total(items):\n    s = 0\n    for x in items:\n        s += x\n    return s"
    f2 = "def total(values):\n    s = 10\n    for v in values:\n        s += v\n    return s"
    df = spark.createDataFrame([(1, f1), (2, f2), (3, f1), (4, "short"), (5, "\n" * 5)], "chunk_id bigint, source string")
    sigs = duplication.signatures(df).cache()
    got = {r["chunk_id"]: r["sig"] for r in sigs.collect()}
    assert set(got) == {1, 2, 3, 5} and sum(a == b for a, b in zip(got[1], got[2], strict=True)) == 66 and set(got[5]) == {-1}
    assert [tuple(r) for r in duplication.duplicate_pairs(sigs).collect()] == [(1, 3, 1.0)]
    assert {tuple(r) for r in duplication.candidates(sigs).collect()} == {(1, 3)}
    with pytest.raises(ValueError):
        duplication.candidates(sigs, bands=200)
    pairs = spark.createDataFrame([(1, 2, 0.8), (2, 3, 0.9)], "i bigint, j bigint, similarity double")
    alone = spark.createDataFrame([(1, 1, 1), (2, 2, 1), (3, 3, 1), (9, 9, 1)], "id bigint, rep bigint, n bigint")
    members = duplication.clusters(alone, pairs)
    assert {tuple(r)[:2] for r in members.collect()} == {(1, 1), (2, 1), (3, 1)}
    assert abs(duplication.cluster_summary(alone, pairs, members).first()["similarity"] - 1.7 / 3) < 1e-12


def test_duplicates_by_class(spark):
    """Pairs, clusters and means from classes are those of all pairs of signatures."""
    r = random.Random(8)
    bases = ["\n".join("".join(r.choice("abcd ") for _ in range(20)) for _ in range(8)) for _ in range(4)]
    texts = []
    for i in range(60):
        t = list(bases[i % 4])
        for _ in range(r.choice([0, 0, 2, 6, 30])):
            t[r.randrange(len(t))] = r.choice("wxyz")
        texts.append((i, "".join(t)))
    sigs = duplication.signatures(spark.createDataFrame(texts, "chunk_id bigint, source string")).cache()
    rows = {x["chunk_id"]: x["sig"] for x in sigs.collect()}
    alike = {(i, j): sum(a == b for a, b in zip(rows[i], rows[j], strict=True)) / 128 for i in rows for j in rows if i < j and any(rows[i][k : k + 8] == rows[j][k : k + 8] for k in range(0, 128, 8))}
    assert {tuple(x) for x in duplication.candidates(sigs).collect()} == set(alike)
    want = {p: s for p, s in alike.items() if s >= 0.7}
    assert {(x["i"], x["j"]): x["similarity"] for x in duplication.duplicate_pairs(sigs).collect()} == want and len(want) > 50
    root = {i: i for p in want for i in p}
    for _ in range(60):
        for a, b in want:
            root[a] = root[b] = min(root[a], root[b])
    members, reps = duplication.classes(sigs)
    pairs = duplication.class_pairs(reps)
    found = duplication.clusters(members, pairs)
    assert {x["id"]: x["cluster_id"] for x in found.collect()} == root
    for x in duplication.cluster_summary(members, pairs, found).collect():
        inside = [i for i, c in root.items() if c == x["cluster_id"]]
        assert x["n"] == len(inside)
        assert abs(x["similarity"] - sum(s for (i, _), s in want.items() if root[i] == x["cluster_id"]) / (len(inside) * (len(inside) - 1) / 2)) < 1e-9
    own = spark.createDataFrame([(i, "f" if i % 3 == 0 else "g") for i in range(60)], "chunk_id bigint, file string")
    assert {tuple(x)[:2] for x in duplication.about_file(duplication.duplicate_pairs(sigs), own, "f").collect()} == {p for p in want if p[0] % 3 == 0 or p[1] % 3 == 0}


def test_signatures_in_pieces(monkeypatch):
    """Long texts and many shingles, in pieces of any size."""
    r = random.Random(4)
    sets = [np.unique(np.array([r.randrange(10**6) for _ in range(n)], np.uint64)) for n in (0, 1, 700, 50, 3000)]
    seed = minhash.seeds(16)
    want = [minhash.hash64(s, seed).min(0).tolist() if len(s) else [2**64 - 1] * 16 for s in sets]
    for most in (1 << 15, 600, 7):
        monkeypatch.setattr(minhash, "VALUES", most)
        assert minhash.signatures(sets, seed).tolist() == want


def test_cycles(spark):
    """Components of random graphs against mutual reachability."""
    r = random.Random(12)
    for nodes, n in ((12, 14), (30, 45), (25, 90)):
        edges = {(f"m{r.randrange(nodes):02}", f"m{r.randrange(nodes):02}") for _ in range(n)}
        reach = {a: {a} for e in edges for a in e}
        for _ in range(nodes):
            for a, b in edges:
                for k in reach:
                    if a in reach[k]:
                        reach[k].add(b)
        want = set()
        for a in reach:
            ring = sorted(b for b in reach[a] if a in reach[b])
            if len(ring) > 1:
                want.add((a, ring[0], len(ring)))
        assert {tuple(x) for x in graph.cycles(spark.createDataFrame(sorted(edges), "src string, dst string")).collect()} == want
    assert graph.cycles(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_percentiles(spark):
    rows = [("a", v) for v in range(1, 11)] + [("b", 7)]
    got = {r["metric"]: tuple(r)[1:] for r in stats.percentiles(spark.createDataFrame(rows, "metric string, value bigint")).collect()}
    assert got == {"a": (10, 5, 9, 10, 10, 10), "b": (1, 7, 7, 7, 7, 7)}
    r = random.Random(1)
    values = [r.randrange(50) for _ in range(333)]
    got = stats.percentiles(spark.createDataFrame([("m", v) for v in values], "metric string, value bigint")).first()
    assert [got[f"p{p}"] for p in stats.PERCENTS] == [sorted(values)[-(-p * 333 // 100) - 1] for p in stats.PERCENTS]


@pytest.fixture(scope="module")
def small_graph(spark):
    modules = spark.createDataFrame([(m,) for m in ("a", "b", "c", "d", "e", "f", "main")], "module string")
    return modules, spark.createDataFrame([tuple(x) for x in ("ab", "bc", "ca", "cd", "de")], "src string, dst string")


def test_graph(spark, small_graph):
    modules, edges = small_graph
    reached = graph.reach(edges).cache()
    far = {r["module"]: (r["reach"], r["indirect"], r["eccentricity"]) for r in graph.indirect_dependencies(modules, edges, reached).collect()}
    assert far == {"a": (4, 3, 4), "b": (4, 3, 3), "c": (4, 2, 2), "d": (1, 0, 1), "e": (0, 0, 0), "f": (0, 0, 0), "main": (0, 0, 0)}
    assert {tuple(r) for r in graph.cycles(edges).collect()} == {("a", "a", 3), ("b", "a", 3), ("c", "a", 3)}
    assert graph.longest_path(edges) is None and graph.longest_path(edges.where("not (src = 'c' and dst = 'a')")) == 4 and graph.longest_path(edges.where("src = 'z'")) == 0
    assert [r[0] for r in graph.orphans(modules, edges).collect()] == ["f"]
    assert {tuple(r) for r in graph.degrees(modules, edges).where("module in ('c', 'f')").collect()} == {("c", 1, 2), ("f", 0, 0)}
    limits = {"cycle_size": 2, "indirect_dependencies": 2, "dependency_depth": 1}
    assert {(r["metric"], r["unit_name"]) for r in thresholds.graph_violations(modules, edges, limits).collect()} == {("cycle_size", "a -> b -> c"), ("indirect_dependencies", "a"), ("indirect_dependencies", "b")}


def test_coarsen(spark):
    modules = spark.createDataFrame([(m,) for m in ("p.a.x", "p.a.y", "p.b.z", "q")], "module string")
    edges = spark.createDataFrame([("p.a.x", "p.a.y"), ("p.a.x", "p.b.z")], "src string, dst string")
    m, e = graph.coarsen(modules, edges, 0.5)
    assert {r[0] for r in m.collect()} == {"p.a", "p.b", "q"} and [tuple(r) for r in e.collect()] == [("p.a", "p.b")]


def test_imports(spark):
    known = spark.createDataFrame([(m,) for m in ("pkg", "pkg.models", "pkg.engine.graph", "pkg.engine.util", "util")], "module string")
    asked = [("pkg.engine.graph", "..models", "pkg.models"), ("pkg.engine.graph", ".util", "pkg.engine.util"), ("pkg.engine.graph", "util", "util"), ("pkg.models", "engine.graph", "pkg.engine.graph"), ("util", "graph", "pkg.engine.graph"), ("pkg", ".models", None)]
    got = {(r["src"], r["name"]): r["dst"] for r in graph.resolve_imports(spark.createDataFrame([x[:2] for x in asked], "src string, name string"), known).collect()}
    assert got == {x[:2]: x[2] for x in asked if x[2]}
    names = spark.createDataFrame([("pkg/a.py",), ("pkg/__init__.py",), ("__init__.py",), ("a.b.js",)], "p string").select(graph.module_name(F.col("p")))
    assert [r[0] for r in names.collect()] == ["pkg.a", "pkg", "", "a.b"]


def test_components_are_a_partition(spark):
    r = random.Random(3)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(60)]
    got = {x["id"]: x["component"] for x in graph.connected(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(80):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == root


def test_coverage(spark):
    d = spark.createDataFrame([("run", "function", "m.py", 1, None), ("C", "class", "m.py", 2, None), ("go", "method", "m.py", 3, "C"), ("lost", "function", "m.py", 4, None)], "name string, kind string, file string, line int, containing_class string")
    refs = spark.createDataFrame([("test_m.py", "test_run", "run"), ("test_m.py", "test_run", "C")], "test_file string, test_name string, ref string")
    assert tuple(coverage.coverage_pct(d, refs).first()) == (4, 3, 75) and tuple(coverage.coverage_pct(d.where("line > 9"), refs).first()) == (0, 0, 100)
    assert [r["name"] for r in coverage.unreferenced(d, refs).collect()] == ["lost"]
    assert {r["name"]: r["tests"] for r in coverage.show_tests(d, refs).collect()} == {"run": "test_m.py::test_run", "C": "test_m.py::test_run", "go": "test_m.py::test_run", "lost": "UNTESTED"}


def test_config(spark, tmp_path):
    a, b, bad = tmp_path / "a.toml", tmp_path / "b.toml", tmp_path / "c.toml"
    a.write_text("[shared]\nstatements_per_file = 5\n[python]\npositional_args = 9\n[gate]\ncoverage = 70\nmin_similarity = 2\n")
    b.write_text("[thresholds]\nstatements_per_file = 6\nunknown = 1\ncalls_per_function = -1\n[go]\nstatements_per_file = 7\n")
    bad.write_text("[nonsense]\n[gate]\nduplication_enabled = false\n[shared]\nstatements_per_file = 1\n")
    got = config.load_thresholds([a, b, bad, tmp_path / "missing.toml"])
    assert (got["python"]["statements_per_file"], got["go"]["statements_per_file"], got["python"]["arguments_positional"], got["python"]["calls_per_function"], got["php"]["arguments_positional"]) == (6, 7, 9, 50, None)
    assert config.load_gate([a, bad]) == config.Gate(70, 0.7, False, True)
    assert any("[Python] [statements_per_file < 6]" in x for x in config.rules(got, "python")) and config.threshold_table(spark, got).where("threshold is null").count() == 15


def test_config_keys_by_section(tmp_path):
    """shared and thresholds take their own keys alone, a language's section any metric or alias."""
    f = tmp_path / "a.toml"
    f.write_text("[shared]\ncalls_per_function = 1\ntypes_per_file = 2\n[thresholds]\npositional_args = 3\narguments_positional = 4\nclasses_per_file = 5\nmax_indentation = 6\n[php]\nmax_indentation = 7\n[gate]\ntest_coverage_threshold = 11\n")
    got = config.load_thresholds([f])
    assert (got["python"]["calls_per_function"], got["python"]["concrete_types_per_file"], got["python"]["arguments_positional"], got["python"]["max_indentation_depth"], got["php"]["max_indentation_depth"]) == (50, 5, 4, 4, 7)
    assert config.load_gate([f]).coverage == 11
    python, php, go = (config.rules(got, x) for x in ("python", "php", "go"))
    assert python[1].startswith("RULE: [Python] [positional_args < 4] positional_args is the maximum number") and php[1].startswith("RULE: [Php] [arguments_per_function < 7]")
    assert "RULE: [Go] [min_similarity >= 0.70] min_similarity is the minimum similarity required to report duplicate code." in go and not any("try_block" in x for x in go + php)


def test_paths(spark):
    rows = ["src/a.py", ".git/a.py", "src/.hidden.py", "venv/x.py", "vendor/lib/a.go", "docs_x/a.ts", "a.JS", "a.txt", "src/gen/a_pb.py", "x/y/z.php"]
    df = spark.createDataFrame([(r,) for r in rows], "path string")
    got = {r["path"]: r["lang"] for r in discovery.source_paths(df, prefixes=("docs",), patterns=["vendor/lib", "*_pb.py", "x/**/z.php"]).collect()}
    assert got == {"src/a.py": "python", "src/.hidden.py": "python", "a.JS": "javascript"}
    assert discovery.ignore_patterns("# c\n\n a \nb/") == ["a", "b/"]
    flags = {p: one(spark, discovery.is_test_file(F.lit(p))) for p in ("test_a.py", "a_test.py", "conftest.py", "aTest.php", "a.spec.ts", "a_test.go", "a.go", "x.txt")}
    assert [p for p, v in flags.items() if not v] == ["a.go", "x.txt"]


def test_folders_are_listed(spark, tmp_path):
    """By the driver or by tasks, hidden and ignored folders and links to folders not entered."""
    names = ["a.py", "x/_b.py", "x/__init__.py", "x/y/c.go", "x/y/.hidden.ts", "x/y/z/d.php", ".git/e.py", "node_modules/f.js", "x/venv/g.py", "docs/h.py", "docs2/i.py", "gen/j.py", "x/notes.txt", "ü/k.py"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text(f"# {n}\n")
    (tmp_path / "loop").symlink_to(tmp_path / "x", target_is_directory=True)
    (tmp_path / ".gristmillignore").write_text("gen/\n")
    store = discovery.Store(tmp_path)
    want = {"a.py", "x/_b.py", "x/__init__.py", "x/y/c.go", "x/y/.hidden.ts", "x/y/z/d.php", "gen/j.py", "x/notes.txt", "ü/k.py", ".gristmillignore"}
    for most in (256, 2, 0):
        assert {r["path"] for r in discovery.listed(spark, store, ("docs",), most).collect()} - {"loop"} == want, most
    got = {r["path"]: (r["lang"], r["source"], r["n_bytes"]) for r in discovery.files(spark, tmp_path.as_uri(), ("docs",)).collect()}
    assert set(got) == want - {"gen/j.py", "x/notes.txt", ".gristmillignore"} and got["ü/k.py"] == ("python", "# ü/k.py\n", 10)


def test_reports(spark, small_graph, tmp_path):
    v = spark.createDataFrame([("a.py", 3, "f", "calls", "too many.", "Split.")], "file string, line int, unit_name string, metric string, message string, suggestion string")
    assert report.violation_lines(v).first()[0] == "VIOLATION:calls:a.py:3:f: too many. Split."
    assert report.mermaid(*small_graph).splitlines()[:2] == ["graph LR", '  a["a"]'] and "  c --> a" in report.mermaid(*small_graph).splitlines()
    assert report.dot(*small_graph).splitlines()[1:4] == ["  rankdir=LR;", "  node [shape=box];", '  "a";'] and '  "c" -> "a";' in report.dot(*small_graph)
    report.write_graph(tmp_path / "g.MD", *small_graph)
    assert (tmp_path / "g.MD").read_text() == "```mermaid\n" + report.mermaid(*small_graph) + "```\n"
    members = spark.createDataFrame([(1, "b.py", 9, "g"), (1, "a.py", 3, "f"), (1, "c.py", 1, "h")], "cluster_id bigint, file string, start_line int, name string")
    summary = spark.createDataFrame([(1, 3, 0.857)], "cluster_id bigint, n bigint, similarity double")
    assert [r[0] for r in report.duplication_lines(members, summary).collect()] == ["VIOLATION:duplication:a.py:3:f: 85% similar, 3 copies: [a.py:3, b.py:9, c.py:1]. Factor out repeated patterns into shared functions."]
    assert "[a.py:3, b.py:9, +1 more]" in report.duplication_lines(members, summary, 2).first()[0]
    assert report.coverage_line(50, 90, 2, 4) == "GATE_FAILED:test_coverage: 50% (threshold: 90%). 2 of 4 definitions lack test references."
    assert report.summary_line({"files": 2, "code_units": 3}) == "Analyzed: 2 files, 3 code_units"
    assert report.shrink_line("files", 3, 4, True) == "GATE_FAILED:shrink: files 4 > 3 (target not met)" and report.shrink_line("files", 3, 4, False).endswith("(constraint exceeded baseline)")
    with pytest.raises(ValueError):
        report.write_graph(tmp_path / "g.png", *small_graph)


def test_snapshot(spark, tmp_path):
    now = dict.fromkeys(snapshot.METRICS, 10)
    assert snapshot.parse_target("files=9", now) == ("files", 9)
    for wrong in ("files=10", "x=1", "files", "files=a"):
        with pytest.raises(ValueError):
            snapshot.parse_target(wrong, now)
    snapshot.save(tmp_path / "s.toml", "files", 9, now)
    assert snapshot.load(tmp_path / "s.toml") == ("files", 9, now) and snapshot.load(tmp_path / "none.toml") is None
    a, b = (spark.createDataFrame(list(x.items()), "metric string, value bigint") for x in (now, now | {"statements": 11}))
    assert {tuple(r) for r in snapshot.check(a, b, "files", 9).collect()} == {("files", 9, 10, True), ("statements", 10, 11, False)}


def test_checkpoints_must_be_shared():
    """Without spark.checkpoint.dir only a local master may go on."""
    from types import SimpleNamespace

    from gristmill.sources.tables import cut

    unset = SimpleNamespace(get=lambda key: None)
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        context = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: unset, master=master)
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            cut(SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=context)))
