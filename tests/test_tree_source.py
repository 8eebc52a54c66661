"""The data source and the table functions: 100,000 files, batch and stream."""

import os
import time

import pytest

from gristmill.sources import tree_source
from gristmill.sources.table_functions import register
from gristmill.sources.tree_source import SourceTree, _Tree


@pytest.fixture(scope="module")
def big(tmp_path_factory):
    """100,000 files: 60,000 in one flat folder, the others in 200 folders of three levels, some of them not to be entered."""
    top = tmp_path_factory.mktemp("tree")
    want = set()

    def put(folder, name, entered=True):
        with open(f"{top}/{folder}/{name}", "w") as f:
            f.write("x")
        if entered and name.endswith((".py", ".GO")):
            want.add(f"{folder}/{name}".lstrip("/"))

    os.makedirs(top / "flat")
    for i in range(60_000):
        put("flat", f"f{i}" + (".py" if i % 2 else ".txt"))
    for a in range(200):
        folder = f"d{a % 10}/" + ("node_modules" if a % 40 == 7 else ".git" if a % 40 == 8 else f"e{a}") + f"/g{a % 3}"
        os.makedirs(top / folder, exist_ok=True)
        for i in range(200):
            put(folder, f"m{a}_{i}.py" if i % 3 else f"m{a}_{i}.GO", a % 40 not in (7, 8))
    put("", "top.py")
    put("", ".py")
    want.discard(".py")
    os.symlink(top / "flat", top / "d0" / "loop")
    return str(top), want


@pytest.mark.parametrize("folders", ["1", "500"])
def test_batch(spark, big, folders):
    top, want = big
    spark.dataSource.register(SourceTree)
    found = spark.read.format("source_tree").option("folders", folders).option("content", "false").load(top)
    rows = found.select("path", "lang", "n_bytes", "source").collect()
    assert len(rows) == len(want) and {r["path"] for r in rows} == want
    assert {(r["lang"], r["n_bytes"], r["source"]) for r in rows} == {("python", 1, None), ("go", 1, None)}
    planned = _Tree({"path": top, "folders": folders}).planned()
    assert sum(p.folder == "flat" and p.of == 6 and not p.deep for p in planned) == (6 if folders == "500" else 0) and len(planned) < 1000


def test_stream(spark, tmp_path):
    spark.dataSource.register(SourceTree)
    (tmp_path / "in" / "a").mkdir(parents=True)
    (tmp_path / "in" / "a" / "x.py").write_bytes(b"caf\xc3\xa9 \xff")
    (tmp_path / "in" / "y.txt").write_text("no")
    stream = spark.readStream.format("source_tree").option("settle", "0").load(str(tmp_path / "in"))
    query = stream.writeStream.format("memory").queryName("tree_files").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        query.processAllAvailable()
        (tmp_path / "in" / "b.py").write_text("new")
        (tmp_path / "in" / "a" / "x.py").write_text("changed")
        time.sleep(0.1)
        for _ in range(50):
            query.processAllAvailable()
            rows = spark.sql("SELECT path, source FROM tree_files").collect()
            if len(rows) >= 3:
                break
            time.sleep(0.2)
    finally:
        query.stop()
    assert sorted(map(tuple, rows)) == [("a/x.py", "café �"), ("a/x.py", "changed"), ("b.py", "new")]


def test_empty_tree(spark, tmp_path):
    spark.dataSource.register(SourceTree)
    assert spark.read.format("source_tree").load(str(tmp_path)).count() == 0


def test_large_folders_are_dealt_out(tmp_path, monkeypatch):
    monkeypatch.setattr(tree_source, "FILES_A_TASK", 3)
    for i in range(10):
        (tmp_path / f"f{i}.py").write_text(str(i))
    tree = _Tree({"path": str(tmp_path)})
    parts = tree.planned()
    got = [r[0] for p in parts for r in tree.rows(p)]
    assert len(parts) == 4 and sorted(got) == sorted(f"f{i}.py" for i in range(10))


def test_table_functions(spark):
    register(spark)
    pages = spark.createDataFrame([(1, "<a><b></b></a>", "x"), (2, None, "x"), (None, "<i>", "x")], "page_id bigint, html string, type string")
    got = spark.sql("SELECT * FROM tag_nodes(TABLE({pages}) PARTITION BY page_id)", pages=pages).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, 0, 1, None, 0, "a"), (1, 1, 1, 0, 1, "b"), (None, 0, 0, None, 0, "i")]))
    files = spark.createDataFrame([("a.py", "python", "x = 1\n"), ("b.go", "go", None)], "path string, lang string, source string")
    kinds = spark.sql("SELECT path, count(*) AS n FROM tree_nodes(TABLE({files}) PARTITION BY path) WHERE type = 'assignment' GROUP BY path", files=files).collect()
    assert [tuple(r) for r in kinds] == [("a.py", 1)]
