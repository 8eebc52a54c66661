"""Streams with retraction and sessions against plain loops over what came."""

import random

from pyspark.sql import functions as F

from gristmill.streaming.incremental import current_files, current_nodes, node_stream
from gristmill.streaming.retraction import changes, totals
from gristmill.streaming.runs import run_available, written
from gristmill.streaming.sessions import sessions

FILES = "file_id bigint, path string, lang string, source string"


def test_nodes_follow_the_files(spark, tmp_path):
    """Changed, deleted and set back files: nodes are those of the last contents, and each content is parsed once."""
    runs = [
        [(0, "a.py", "python", "x = 1\n"), (1, "b.py", "python", "y = 2\n"), (2, "c.py", "python", "def f():\n    pass\n")],
        [(3, "a.py", "python", "x = 1\nz = 2\n"), (4, "b.py", "python", None), (5, "c.py", "python", "def f():\n    pass\n"), (6, "d.py", "python", "d = 1\n"), (7, "d.py", "python", "d = 2\n")],
        [(8, "a.py", "python", "x = 1\n"), (9, "b.py", "python", "y = 3\n"), (1, "b.py", "python", "y = 2\n"), (10, "c.py", "python", None)],
    ]
    now = {}
    for k, rows in enumerate(runs):
        spark.createDataFrame(rows, FILES).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(FILES).parquet(str(tmp_path / "in"))
        node_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
        for i, path, _, source in rows:
            if i >= now.get(path, (-1, None))[0]:
                now[path] = (i, source)
        live = {p: s for p, (_, s) in now.items() if s is not None}
        assert {r["path"] for r in current_files(spark, str(tmp_path / "out")).collect()} == set(live), k
        found = current_nodes(spark, str(tmp_path / "out"))
        assert {r["path"]: r["n"] for r in found.where("type = 'assignment'").groupBy("path").agg(F.count("*").alias("n")).collect()} == {p: s.count("=") for p, s in live.items() if "=" in s}
    all_nodes = spark.read.parquet(str(tmp_path / "out")).where("type = 'module'").groupBy("path").count().collect()
    assert sorted(map(tuple, all_nodes)) == [("a.py", 2), ("b.py", 2), ("c.py", 1), ("d.py", 1)]


def test_changes(spark, tmp_path):
    """Sums of signed rows are those of the last versions, whatever the order, with repeats, deletions and nulls."""
    r = random.Random(6)
    schema = "k bigint, version bigint, deleted boolean, kind string, n bigint"
    now = {}
    for _ in range(4):
        rows = [(r.choice([None, *range(15)]), r.choice([None, *range(12)]), r.random() < 0.3, r.choice(["x", "y", None]), r.randint(0, 9)) for _ in range(40)]
        rows += rows[:3]
        spark.createDataFrame(rows, schema).repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
        run_available(changes(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "k", ["kind", "n"]), str(tmp_path / "out"), str(tmp_path / "state"))
        best = {}
        for k, version, deleted, kind, n in rows:
            if version is not None and (k not in now or version > now[k][0]):
                best.setdefault(k, []).append((version, not deleted, kind, n))
        for k, found in best.items():
            top = max(v for v, *_ in found)
            now[k] = min((x for x in found if x[0] == top), key=lambda x: tuple((y is not None, str(type(y)), y) for y in x[1:]))
        want = {}
        for _, live, kind, n in now.values():
            if live:
                files, total = want.get(kind, (0, 0))
                want[kind] = files + 1, total + n
        got = totals(written(spark, str(tmp_path / "out")), ["kind"], ["n"]).collect()
        assert {x["kind"]: (x["files"], x["n"]) for x in got} == want


def test_sessions_of_a_table(spark):
    """A table is a stream without lateness."""
    rows = [(1, "2024-01-01 00:00:00", 1.0), (1, "2024-01-01 00:09:59", 2.0), (1, "2024-01-01 00:19:59", 4.0), (1, "2024-01-01 00:30:00", 8.0), (None, "2024-01-01 00:00:00", 5.0), (2, None, 9.0)]
    events = spark.createDataFrame(rows, "u bigint, ts string, v double").withColumn("ts", F.to_timestamp("ts"))
    got = sessions(events, "u", "ts", "v", "10 minutes", "0 seconds").select("u", F.date_format("start", "mm:ss"), F.date_format("end", "mm:ss"), "n", "total").collect()
    assert sorted(map(str, (tuple(x) for x in got))) == sorted(map(str, [(1, "00:00", "29:59", 3, 7.0), (1, "30:00", "40:00", 1, 8.0), (None, "00:00", "10:00", 1, 5.0)]))
