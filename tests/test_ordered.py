"""Ordered and set operators against plain loops, with hot keys in slices, ties, nulls and empty tables."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from gristmill.operators import lattice as lat
from gristmill.operators.ordered import asof_join, carry_last, covered, global_rank, interval_join, islands, running_sum
from gristmill.operators.stats import percentiles

T0 = datetime(2024, 1, 1)


def moments(r, n):
    """(key, time, id): half of all rows have one key; some times tie, some are null."""
    return [(1 if r.random() < 0.5 else r.choice([None, 2, 3, 4]), None if r.random() < 0.03 else T0 + timedelta(minutes=r.randint(0, 6_000)), i) for i in range(n)]


def of_key(rows):
    out = defaultdict(list)
    for k, t, i in rows:
        if t is not None:
            out[k].append((t, i))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("width", ["1 hour", "1 day", "365 days"])
@pytest.mark.parametrize("inclusive", [True, False])
def test_carry_last(spark, width, inclusive):
    rows = moments(random.Random(1), 400)
    df = spark.createDataFrame(rows, "k bigint, t timestamp, i bigint").repartition(4)
    got = carry_last(df, ["k"], "t", ["i"], F.when(F.col("i") % 5 == 0, F.col("i")), "last", inclusive, width)
    want = []
    for k, own in of_key(rows).items():
        last = None
        for t, i in own:
            now = i if i % 5 == 0 else last
            want.append((k, t, i, now if inclusive else last))
            last = now
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("width", ["1 hour", "365 days"])
def test_asof_join(spark, width):
    left, right = moments(random.Random(2), 200), moments(random.Random(3), 200)
    a = spark.createDataFrame(left, "k bigint, t timestamp, i bigint")
    b = spark.createDataFrame(right, "k bigint, t2 timestamp, j bigint")
    got = {r["i"]: r["match"] and r["match"]["j"] for r in asof_join(a, b, ["k"], "t", "t2", ["j"], width).collect()}
    near = of_key(right)
    assert got == {i: None if t is None or k is None else max(((u, j) for u, j in near.get(k, []) if u <= t), default=(None, None))[1] for k, t, i in left}
    assert [r["match"] for r in asof_join(a, b.where("j < 0"), ["k"], "t", "t2", ["j"]).collect()] == [None] * 200 and asof_join(a.where("i < 0"), b, ["k"], "t", "t2", ["j"]).count() == 0


@pytest.mark.parametrize("width", ["1 hour", "365 days"])
def test_islands(spark, width):
    rows = moments(random.Random(4), 300)
    got = islands(spark.createDataFrame(rows, "k bigint, t timestamp, i bigint"), ["k"], "t", ["i"], "40 minutes", width)
    want = []
    for k, own in of_key(rows).items():
        start = last = None
        for t, i in own:
            start = t if last is None or t - last > timedelta(minutes=40) else start
            last = t
            want.append((k, t, i, start))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize(("base", "bin_rows"), [(1, 100_000), (7, 3), (1000, 20)])
def test_interval_join(spark, base, bin_rows):
    r = random.Random(5)

    def spans(n):
        out = []
        for i in range(n):
            a = r.choice([50, r.randint(-200, 300)])
            out.append((r.choice([None, 1, 1, 2]), i, None if r.random() < 0.03 else a, a + r.choice([0, 0, 1, 5, 40, 3_000, -2])))
        return out

    left, right = spans(120), spans(120)
    a = spark.createDataFrame(left, "k bigint, l bigint, l_from bigint, l_to bigint").repartition(3)
    b = spark.createDataFrame(right, "k bigint, r bigint, r_from bigint, r_to bigint").repartition(3)
    meet = lambda x, y: None not in (x[2], y[2]) and x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3]
    got = interval_join(a, b, ["k"], base, bin_rows)
    assert sorted((x["l"], x["r"]) for x in got.collect()) == sorted((x[1], y[1]) for x in left for y in right if x[0] is not None and x[0] == y[0] and meet(x, y))
    free = interval_join(a.drop("k"), b.drop("k"), [], base, bin_rows)
    assert sorted((x["l"], x["r"]) for x in free.collect()) == sorted((x[1], y[1]) for x in left for y in right if meet(x, y))
    plan = free._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert interval_join(a.where("l < 0"), b, ["k"], base).count() == 0


@pytest.mark.parametrize(("base", "bin_rows"), [(1, 100_000), (7, 3), (1000, 20)])
def test_covered(spark, base, bin_rows):
    """Numbers of spans and the smallest owner are those of all pairs, without a join of points with spans."""
    r = random.Random(9)
    points = [(i, r.choice([50, None, *range(-200, 300)]), r.choice([None, 1, 2, 3, 4])) for i in range(150)]
    points += points[:5]
    spans = [(a := r.choice([50, r.randint(-200, 300)]), None if r.random() < 0.03 else a + r.choice([0, 0, 1, 5, 40, 3_000, -2]), r.choice([None, 1, 1, 2, 3, 4, 5])) for _ in range(150)]
    got = covered(spark.createDataFrame(points, "i bigint, at bigint, own bigint").repartition(3), spark.createDataFrame(spans, "r_from bigint, r_to bigint, other bigint"), base, bin_rows)
    want = Counter()
    first = {}
    for i, at, own in points:
        for a, b, other in spans:
            if None not in (at, own, b, other) and a <= at <= b and own != other:
                want[i] += 1
                first[i] = min(other, first.get(i, other))
    assert {x["i"]: (x["n"], x["first"]) for x in got.collect()} == {i: (n, first[i]) for i, n in want.items()} and len(want) > 50
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "strategy=broadcast" in plan


def test_running_sum(spark):
    r = random.Random(6)
    rows = [(r.choice(["a", "a", "a", "b", None, "c"]), i, r.randint(0, 9)) for i in range(500)]
    for size in ("10000", "9"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = running_sum(spark.createDataFrame(rows, "g string, i bigint, n bigint").repartition(5), ["g"], [F.desc("i")], "n").collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        total, want = Counter(), []
        for g, i, n in sorted(rows, key=lambda x: -x[1]):
            total[g] += n
            want.append((g, i, n, total[g]))
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_global_rank(spark):
    rows = [(random.Random(i).randint(0, 20), i) for i in range(400)]
    df = global_rank(spark.createDataFrame(rows, "v bigint, i bigint").repartition(6), [F.desc("v"), F.asc("i")])
    assert [r["i"] for r in sorted(df.collect(), key=lambda r: r["rank"])] == [i for _, i in sorted(rows, key=lambda x: (-x[0], x[1]))]
    assert sorted(r["rank"] for r in df.collect()) == list(range(1, 401)) and "Window" not in df._jdf.queryExecution().executedPlan().toString()
    assert global_rank(spark.createDataFrame([], "v bigint"), [F.asc("v")]).count() == 0


def test_percentiles_without_a_window(spark):
    r = random.Random(7)
    rows = [(r.choice(["x", "x", "x", "y", None]), r.choice([5, r.randint(-50, 50)])) for _ in range(700)]
    found = percentiles(spark.createDataFrame(rows, "metric string, value bigint"))
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    for row in found.collect():
        own = sorted(v for m, v in rows if m == row["metric"])
        assert (row["n"], row["max"]) == (len(own), own[-1]) and all(row[f"p{p}"] == own[-(-len(own) * p // 100) - 1] for p in (50, 90, 95, 99))


def test_lattice(spark):
    r = random.Random(8)
    rows = [(r.choice(["p", "q", None]), r.choice([1, 2]), r.choice("xyz"), r.randint(0, 9), r.choice([None, *range(6)])) for _ in range(300)]
    df = spark.createDataFrame(rows, "a string, b bigint, c string, v bigint, d bigint")
    dims = ["a", "b", "c"]
    for sets in (None, [("a",), ("b", "c"), ()]):
        want = []
        for level in sets if sets is not None else [c for k in range(4) for c in combinations(dims, k)]:
            groups = defaultdict(list)
            for row in rows:
                groups[tuple(row[dims.index(d)] if d in level else None for d in dims)].append(row)
            bits = sum(1 << i for i, d in enumerate(reversed(dims)) if d not in level)
            want += [(*g, bits, len(own), sum(x[3] for x in own), len({x[4] for x in own} - {None})) for g, own in groups.items()]
        assert sorted(map(repr, map(tuple, lat.lattice(df, dims, ["v"], "d", sets).collect()))) == sorted(map(repr, want))


def test_sketches_merge(spark):
    df = spark.range(20_000).select((F.col("id") % 7).alias("g"), (F.col("id") % 9_000).alias("v"))
    stored = lat.sketches(df, ["g"], "v").cache()
    one = lat.merged(stored.withColumn("all", F.lit(1)), ["all"]).first()
    assert one["low"] <= 9_000 <= one["high"] and one["high"] - one["low"] < 500
    assert all(r["low"] <= r["n"] <= r["high"] for r in lat.merged(stored, ["g"]).join(df.groupBy("g").agg(F.countDistinct("v").alias("n")), "g").collect())


def test_snapshot_diff(spark):
    r = random.Random(9)
    old, new = ([(r.choice(["a", "b", None, "c"]), r.choice([1, None])) for _ in range(n)] for n in (60, 80))
    a, b = (spark.createDataFrame(x, "s string, n bigint") for x in (old, new))
    got = {(x["s"], x["n"]): (x["removed"], x["added"], x["kept"]) for x in lat.snapshot_diff(a, b, ["s", "n"]).collect()}
    c, d = Counter(old), Counter(new)
    assert got == {k: (max(0, c[k] - d[k]), max(0, d[k] - c[k]), min(c[k], d[k])) for k in {*c, *d}}
    assert sum(x[0] for x in got.values()) == a.exceptAll(b).count() and sum(x[2] for x in got.values()) == a.intersectAll(b).count()


def test_shredded(spark):
    df = spark.createDataFrame([(1, '{"k": 3, "s": "x"}'), (2, "{"), (3, None), (4, '{"k": "word"}'), (5, "[1]"), (6, "")], "i bigint, props string")
    got = {r["i"]: (r["props_kind"], r["k"], r["s"]) for r in lat.shredded(df, "props", {"k": "bigint", "s": "string"}).collect()}
    assert got == {1: ("OBJECT<k: BIGINT, s: STRING>", 3, "x"), 2: ("bad", None, None), 3: ("null", None, None), 4: ("OBJECT<k: STRING>", None, None), 5: ("ARRAY<BIGINT>", None, None), 6: ("bad", None, None)}
    assert lat.json_schema(df.where("i in (1, 2, 3)"), "props") == "OBJECT<k: BIGINT, s: STRING>"
