"""Graph operators against plain searches, and the number of jobs of a long chain and ring."""

import random
from collections import deque

import pytest

from gristmill.operators import graph


def searched(nodes, edges):
    out = {n: set() for n in nodes}
    for a, b in edges:
        if a != b:
            out[a].add(b)
    far = {}
    for n in nodes:
        seen, todo = {n: 0}, deque([n])
        while todo:
            x = todo.popleft()
            for y in out[x]:
                if y not in seen:
                    seen[y] = seen[x] + 1
                    todo.append(y)
        far[n] = seen
    return far


def longest(nodes, edges):
    into = {n: {a for a, b in edges if b == n and a != b} for n in nodes}
    best, left = {}, set(nodes)
    while left:
        free = [n for n in left if into[n] <= best.keys()]
        if not free:
            return None
        for n in free:
            best[n] = max((best[a] + 1 for a in into[n]), default=0)
        left -= set(free)
    return max(best.values(), default=0)


def shapes():
    r = random.Random(3)
    name = lambda i: f"m{i:03d}"
    out = []
    for n, m in ((20, 26), (15, 60)):
        out.append([(name(r.randrange(n)), name(r.randrange(n))) for _ in range(m)])
    dag = [(name(a), name(b)) for a, b in (sorted(r.sample(range(25), 2)) for _ in range(45))]
    chain = [(name(i), name(i + 1)) for i in range(40)]
    ring = [(f"r{i:02d}", f"r{(i + 1) % 17:02d}") for i in range(17)]
    # a ring with a chain into it and out of it, two rings that share a node, a path back to its own start
    mixed = ring + [(f"a{i}", f"a{i + 1}") for i in range(9)] + [("a9", "r03"), ("r05", "b0"), ("b0", "b1")] + [("c0", "c1"), ("c1", "c0"), ("c1", "c2"), ("c2", "c1")]
    return [(out[0], 64), (out[1], 64), (dag, 64), (mixed, 64), (dag, 0), (mixed + chain, 0), ([("x", "x")], 64)]


@pytest.mark.parametrize(("edges", "long"), shapes())
def test_graphs(spark, monkeypatch, edges, long):
    """Plain rounds, and paths contracted wherever there are any."""
    monkeypatch.setattr(graph, "LONG", long)
    nodes = sorted({x for e in edges for x in e} | {"alone"})
    df, modules = spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([(n,) for n in nodes], "module string")
    far = searched(nodes, edges)
    direct = {n: len({b for a, b in edges if a == n and b != n}) for n in nodes}
    got = {r["module"]: (r["reach"], r["indirect"], r["eccentricity"]) for r in graph.indirect_dependencies(modules, graph.dependency_edges(df)).collect()}
    assert got == {n: (len(far[n]) - 1, len(far[n]) - 1 - direct[n], max(far[n].values())) for n in nodes}
    rings = {}
    for n in nodes:
        own = {x for x in far[n] if n in far[x]}
        if len(own) > 1:
            rings[n] = (min(own), len(own))
    assert {r["module"]: (r["component"], r["size"]) for r in graph.cycles(df).collect()} == rings
    assert graph.longest_path(df) == longest(nodes, edges)


def test_more_sources_than_bits(spark):
    edges = [(f"s{i:03d}", "hub") for i in range(150)] + [("hub", f"t{i}") for i in range(3)]
    got = {r["src"]: (r["reach"], r["eccentricity"]) for r in graph.reach_counts(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == {f"s{i:03d}": (4, 2) for i in range(150)} | {"hub": (3, 1)}


def test_long_chains(spark):
    """A chain and a ring that are contracted: as many rounds as the logarithm of their length."""
    n = 300
    chain = spark.range(n).selectExpr("printf('n%05d', id) AS src", "printf('n%05d', id + 1) AS dst")
    ring = spark.range(n).selectExpr("printf('r%05d', id) AS src", f"printf('r%05d', (id + 1) % {n}) AS dst")
    assert graph.longest_path(chain) == n
    found = graph.cycles(chain.union(ring)).collect()
    assert len(found) == n and {(r["component"], r["size"]) for r in found} == {("r00000", n)}
    assert graph.longest_path(ring) is None
