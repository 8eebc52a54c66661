"""Tree patterns and tag trees against plain searches."""

import random
from itertools import product

import pytest

from gristmill.operators.patterns import below, child, match, structural_merge
from gristmill.sources.nodes import nodes
from gristmill.sources.tags import elements, tag_trees


def random_tree(r, n):
    rows, stack = [], []
    for pre in range(n):
        while stack and r.random() < 0.35:
            stack.pop()[1] = pre - 1
        rows.append([pre, pre, stack[-1][0] if stack else None, r.choice("abc")])
        stack.append(rows[-1])
    for x in stack:
        x[1] = n - 1
    return [tuple(x) for x in rows]


@pytest.fixture(scope="module")
def forest(spark):
    r = random.Random(2)
    rows = [(doc, *x) for doc in range(12) for x in random_tree(r, r.choice([1, 5, 40, 90]))] + [(None, 0, 1, None, "a"), (None, 1, 1, 0, "b")]
    return rows, spark.createDataFrame(rows, "doc bigint, pre int, last int, parent int, type string").repartition(5).cache()


@pytest.mark.parametrize("slice_size", [1 << 16, 8, 1])
@pytest.mark.parametrize("at_once", ["10000", "7"])
def test_structural_merge(spark, forest, slice_size, at_once):
    rows, df = forest
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", at_once)
    try:
        for upper, lower in (("a", "b"), ("a", "a")):
            got = structural_merge(df.where(f"type = '{upper}'"), df.where(f"type = '{lower}'"), slice_size).collect()
            want = [(d, p, q) for (d, p, last, _, t), (e, q, _, _, u) in product(rows, rows) if d is not None and d == e and t == upper and u == lower and p < q <= last]
            assert sorted(map(tuple, got)) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


PATTERNS = [
    below("a", "x"),
    below("a", "x", child("b", "y")),
    below("a", "x", below("b", "y", child("c", "z")), below("a", "w")),
    below("c", "x", child("a", "y"), child("b", "z"), below("b", "w")),
]


def brute(rows, pattern):
    def fits(step, top, row):
        return row[4] == step.type and (top is None or (row[3] == top[1] if step.child else top[1] < row[1] <= top[2]))

    def ways(step, row):
        found = [((row[1],), row)]
        out = [(row[1],)]
        for i, s in enumerate(step.steps):
            new = []
            for held, before in found if i else [((row[1],), None)]:
                for low in rows:
                    if low[0] == row[0] and fits(s, row, low) and (before is None or low[1] > before[1]):
                        new += [(held + w, low) for w in ways(s, low)]
            found, out = new, [h for h, _ in new]
        return out

    return [(row[0], *w) for row in rows if row[0] is not None and fits(pattern, None, row) for w in ways(pattern, row)]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_match(forest, pattern):
    rows, df = forest
    got = [tuple(r) for r in match(df.where("doc is not null"), pattern).collect()]
    assert sorted(got) == sorted(brute(rows, pattern)) and (got or pattern is PATTERNS[3])


def test_captures_have_names_of_their_own(forest):
    with pytest.raises(ValueError):
        match(forest[1], child("a", "x", child("b", "x")))


def test_code_patterns(spark):
    source = "def f(a):\n    def g():\n        return 1\n    return g\n\nclass C:\n    def m(self):\n        x = 1\n"
    files = spark.createDataFrame([(1, "a.py", "python", source), (2, "b.py", "python", "x = 1\n")], "file_id bigint, path string, lang string, source string")
    tree = nodes(files).withColumnRenamed("file_id", "doc").cache()
    text = {r["pre"]: r["text"] for r in tree.where("doc = 1").collect()}
    named = match(tree, below("function_definition", "def", child("identifier", "name", field="name"))).collect()
    assert sorted(text[r["name"]] for r in named) == ["f", "g", "m"]
    nested = match(tree, below("function_definition", "outer", child("identifier", "name", field="name"), below("function_definition", "inner"))).collect()
    assert [text[r["name"]] for r in nested] == ["f"]
    methods = match(tree, below("class_definition", "class", below("function_definition", "def", child("identifier", "name", field="name")))).collect()
    assert [text[r["name"]] for r in methods] == ["m"]


def test_elements():
    names = lambda html: [(x[0], x[1], x[2], x[4]) for x in elements(html)]
    assert names("") == [] and names("a < b > c <!-- <p> -->") == []
    assert names("<p>a<p>b</p></p>") == [(0, 1, None, "p"), (1, 1, 0, "p")]
    assert names("<DIV><b>x</DIV></b><i/>") == [(0, 1, None, "div"), (1, 1, 0, "b"), (2, 2, None, "i")]
    assert names('<script>var t="</p><b>";</script><br>x</br>') == [(0, 0, None, "script"), (1, 1, None, "br")]
    assert names("<ul><li>1<li>2") == [(0, 2, None, "ul"), (1, 2, 0, "li"), (2, 2, 1, "li")]


def test_tag_trees(spark):
    pages = spark.createDataFrame([(1, "<a><b></b></a>", "x"), (2, None, "x"), (3, "", "x"), (None, "<i>", "x"), (1, "<u>", "x")], "page_id bigint, html string, type string")
    assert sorted(map(str, tag_trees(pages).select("doc", "pre", "last", "parent", "depth", "type").toLocalIterator())) == sorted(
        map(str, spark.createDataFrame([(1, 0, 1, None, 0, "a"), (1, 1, 1, 0, 1, "b"), (None, 0, 0, None, 0, "i"), (1, 0, 0, None, 0, "u")], "doc bigint, pre int, last int, parent int, depth int, type string").collect())
    )
    assert tag_trees(pages.where("page_id = 9")).count() == 0
