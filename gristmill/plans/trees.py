"""Tree patterns over the tag trees of all pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators.patterns import below, child, match
from gristmill.sources.table_functions import register
from gristmill.sources.tables import cut, table
from gristmill.sources.tags import RAW, TOKEN, VOID, tag_trees

#: A link in an item of a list, a paragraph after an article's heading with bold text below it, a division beside an article.
PATTERNS = {
    "list_link": child("body", "a", below("ul", "b", child("li", "c", child("a", "d")))),
    "bold_paragraph": below("article", "a", child("h1", "b"), below("p", "c", below("b", "d"))),
    "side_block": child("body", "a", child("div", "b"), child("article", "c", below("h1", "d"))),
}


def tree_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = cut(tag_trees(table(spark, sf_dir, "pages")))
    found = None
    for name, pattern in PATTERNS.items():
        rows = match(nodes, pattern).select(F.lit(name).alias("pattern"), F.col("doc").alias("page_id"), "a", "b", "c", "d")
        found = rows if found is None else found.unionByName(rows)
    return found


def tree_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements, depth and the widest element of each page's tag tree."""
    nodes = tag_trees(table(spark, sf_dir, "pages"))
    return nodes.groupBy(F.col("doc").alias("page_id")).agg(F.count("*").alias("elements"), F.max("depth").alias("deepest"), F.countDistinct("type").alias("types"), F.max(F.when(F.col("depth") > 0, F.col("last") - F.col("pre"))).alias("widest"))


def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements and depths by type, by the table function for SQL."""
    register(spark)
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    return spark.sql("SELECT type, count(*) AS n, count(DISTINCT page_id) AS pages, max(depth) AS deepest FROM tag_nodes(TABLE({pages}) PARTITION BY page_id) GROUP BY type", pages=pages)


_LIST = lambda x: "[" + ", ".join(f"'{v}'" for v in x) + "]"
# One step of the recursion takes one tag of every page: its stack has the open elements' numbers and names.
_TREE = f"""WITH RECURSIVE tokens AS (SELECT page_id, list_filter(regexp_extract_all(coalesce(html, ''), '(?is){TOKEN.replace("'", "''")}'), lambda x: NOT starts_with(x, '<!--')) AS t FROM pages),
tags AS (SELECT page_id, list_transform(t, lambda x: {{'name': lower(regexp_extract(x, '[a-zA-Z0-9]+')), 'closes': x[2] = '/', 'leaf': x[2] <> '/' AND (ends_with(x, '/>') OR list_contains({_LIST((*VOID, *RAW))}, lower(regexp_extract(x, '[a-zA-Z0-9]+'))))}}) AS t FROM tokens),
walk(page_id, i, pre, opened, closed, numbers, names) AS (
  SELECT page_id, 0, 0, NULL::INTEGER, []::INTEGER[], []::INTEGER[], []::VARCHAR[] FROM tags
  UNION ALL
  SELECT page_id, i + 1, CASE WHEN x.closes THEN pre ELSE pre + 1 END, CASE WHEN NOT x.closes THEN pre END,
    CASE WHEN x.leaf THEN [pre] WHEN spot IS NULL THEN [] ELSE numbers[spot:] END,
    CASE WHEN x.leaf THEN numbers WHEN NOT x.closes THEN list_append(numbers, pre) WHEN spot IS NULL THEN numbers ELSE numbers[:spot - 1] END,
    CASE WHEN x.leaf THEN names WHEN NOT x.closes THEN list_append(names, x.name) WHEN spot IS NULL THEN names ELSE names[:spot - 1] END
  FROM (SELECT w.*, t[i + 1] AS x, CASE WHEN t[i + 1].closes AND list_contains(names, t[i + 1].name) THEN len(names) + 1 - list_position(list_reverse(names), t[i + 1].name) END AS spot FROM walk w JOIN tags USING (page_id) WHERE i < len(t))),
ends AS (SELECT page_id, unnest(closed) AS pre, w.pre - 1 AS last FROM walk w UNION ALL
  SELECT page_id, unnest(numbers), w.pre - 1 FROM walk w JOIN tags USING (page_id) WHERE i = len(t)),
n AS MATERIALIZED (SELECT page_id, o.opened AS pre, e.last, len(o.numbers) - CASE WHEN t[o.i].leaf THEN 0 ELSE 1 END AS depth, CASE WHEN t[o.i].leaf THEN o.numbers[-1] ELSE o.numbers[-2] END AS parent, t[o.i].name AS type
  FROM walk o JOIN tags USING (page_id) JOIN ends e USING (page_id) WHERE o.opened = e.pre)"""


def _sql() -> str:
    parts = []
    for name, pattern in PATTERNS.items():
        tests = [f"{pattern.capture}.type = '{pattern.type}'"]

        def walk(step, tests=tests) -> None:
            before = None
            for s in step.steps:
                tests.append(f"{s.capture}.type = '{s.type}' AND {s.capture}.page_id = {step.capture}.page_id AND " + (f"{s.capture}.parent = {step.capture}.pre" if s.child else f"{s.capture}.pre > {step.capture}.pre AND {s.capture}.pre <= {step.capture}.last"))
                if before:
                    tests.append(f"{s.capture}.pre > {before}.pre")
                before = s.capture
                walk(s)

        walk(pattern)
        parts.append(f"SELECT '{name}' AS pattern, a.page_id, a.pre AS a, b.pre AS b, c.pre AS c, d.pre AS d FROM n a, n b, n c, n d WHERE " + " AND ".join(tests))
    return _TREE + " " + " UNION ALL ".join(parts)


QUERIES = {"tree_pattern": tree_pattern, "tree_sizes": tree_sizes, "tag_counts": tag_counts}
ORACLES = {
    "tree_pattern": _sql(),
    "tag_counts": _TREE + " SELECT type, count(*) AS n, count(DISTINCT page_id) AS pages, max(depth)::INTEGER AS deepest FROM n GROUP BY type",
    "tree_sizes": _TREE + " SELECT page_id, count(*) AS elements, max(depth)::INTEGER AS deepest, count(DISTINCT type) AS types, max(CASE WHEN depth > 0 THEN last - pre END)::INTEGER AS widest FROM n GROUP BY page_id",
}
