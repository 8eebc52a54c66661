"""Table functions for SQL: SELECT * FROM tag_nodes(TABLE(pages) PARTITION BY page_id), and tree_nodes for source files.

A partition is one page's or file's rows; only one row's nodes are in memory at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from gristmill.sources.nodes import _tried
from gristmill.sources.tags import elements


class TagNodes:
    """Rows (page_id, html) to the elements of their tag trees; a null html has none."""

    def eval(self, row: Row) -> Iterator[tuple]:
        for pre, last, parent, depth, kind in elements(row["html"] or ""):
            yield row["page_id"], pre, last, parent, depth, kind


class TreeNodes:
    """Rows (path, lang, source) to the nodes of their syntax trees; what doesn't parse has none."""

    def eval(self, row: Row) -> Iterator[tuple]:
        for x in _tried(row["lang"], row["source"])[0]:
            yield row["path"], x["pre"], x["last"], x["parent"], x["type"], x["field"], x["text"]


def register(spark: SparkSession) -> None:
    """Makes the functions known to this session's SQL."""
    spark.udtf.register("tag_nodes", udtf(TagNodes, returnType="page_id bigint, pre int, last int, parent int, depth int, type string"))
    spark.udtf.register("tree_nodes", udtf(TreeNodes, returnType="path string, pre int, last int, parent int, type string, field string, text string"))
