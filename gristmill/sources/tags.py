"""Tag trees of HTML pages as interval-encoded nodes: every element with its number, its last descendant's and its parent's."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODES = "doc long, pre int, last int, parent int, depth int, type string"
#: Elements without content, and those whose content is text and no tags.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
RAW = ("script", "style")
#: What stands for an element or for nothing, in this order.
TOKEN = "|".join([rf"<{x}(?:\s[^>]*)?>.*?</{x}\s*>" for x in RAW] + ["<!--.*?-->", r"</?[a-z][a-z0-9]*(?:[\s/][^>]*)?>"])
_TOKEN = re.compile(f"(?is){TOKEN}")
_NAME = re.compile("[a-zA-Z0-9]+")


def elements(html: str) -> list[list]:
    """[pre, last, parent, depth, type] of each element, by a stack of open ones.

    An end tag closes the last open element of its name and all opened in it; one without such an element is passed over.
    What is open at the end of the text ends there. Void and raw-text elements are leaves, and so are those that end in />.
    """
    out: list[list] = []
    stack: list[list] = []
    for token in _TOKEN.findall(html):
        if token.startswith("<!--"):
            continue
        name = _NAME.search(token)[0].lower()
        if token[1] == "/":
            if any(x[4] == name for x in stack):
                while True:
                    x = stack.pop()
                    x[1] = len(out) - 1
                    if x[4] == name:
                        break
            continue
        out.append([len(out), len(out), stack[-1][0] if stack else None, len(stack), name])
        if name not in VOID and name not in RAW and not token.endswith("/>"):
            stack.append(out[-1])
    for x in stack:
        x[1] = len(out) - 1
    return out


def tag_trees(pages: DataFrame, id_column: str = "page_id", html: str = "html") -> DataFrame:
    """Nodes of the tag tree of every whole page; a page without tags, or null, has none. Other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), *[pa.int32()] * 4, pa.string()]
        names = [x.split()[0] for x in NODES.split(", ")]
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(*batch.columns, strict=True):
                rows += [(doc.as_py(), *x) for x in elements(text.as_py() or "")]
                if len(rows) > 50_000:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows = []
            if rows:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return pages.select(F.col(id_column).cast("long").alias("doc"), F.col(html).cast("string").alias("html")).mapInArrow(run, NODES)
