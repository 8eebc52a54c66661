"""Tree patterns over interval-encoded nodes: a node of one type with nodes of other types below it, each named by a capture.

nodes(doc, pre, last, parent, type[, field]): pre numbers a document's nodes depth first, last is the last one below a node.
A child step is an equi-join of parents. A descendant step is a structural merge: both sides' nodes sorted by document and
number, where those below a node are a stretch of the sorted ones, so that nothing but matches is paired and no ancestors are
exploded. Documents with very many nodes are merged in slices of numbers, which nodes above several slices are copied to.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers of nodes in a slice.
SLICE = 1 << 16
PAIRS = "doc long, above int, below int"


@dataclass(frozen=True)
class Step:
    """A node of a type, in a field if one is given, with further nodes below it; child: right below its own upper node."""

    type: str
    capture: str
    steps: tuple[Step, ...] = ()
    child: bool = True
    field: str | None = None

    def all(self) -> list[Step]:
        return [self, *(x for s in self.steps for x in s.all())]


def child(type: str, capture: str, *steps: Step, field: str | None = None) -> Step:
    return Step(type, capture, steps, True, field)


def below(type: str, capture: str, *steps: Step) -> Step:
    return Step(type, capture, steps, False)


def structural_merge(upper: DataFrame, lower: DataFrame, slice_size: int = SLICE) -> DataFrame:
    """(doc, above, below): all pairs of a node of upper(doc, pre, last) and one of lower(doc, pre) below it.

    A task holds an Arrow batch of sorted nodes and those above its end, never more than a path of the tree. Nodes of a
    null document pair with none.
    """
    upper = upper.where("doc is not null").distinct().where("last > pre")
    lower = lower.where("doc is not null").distinct()
    a = upper.select("doc", F.explode(F.sequence(F.expr(f"pre div {slice_size}"), F.expr(f"last div {slice_size}"))).alias("slice"), "pre", "last")
    d = lower.select("doc", F.expr(f"pre div {slice_size}").alias("slice"), "pre", F.lit(-1).alias("last"))
    # a node stands before those below it; that of both sides first as a lower one
    both = a.unionByName(d).repartition("doc", "slice").sortWithinPartitions("doc", "slice", "pre", "last")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = tuple(np.zeros(0, np.int64) for _ in range(4))
        for batch in batches:
            rows = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            is_upper = rows[3] >= 0
            above = [np.concatenate([h, r[is_upper]]) for h, r in zip(held, rows, strict=True)]
            doc, slices, pre = (r[~is_upper] for r in rows[:3])
            # documents and slices as ranks in the batch, so that one sorted key has all three
            key = np.stack([np.concatenate([x, y]) for x, y in zip(above[:2], (doc, slices), strict=True)])
            _, rank = np.unique(key, axis=1, return_inverse=True)
            rank = rank.reshape(-1) << 32
            top, own = rank[: len(above[0])], rank[len(above[0]) :] + pre
            order = np.argsort(own, kind="stable")
            low, high = (np.searchsorted(own[order], top + x, "right") for x in (above[2], above[3]))
            n = np.maximum(high - low, 0)
            at = order[np.repeat(low - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
            yield pa.record_batch([pa.array(np.repeat(above[0], n)), pa.array(np.repeat(above[2], n).astype(np.int32)), pa.array(pre[at].astype(np.int32))], ["doc", "above", "below"])
            if batch.num_rows:
                end = [r[-1] for r in rows[:3]]
                open_ = (above[0] == end[0]) & (above[1] == end[1]) & (above[3] >= end[2])
                held = tuple(x[open_] for x in above)

    return both.mapInArrow(run, PAIRS)


def match(nodes: DataFrame, pattern: Step) -> DataFrame:
    """A row for each way that the pattern's nodes are found: doc, and each capture's node number.

    Steps below one node stand in the order given: each begins after the one before it. Captures have different names.
    """
    names = [s.capture for s in pattern.all()]
    if len(set(names)) != len(names):
        raise ValueError("a pattern's captures must have different names")

    def of(step: Step) -> DataFrame:
        found = nodes.where(F.col("type") == step.type)
        return found if step.field is None else found.where(F.col("field") == step.field)

    def grown(rows: DataFrame, step: Step) -> DataFrame:
        """rows(doc, captures) with those of the steps below `step`."""
        before = None
        for s in step.steps:
            if s.child:
                pairs = of(s).where("parent is not null").select("doc", F.col("parent").alias(step.capture), F.col("pre").alias(s.capture))
            else:
                pairs = structural_merge(of(step).select("doc", "pre", "last"), of(s).select("doc", "pre")).select("doc", F.col("above").alias(step.capture), F.col("below").alias(s.capture))
            rows = rows.join(pairs, ["doc", step.capture])
            if before is not None:
                rows = rows.where(F.col(s.capture) > F.col(before))
            rows, before = grown(rows, s), s.capture
        return rows

    return grown(of(pattern).select("doc", F.col("pre").alias(pattern.capture)), pattern).select("doc", *names)
