"""Repeated passages: a compacted de Bruijn graph over word k-mers, verified by source coordinates.

Every k consecutive words of a document are an edge of the graph. Consecutive edges whose leftmost smallest m-mer (the
minimizer) is the same word place form a path without branches inside one document; the pass over the texts emits one
row for each such path: its minimizer, a hash of all its words, its place and its length. Equal edges have equal
minimizers, so all occurrences of an edge lie in paths of one minimizer, and the Spark join on it

- compacts: a path that occurs again as a whole is the same nonbranching path of the graph; all edges of every
  occurrence but the first repeat, and no edge of them is looked at again;
- branches: where a minimizer has paths with different words, the first occurrence of each is expanded into its edges,
  whose source coordinates (smallest document, then smallest start) tell which of them stand somewhere earlier.

Paths are about (k - m) / 2 edges long, so the graph has a few rows for each dozen words, and edges are only formed
where repeated passages begin and end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import small, stored
from gristmill.llm.tokens import SPACED, Text, blocks, gram_rows, grams, scan, signed

K, M = 20, 6
#: Up to so many ids whose rows have different texts are broadcast (8 bytes each); beyond, the texts are shuffled.
IDS_AT_ONCE = 1_000_000
#: Minimizers with several paths are broadcast up to so many (8 bytes each); beyond, the paths are shuffled to them.
MINIMIZERS_AT_ONCE = 500_000


def _paths(text: Text, k: int, m: int) -> tuple[np.ndarray, ...]:
    """(row, first edge, edges, minimizer, words' hash) of the paths of some rows; edges are numbered by word."""
    row, at = gram_rows(text, k)
    if not len(at):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    small = grams(text.hashes, m)
    # the leftmost smallest of each k - m + 1 m-mers, by halving: block minima of a power of two, then two of them
    width, size = k - m + 1, 1
    best = np.arange(len(small))
    while 2 * size <= width:
        a, b = best[: len(best) - size], best[size:]
        best = np.where(small[b] < small[a], b, a)
        size *= 2
    if size < width:
        a, b = best[: len(best) - (width - size)], best[width - size :]
        best = np.where(small[b] < small[a], b, a)
    place = best[at]
    new = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)))
    edges = np.diff(np.append(new, len(at)))
    start = at[new]
    # words start .. start + edges + k - 2 as one hash: all its k-mers' hashes follow from the first, last and length
    whole = grams(text.hashes, k)
    inner = np.concatenate([np.zeros(1, np.uint64), np.cumsum(whole)])
    content = (inner[start + edges] - inner[start]) ^ (whole[start] * np.uint64(0x9E3779B97F4A7C15)) ^ edges.astype(np.uint64)
    return row[new], start, edges, small[place[new]], content


def _firsts(place: list[np.ndarray], same: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(elements, again): one element of each place and `same`, as an index; whether another place (least important part
    first) comes before it among those with equal `same`. What stands in one place twice, in repeated rows, counts once."""
    order = np.lexsort([*place, *same])
    new = lambda keys: np.append(True, np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])) if len(order) else np.zeros(0, bool)
    head = new(same)
    once = head | new(place)
    return order[once], ~head[once]


PATHS = "doc_id long, version long, at int, edges int, minimizer long, content long, again boolean"


def paths(docs: DataFrame, k: int = K, m: int = M) -> DataFrame:
    """The compacted paths of every whole text, those of repeated rows once a batch. again: the path also stands in an
    earlier place of its Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            text = scan(batch.column(2), SPACED)
            row, start, edges, minimizer, content = _paths(text, k, m)
            ids, version = (np.asarray(batch.column(i), np.int64)[row] for i in (0, 1))
            at = start - text.first[row]
            one, again = _firsts([at, version, ids], [content, minimizer])
            yield pa.record_batch([pa.array(ids[one]), pa.array(version[one]), pa.array(at[one], pa.int32()), pa.array(edges[one], pa.int32()), pa.array(signed(minimizer[one])), pa.array(signed(content[one])), pa.array(again)], ["doc_id", "version", "at", "edges", "minimizer", "content", "again"])

    return docs.select("doc_id", "version", "text").mapInArrow(run, PATHS)


EDGES = "doc_id long, version long, at int, edge long, again boolean"


def _expanded(texts: DataFrame, k: int) -> DataFrame:
    """The single edges of some paths: doc_id, version, text, open array<struct<at, edges>>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            text = scan(batch.column(2), SPACED)
            whole = grams(text.hashes, k)
            spans = batch.column(3)
            size = np.diff(np.asarray(spans.offsets))
            flat = spans.flatten()
            row = np.repeat(np.arange(batch.num_rows), size)
            start, edges = np.asarray(flat.field(0), np.int64), np.asarray(flat.field(1), np.int64)
            within = np.arange(edges.sum()) - np.repeat(np.cumsum(edges) - edges, edges)
            row, at = np.repeat(row, edges), np.repeat(start, edges) + within
            edge = whole[text.first[row] + at]
            ids, version = (np.asarray(batch.column(i), np.int64)[row] for i in (0, 1))
            one, again = _firsts([at, version, ids], [edge])
            yield pa.record_batch([pa.array(ids[one]), pa.array(version[one]), pa.array(at[one], pa.int32()), pa.array(signed(edge[one])), pa.array(again)], ["doc_id", "version", "at", "edge", "again"])

    return texts.mapInArrow(run, EDGES)


def repeats(docs: DataFrame, k: int = K, m: int = M) -> DataFrame:
    """(doc_id, version, spans array<struct<at, edges>>): runs of k-word windows whose words also start earlier, by document.

    docs: doc_id, version, text without null ids; rows with equal id and version have the same text and are one document.
    Earlier is a smaller doc_id, or the same and a smaller version, or the same of both and an earlier start.
    """
    found = stored(paths(docs, k, m), "paths")
    first = F.min(F.struct("doc_id", "version", "at")).alias("source")
    elsewhere = "source.doc_id <> doc_id or source.version <> version or source.at <> at"
    # what an Arrow batch has twice is settled there; only its first goes through the joins, so no path is hot
    one = found.where("not again")
    # minimizers with several different paths branch; a frequent one is two numbers a task here, not rows of one task
    branching = one.groupBy("minimizer").agg(F.min("content").alias("low"), F.max("content").alias("high")).where("low <> high").select("minimizer", F.lit(True).alias("branches"))
    branching = small(stored(branching, "branching"), MINIMIZERS_AT_ONCE)
    kinds = one.groupBy("minimizer", "content").agg(first, F.count("*").alias("n"), F.max("edges").alias("edges")).join(branching, "minimizer", "left")
    kinds = stored(kinds.withColumn("branches", F.coalesce("branches", F.lit(False))).where("n > 1 or branches"), "kinds")
    later = one.join(kinds.where("n > 1").select("minimizer", "content", "source"), ["minimizer", "content"]).where(elsewhere)
    whole = found.where("again").select("doc_id", "version", "at", "edges").union(later.select("doc_id", "version", "at", "edges"))
    open_ = kinds.where("branches").select("source.doc_id", "source.version", "source.at", "edges").groupBy("doc_id", "version").agg(F.collect_list(F.struct("at", "edges")).alias("open"))
    edges = stored(_expanded(docs.join(open_, ["doc_id", "version"]).select("doc_id", "version", "text", "open"), k), "edges")
    alone = edges.where("not again")
    sources = alone.groupBy("edge").agg(first, F.count("*").alias("n")).where("n > 1").select("edge", "source")
    moved = alone.join(sources, "edge").where(elsewhere)
    single = edges.where("again").select("doc_id", "version", "at").union(moved.select("doc_id", "version", "at")).select("*", F.lit(1).alias("edges"))
    return whole.union(single).groupBy("doc_id", "version").agg(F.sort_array(F.collect_set(F.struct("at", "edges"))).alias("spans"))


KEPT = "doc_id long, n_words long, n_removed long, kept string"


def deduplicate(docs: DataFrame, k: int = K, m: int = M, digest: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for every row of docs: the words of its whole text that no repeated window
    covers, joined by single spaces; with digest, kept is their SHA-256.

    A null text has no words. Repeated rows, equal in doc_id and text, are judged as one document: each keeps what the
    document keeps. Rows with one doc_id and different texts are documents of their own, in the order of a hash of the
    text. A row with a null id is left as it is. Other columns of docs are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known, text = docs.where("doc_id is not null"), F.xxhash64("text")
    several = stored(known.groupBy("doc_id").agg(F.min(text).alias("a"), F.max(text).alias("b")).where("a <> b").select("doc_id", F.lit(True).alias("several")), "several")
    # all but the rows of such ids have version 0, which takes no room
    docs = docs.join(small(several, IDS_AT_ONCE), "doc_id", "left").select("doc_id", F.when(F.col("several"), text).otherwise(F.lit(0).cast("long")).alias("version"), "text")
    spans = stored(repeats(docs.where("doc_id is not null"), k, m), "repeats")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                sizes, gone, kept = [], [], []
                for value, span in zip(part.column(1), part.column(2), strict=True):
                    words = value.as_buffer().to_pybytes().split()
                    n = len(words)
                    left = words
                    if span.is_valid and n:
                        flat = span.values
                        a, e = np.asarray(flat.field(0), np.int64), np.asarray(flat.field(1), np.int64)
                        step = np.zeros(n + 1, np.int64)
                        np.add.at(step, a, 1)
                        np.add.at(step, np.minimum(a + e + k - 1, n), -1)
                        left = [words[j] for j in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()]
                    sizes.append(n)
                    gone.append(n - len(left))
                    text = b" ".join(left)
                    kept.append(hashlib.sha256(text).hexdigest() if digest else text.decode("utf-8", "replace"))
                yield pa.record_batch([part.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return docs.join(spans, ["doc_id", "version"], "left").select("doc_id", "text", "spans").mapInArrow(run, KEPT)
