"""Benchmark decontamination with a distributed positional inverted index.

The index is a table with a row for each block of documents: the block's distinct terms (word hashes, sorted), and for
each term the ascending positions where it stands in the block. Blocks are as large as some megabytes of text, so no
list grows with the corpus, a hot word's least of all, and building and searching need no shuffle. Test items are
looked up in blocks of bounded size: of each window of test words the term with the shortest list in the index block
seeds the search, its positions are taken back by its offset in the window, and the other terms' lists are intersected
with them. What remains are exact phrase matches; proximity matches need a window's terms within a span, in any order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import stored
from gristmill.llm.tokens import ALNUM, blocks, release, scan

#: Test words are broadcast in portions of at most so many items and, unless one item is longer, so many bytes.
ITEMS_AT_ONCE, ITEM_BYTES = 20_000, 16 << 20
INDEX = "block long, ids array<long>, firsts array<long>, terms binary, sizes binary, places binary"
MATCH = "block long, row int, doc_id long, item_id long, near boolean, spans array<struct<start long, end long>>"
#: Words that may stand between those of a window for a proximity match.
SLACK = 5
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _pack(x: np.ndarray) -> bytes:
    """int32 as byte planes, which compress well when most values are small."""
    return np.ascontiguousarray(x, "<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpack(data: pa.Buffer) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<i4").reshape(-1).astype(np.int64)


def index(docs: DataFrame, block_bytes: int = 1 << 20) -> DataFrame:
    """Postings of every word of every whole text, stored in the shared folder.

    docs: doc_id, text; other columns are not read. A null or empty text has no words and stays in the index as a row
    without any. Repeated rows and null ids are rows of their own. An empty table gives an empty index.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in blocks(batches, "text", block_bytes):
            text = scan(batch.column(1), ALNUM, fold=True)
            order = np.argsort(text.hashes, kind="stable")
            terms, at = np.unique(text.hashes[order], return_index=True)
            gaps = np.diff(order, prepend=0)
            gaps[at] = order[at]
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            packed = (pa.array([x], pa.binary()) for x in (terms.tobytes(), _pack(np.diff(np.append(at, len(order)))), _pack(gaps)))
            yield pa.record_batch([pa.array([block]), one(batch.column(0)), one(pa.array(text.first, pa.int64())), *packed], ["block", "ids", "firsts", "terms", "sizes", "places"])
            block += 1

    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, INDEX), "postings")


@dataclass
class Items:
    """Some test items: their ids, their words' hashes one after the other, and the first word of each (and the end)."""

    ids: list[int]
    hashes: np.ndarray
    first: np.ndarray

    def sizes(self) -> np.ndarray:
        return np.diff(self.first)


@dataclass
class Block:
    """One row of the index, with the term at each position as well: an O(1) test of any position in any list."""

    ids: pa.Array
    firsts: np.ndarray
    terms: np.ndarray
    starts: np.ndarray
    places: np.ndarray
    at: np.ndarray

    @staticmethod
    def of(row: pa.RecordBatch, i: int) -> Block:
        ids, firsts = (row.column(c)[i].values for c in ("ids", "firsts"))
        terms, sizes, gaps = (row.column(c)[i].as_buffer() for c in ("terms", "sizes", "places"))
        terms, sizes, gaps = np.frombuffer(terms, np.uint64), _unpack(sizes), _unpack(gaps)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        total = np.cumsum(gaps)
        head = starts[:-1]
        places = total - np.repeat(total[head] - gaps[head], sizes) if len(gaps) else gaps
        at = np.empty(len(places), np.int64)
        at[places] = np.repeat(np.arange(len(terms)), sizes)
        return Block(ids, firsts.to_numpy(), terms, starts, places, at)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word in this block's terms, -1 if it has none."""
        if not len(self.terms):
            return np.full(len(hashes), -1)
        i = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[i] == hashes, i, -1)

    def lists(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which, position): the lists of several terms, one after the other."""
        sizes = self.starts[terms + 1] - self.starts[terms]
        which = np.repeat(np.arange(len(terms)), sizes)
        within = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return which, self.places[np.repeat(self.starts[terms], sizes) + within]


def _windows(items: Items, n: int) -> dict[int, np.ndarray]:
    """Window size -> starts: n consecutive words of an item; of an item of fewer, but not none, all its words."""
    sizes = items.sizes()
    out = {}
    long = np.flatnonzero(sizes >= n)
    if len(long):
        count = sizes[long] - n + 1
        out[n] = np.repeat(items.first[long], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    for m in np.unique(sizes[(sizes > 0) & (sizes < n)]):
        out[int(m)] = items.first[:-1][sizes == m]
    return out


def _seeds(block: Block, term: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows that can occur here, and the place in them of the term with the shortest list."""
    size = np.where(term >= 0, block.starts[np.maximum(term, 0) + 1] - block.starts[np.maximum(term, 0)], 0) if len(block.terms) else np.zeros(len(term), np.int64)
    table = size[starts[:, None] + np.arange(n)]
    rarest = table.argmin(1)
    can = table[np.arange(len(starts)), rarest] > 0
    return starts[can], rarest[can]


def _phrases(block: Block, items: Items, term: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item word, start, end) of the runs of matching words that hold at least one whole window."""
    starts, rarest = _seeds(block, term, starts, n)
    seeds = np.unique(starts + rarest)
    if not len(seeds):
        return (np.zeros(0, np.int64),) * 3
    which, q = block.lists(term[seeds])
    p = seeds[which]
    item = np.searchsorted(items.first, p, "right") - 1
    row = np.searchsorted(block.firsts, q, "right") - 1
    left, right = (np.minimum(n - 1, x) for x in (np.minimum(p - items.first[item], q - block.firsts[row]), np.minimum(items.first[item + 1] - p, block.firsts[row + 1] - q) - 1))
    fits = left + right >= n - 1
    p, q, left, right = p[fits], q[fits], left[fits], right[fits]

    def extent(p: np.ndarray, q: np.ndarray, room: np.ndarray, way: int) -> np.ndarray:
        """How many words beside each seed, at most `room`, stand in the lists of the item's words beside it."""
        got, alive = np.zeros(len(p), np.int64), np.arange(len(p))
        for d in range(1, n):
            alive = alive[room[alive] >= d]
            alive = alive[term[p[alive] + way * d] == block.at[q[alive] + way * d]]
            if not len(alive):
                break
            got[alive] = d
        return got

    after = extent(p, q, right, 1)
    keep = after + left >= n - 1  # the words before must make up for those missing
    p, q, left, after = p[keep], q[keep], left[keep], after[keep]
    before = extent(p, q, left, -1)
    whole = before + after >= n - 1
    return p[whole], (q - before)[whole], (q + after)[whole] + 1


def _near(block: Block, items: Items, term: np.ndarray, starts: np.ndarray, n: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item word, start, end) of the shortest stretches of at most `span` words with all terms of a window."""
    starts, rarest = _seeds(block, term, starts, n)
    none = (np.zeros(0, np.int64),) * 3
    if not len(starts):
        return none
    which, q = block.lists(term[starts + rarest])
    size = len(block.at) + span + 1
    key = np.repeat(np.arange(len(block.terms)), np.diff(block.starts)) * size + block.places
    row = np.searchsorted(block.firsts, q, "right") - 1
    low, high = np.maximum(block.firsts[row], q - span + 1), np.minimum(block.firsts[row + 1], q + span)
    alive = np.arange(len(q))
    for d in range(n):
        t = term[starts[which[alive]] + d]
        i = np.searchsorted(key, t * size + low[alive])
        there = (i < len(key)) & (key[np.minimum(i, len(key) - 1)] < t * size + high[alive])
        alive = alive[there]
    found = []
    for k in alive:
        need = set(term[starts[which[k]] : starts[which[k]] + n].tolist())
        places = [(x, t) for x, t in enumerate(block.at[low[k] : high[k]].tolist(), int(low[k])) if t in need]
        last: dict[int, int] = {}
        best = None
        for x, t in places:
            last[t] = x
            if len(last) == len(need):
                a = min(last.values())
                if a <= q[k] <= x and x - a < span and (best is None or x - a < best[1] - best[0]):
                    best = (a, x)
        if best:
            found.append((starts[which[k]], best[0], best[1] + 1))
    return tuple(np.array(c, np.int64) for c in zip(*found, strict=True)) if found else none


def _union(start: np.ndarray, end: np.ndarray) -> list[dict]:
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    cut = np.flatnonzero(np.append(True, start[1:] > end[:-1]))
    return [{"start": int(a), "end": int(b)} for a, b in zip(start[cut], end[np.append(cut[1:], len(end)) - 1], strict=True)]


def _rows(test: Items, block: Block, number: int, near: bool, runs: list[tuple]) -> Iterator[pa.RecordBatch]:
    """One batch of the matches in a block: (item word, start, end) of several window sizes."""
    p, a, b = (np.concatenate(x) for x in zip(*runs, strict=True)) if runs else (np.zeros(0, np.int64),) * 3
    if not len(p):
        return
    item, row = np.searchsorted(test.first, p, "right") - 1, np.searchsorted(block.firsts, a, "right") - 1
    order = np.lexsort((item, row))
    cut = np.flatnonzero(np.append(True, np.diff(row[order]).astype(bool) | np.diff(item[order]).astype(bool)))
    out = []
    for i, j in zip(cut, np.append(cut[1:], len(order)), strict=True):
        o = order[i:j]
        r = int(row[o[0]])
        out.append((number, r, block.ids[r].as_py(), test.ids[item[o[0]]], near, _union(a[o] - block.firsts[r], b[o] - block.firsts[r])))
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), _SPANS]
    yield pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in MATCH.split(", ", 5)])


def _portions(items: DataFrame) -> Iterator[Items]:
    """The test items in portions of a bounded size, read one after the other; items with null text have no windows."""
    held, size = [], 0

    def made() -> Items:
        text = scan(pa.array([x["text"] for x in held], pa.string()), ALNUM, fold=True)
        return Items([x["item_id"] for x in held], text.hashes, text.first)

    for row in items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").toLocalIterator():
        if held and (len(held) >= ITEMS_AT_ONCE or size + len(row["text"]) > ITEM_BYTES):
            yield made()
            held, size = [], 0
        held.append(row)
        size += len(row["text"])
    if held:
        yield made()


def matches(postings: DataFrame, items: DataFrame, n: int = 10, slack: int | None = None) -> DataFrame:
    """A row for each document row and item with matches: block and row tell document rows apart; spans are in words from 0.

    Rows that are not near have the exact occurrences of an item's windows of `n` words, overlapping ones joined. With
    slack there are rows that are near, too: the shortest stretches of at most a window's words and `slack` more that hold all
    of its words, in any order; an exact occurrence is one of them. Repeated items match each for itself. No match, no row.
    """

    def search(portion: Items) -> tuple[DataFrame, Broadcast]:
        shared = postings.sparkSession.sparkContext.broadcast(portion)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            test = shared.value
            by_size = _windows(test, n)
            for batch in batches:
                for k in range(batch.num_rows):
                    block = Block.of(batch, k)
                    if not len(block.at):
                        continue
                    number, term = batch.column("block")[k].as_py(), block.find(test.hashes)
                    yield from _rows(test, block, number, False, [_phrases(block, test, term, s, m) for m, s in by_size.items()])
                    if slack is not None:
                        yield from _rows(test, block, number, True, [_near(block, test, term, s, m, m + slack) for m, s in by_size.items()])
                block = batch = None
                release()

        return postings.mapInArrow(run, MATCH), shared

    # of several portions each one's matches are stored, so that one broadcast lives at a time
    out, portions = None, _portions(items)
    now, then = next(portions, None), next(portions, None)
    if then is None:
        return search(now)[0] if now else postings.sparkSession.createDataFrame([], MATCH)
    while now:
        found, shared = search(now)
        found = stored(found, "matches")
        shared.destroy()
        out = found if out is None else out.unionByName(found)
        now, then = then, next(portions, None)
    return out


def _covered(spans):
    """How many words an array of spans covers, however they overlap."""
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda s, x: F.struct(F.greatest(s["end"], x["end"]).alias("end"), (s["n"] + F.greatest(F.lit(0).cast("long"), x["end"] - F.greatest(s["end"], x["start"]))).alias("n"))
    return F.aggregate(F.array_sort(spans), zero, step, lambda s: s["n"])


def contamination(docs: DataFrame, items: DataFrame, n: int = 10, slack: int | None = SLACK) -> DataFrame:
    """(block, row, doc_id, n_words, n_hit, item_ids, near_ids) for every row of docs: words inside any occurrence of a window,
    the distinct items with occurring windows, and those with a window whose words stand near each other (see matches). An
    item without an id counts in n_hit alone. Rows without words or matches have zeros and empty arrays."""
    postings = index(docs)
    words = postings.select("block", F.posexplode(F.arrays_zip("ids", F.slice("firsts", 1, F.size("ids")).alias("a"), F.slice("firsts", 2, F.size("ids")).alias("b"))).alias("row", "x"))
    words = words.select("block", "row", F.col("x.ids").alias("doc_id"), (F.col("x.b") - F.col("x.a")).alias("n_words"))
    exact = ~F.col("near")
    hits = matches(postings, items, n, slack).groupBy("block", "row").agg(
        F.collect_set(F.when(exact, F.col("item_id"))).alias("item_ids"),
        F.collect_set(F.when(F.col("near"), F.col("item_id"))).alias("near_ids"),
        _covered(F.flatten(F.collect_list(F.when(exact, F.col("spans"))))).alias("n_hit"),
    )
    none = F.array().cast("array<long>")
    out = words.join(hits, ["block", "row"], "left")
    return out.select("block", "row", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("near_ids", none).alias("near_ids"))
