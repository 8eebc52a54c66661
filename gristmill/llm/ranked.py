"""Ranked lexical search over a bit-sliced impact index.

The index is a table with a row for each block of documents, ordered by id in it: the block's distinct terms, the documents
of each term's postings, and the postings' impacts as bit slices: slice s is a bitmap with bit s of every impact, so
that a term has a stretch of each slice. An impact is what one document gives for a term of weight one: a saturated term
frequency, normalised by length; it depends on two numbers of the corpus. Building reads texts once and shuffles nothing.

Searching. A term's weight depends on its document frequency, which is summed over blocks for the terms of the items alone.
In a block, slices of a term's impacts are spread over the block's documents, and multiplied by its weight and added over an
item's terms by carry arithmetic: bitwise operations on bitmaps, for all terms, or all items, at a time. The best k are
found from the most significant slice down: documents with the bit set are taken as long as k aren't exceeded, and where
they are, the others are left behind; of those that are equal in all slices the first ones fill up. A task keeps each
item's best k of its blocks, and the best of all tasks are ranked in the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.llm.common import scratch, stored
from gristmill.llm.tokens import ALNUM, blocks, release, scan

#: Items are searched in portions of at most so many, and so many bytes unless one item alone has more.
ITEMS_AT_ONCE, ITEM_BYTES = 1_000, 1 << 18
#: So many of a portion's terms in a block are spread over its documents at a time.
TERMS_AT_ONCE = 2_048
#: Impacts are below SCALE: SCALE * tf div (1000 * tf + 8 * m) with SCALE 10**9 is below 10**6, 20 bits.
SCALE, SLICES = 1_000_000_000, 20
SHARE = 90  # of the length's norm, in percent
POSTINGS = "ids array<long>, lengths array<long>, terms binary, sizes binary, docs binary, tfs binary"
INDEX = "ids array<long>, terms binary, sizes binary, docs binary, slices binary"
FOUND = "item long, item_id long, doc_id long, score long"


def _list(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _raw(values: np.ndarray, kind: str) -> pa.Array:
    return pa.array([np.ascontiguousarray(values, kind).tobytes()], pa.binary())


def _postings(docs: DataFrame, block_bytes: int) -> DataFrame:
    """A row a block: ids in order, how many terms each document has, and for each distinct term its documents and frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", block_bytes):
            batch = batch.sort_by([("doc_id", "ascending")])  # nulls last
            text = scan(batch.column(1), ALNUM, fold=True)
            terms, number = np.unique(text.hashes, return_inverse=True)
            key, tf = np.unique(number * batch.num_rows + text.rows, return_counts=True)
            term, doc = key // batch.num_rows, key % batch.num_rows
            sizes = np.bincount(term, minlength=len(terms))
            yield pa.record_batch([_list(batch.column(0)), _list(pa.array(text.counts, pa.int64())), _raw(terms, "<u8"), _raw(sizes, "<i4"), _raw(doc, "<i4"), _raw(tf, "<i4")], [x.split()[0] for x in POSTINGS.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, POSTINGS)


@dataclass
class Corpus:
    """How many documents have a term, and how many terms they have, with repeats."""

    documents: int
    terms: int


def index(docs: DataFrame, block_bytes: int = 1 << 21) -> tuple[DataFrame, Corpus]:
    """The bit-sliced index of every term of every whole text, stored in the shared folder, and the corpus's two numbers.

    docs: doc_id, text; other columns are not read. A term is a maximal run of ASCII letters and digits and of all other
    characters above 0x7F, A-Z lower-cased. A null or empty text has no terms. Repeated rows and null ids are documents of
    their own. An empty table gives an empty index.
    """
    with scratch(docs.sparkSession) as own:
        found = own.stored(_postings(docs, block_bytes), "postings")
        one = found.select(F.explode("lengths").alias("n")).where("n > 0").agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        corpus = Corpus(one.documents, one.terms)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    row = batch.slice(k, 1)
                    n = row.column("lengths")[0].values.to_numpy()
                    doc, tf = (np.frombuffer(row.column(c)[0].as_buffer(), "<i4").astype(np.int64) for c in ("docs", "tfs"))
                    norm = 100 - SHARE + SHARE * n * corpus.documents // max(1, corpus.terms)
                    impact = SCALE * tf // (1000 * tf + 8 * norm[doc])
                    slices = np.array([np.packbits((impact >> s & 1).astype(np.uint8)) for s in range(SLICES)], np.uint8)
                    yield pa.record_batch([*(row.column(c) for c in ("ids", "terms", "sizes", "docs")), _raw(slices, "u1")], [x.split()[0] for x in INDEX.split(", ")])
                release()

        return stored(found.mapInArrow(run, INDEX), "impacts"), corpus


@dataclass
class Items:
    """Some items: number, id and distinct terms of each, as places in `terms`; their terms' hashes, ascending, and weights."""

    numbers: list[int]
    ids: list[int | None]
    asked: list[np.ndarray]
    terms: np.ndarray
    weights: np.ndarray


def _portions(items: DataFrame) -> Iterator[Items]:
    """Items with terms in portions of a bounded size, read one after the other."""
    held, size, number = [], 0, 0

    def made() -> Items:
        text = scan(pa.array([x["text"] for x in held], pa.string()), ALNUM, fold=True)
        terms, which = np.unique(text.hashes, return_inverse=True)
        return Items(list(range(number - len(held), number)), [x["item_id"] for x in held], [np.unique(which[a:b]) for a, b in zip(text.first[:-1], text.first[1:], strict=True)], terms, np.zeros(len(terms), np.int64))

    for row in items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").toLocalIterator():
        if held and (len(held) >= ITEMS_AT_ONCE or size + len(row["text"]) > ITEM_BYTES):
            yield made()
            held, size = [], 0
        held.append(row)
        size += len(row["text"])
        number += 1
    if held:
        yield made()


def _found(terms: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in `asked`, places in `terms`) of the asked terms that a block has; both ascend."""
    if not len(terms):
        return (np.zeros(0, np.int64),) * 2
    at = np.minimum(np.searchsorted(terms, asked), len(terms) - 1)
    has = np.flatnonzero(terms[at] == asked)
    return has, at[has]


def frequencies(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """How many documents hold each of some terms (hashes, ascending): summed in each task, then over tasks."""
    shared = index.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for own, sizes in zip(*batch.columns, strict=True):
                asked, at = _found(np.frombuffer(own.as_buffer(), "<u8"), shared.value)
                total[asked] += np.frombuffer(sizes.as_buffer(), "<i4")[at]
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], ["term", "n"])

    out = np.zeros(len(terms), np.int64)
    for row in index.select("terms", "sizes").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        out[row.term] = row.n
    shared.destroy()
    return out


def _weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _add(total: np.ndarray, slices: np.ndarray, shift: int = 0) -> None:
    """Adds numbers in bit slices, times a power of two, to others in place: total[s] and slices[s] are bitmaps of bit s."""
    carry = None
    for s in range(shift, len(total)):
        here = total[s]
        if s - shift < len(slices):
            more = slices[s - shift]
            half = here ^ more
            over = here & more
            if carry is not None:
                over |= half & carry
                half ^= carry
            here[...] = half
            carry = over
        elif carry is None or not carry.any():
            return
        else:
            half = here ^ carry
            carry &= here
            here[...] = half


def weighted(slices: np.ndarray, weights: np.ndarray, bits: int) -> np.ndarray:
    """Slices of impacts times their terms' weights, [bit, term, word], by shifted additions."""
    out = np.zeros((bits, *slices.shape[1:]), np.uint64)
    for k in range(int(weights.max()).bit_length() if len(weights) else 0):
        on = np.where(weights >> k & 1, np.uint64(2**64 - 1), np.uint64(0))[:, None]
        if on.any():
            _add(out, slices & on, k)
    return out


def best(total: np.ndarray, k: int) -> np.ndarray:
    """Bitmaps [item, word] of each item's k highest numbers above 0 in the slices `total`; of equal ones, the first ones."""
    able = np.bitwise_or.reduce(total, axis=0)
    taken = np.zeros_like(able)
    for bits in total[::-1]:
        upper = taken | able & bits
        n = np.bitwise_count(upper).sum(axis=1, dtype=np.int64)[:, None]
        taken = np.where(n <= k, upper, taken)
        able = np.where(n > k, able & bits, able & ~bits)
    # those left are equal; as many of them as are wanted, from the first one on
    room = k - np.bitwise_count(taken).sum(axis=1, dtype=np.int64)
    left = np.flatnonzero((room > 0) & able.any(axis=1))
    if len(left):
        equal = np.unpackbits(able[left].view(np.uint8), axis=1, bitorder="little")
        equal[np.cumsum(equal, axis=1) > room[left, None]] = 0
        taken[left] |= np.packbits(equal, axis=1, bitorder="little").view(np.uint64)
    return taken


@dataclass
class Block:
    """One row of the index."""

    ids: pa.Array
    terms: np.ndarray
    starts: np.ndarray
    docs: np.ndarray
    slices: np.ndarray  # [bit, posting] of bytes, packed

    @staticmethod
    def of(row: pa.RecordBatch, i: int) -> Block:
        terms, sizes, docs, slices = (row.column(c)[i].as_buffer() for c in ("terms", "sizes", "docs", "slices"))
        return Block(row.column("ids")[i].values, np.frombuffer(terms, "<u8"), np.append(0, np.cumsum(np.frombuffer(sizes, "<i4"), dtype=np.int64)), np.frombuffer(docs, "<i4"), np.frombuffer(slices, np.uint8).reshape(SLICES, -1))

    def spread(self, terms: np.ndarray) -> np.ndarray:
        """The slices of some terms' impacts over the block's documents, [bit, term, word]."""
        sizes = self.starts[terms + 1] - self.starts[terms]
        at = np.repeat(self.starts[terms] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
        words = -(-len(self.ids) // 64)
        place = np.repeat(np.arange(len(terms)) * words * 64, sizes) + self.docs[at]
        byte, bit = at >> 3, (7 - (at & 7)).astype(np.uint8)
        out = np.empty((SLICES, len(terms), words), np.uint64)
        for s in range(SLICES):
            plane = np.zeros(len(terms) * words * 64, np.uint8)
            plane[place] = self.slices[s][byte] >> bit & 1
            out[s] = np.packbits(plane, bitorder="little").view(np.uint64).reshape(len(terms), words)
        return out


def _scores(block: Block, items: Items, k: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, document of the block, score) of each item's best k documents of a block."""
    asked, at = _found(block.terms, items.terms)
    none = (np.zeros(0, np.int64),) * 3
    if not len(asked):
        return none
    at_here = np.full(len(items.terms), -1)
    at_here[asked] = np.arange(len(asked))
    here = [x[x >= 0] for x in (at_here[x] for x in items.asked)]
    words = -(-len(block.ids) // 64)
    total = np.zeros((bits, len(here), words), np.uint64)
    for low in range(0, len(asked), TERMS_AT_ONCE):
        part = slice(low, low + TERMS_AT_ONCE)
        weights = items.weights[asked[part]]
        slices = weighted(block.spread(at[part]), weights, (int(weights.max()) * (10**6 - 1)).bit_length())
        own = [x[(x >= low) & (x < low + TERMS_AT_ONCE)] - low for x in here]
        order = np.argsort([-len(x) for x in own], kind="stable")  # those with many terms first: then the ones with a j-th term stand together
        sizes = np.array([len(own[i]) for i in order])
        sums = np.ascontiguousarray(total[:, order])
        for j in range(int(sizes[0])):
            n = int(np.searchsorted(-sizes, -j, "left"))
            _add(sums[:, :n], slices[:, [own[i][j] for i in order[:n]]])
        total[:, order] = sums
    item, doc = np.nonzero(np.unpackbits(best(total, k).view(np.uint8), axis=1, bitorder="little"))
    score = np.zeros(len(item), np.int64)
    for s in range(bits):
        score |= (total[s, item, doc >> 6] >> (doc & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64) << s
    return item, doc, score


def search(index: DataFrame, corpus: Corpus, items: DataFrame, k: int = 10) -> DataFrame:
    """(item, item_id, rank, doc_id, score): each item's k best documents with a score above 0, or all if there are fewer.

    items: item_id, text. A score sums weight times impact over the item's distinct terms; equal scores rank by ascending
    doc_id, a null one last. `item` numbers the rows of items: repeated ones are searched each for itself. Items with a
    null text or without terms that are found have no rows.
    """

    def found(portion: Items) -> DataFrame:
        df = frequencies(index, portion.terms)
        portion.weights = np.array([_weight(corpus.documents, int(n)) for n in df], np.int64)
        most = max((int(portion.weights[x].sum()) for x in portion.asked), default=0) * (10**6 - 1)
        shared, bits = index.sparkSession.sparkContext.broadcast(portion), max(1, most.bit_length())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            test = shared.value
            item, doc, null, score = (np.zeros(0, np.int64),) * 4
            for batch in batches:
                for i in range(batch.num_rows):
                    block = Block.of(batch, i)
                    more = _scores(block, test, k, bits)
                    own = block.ids.take(pa.array(more[1]))
                    item, score = np.concatenate([item, more[0]]), np.concatenate([score, more[2]])
                    doc, null = np.concatenate([doc, own.fill_null(0).to_numpy()]), np.concatenate([null, own.is_null().to_numpy(zero_copy_only=False).astype(np.int64)])
                    order = np.lexsort((doc, null, -score, item))
                    rank = np.arange(len(order)) - np.searchsorted(item[order], item[order], "left")
                    item, score, doc, null = (x[order[rank < k]] for x in (item, score, doc, null))
                release()
            ids = pa.array([test.ids[i] for i in item.tolist()], pa.int64())
            yield pa.record_batch([pa.array(np.array(test.numbers, np.int64)[item]), ids, pa.array(doc, mask=null.astype(bool)), pa.array(score)], [x.split()[0] for x in FOUND.split(", ")])

        return index.mapInArrow(run, FOUND)

    out, portions = None, _portions(items)
    now, then = next(portions, None), next(portions, None)
    while now:
        one = found(now)
        now, then = then, next(portions, None)
        if now or out is not None:
            one = stored(one, "ranked")  # of several portions, one is in memory at a time
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = index.sparkSession.createDataFrame([], FOUND)
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())))
    return ranked.where(F.col("rank") <= k).select("item", "item_id", "rank", "doc_id", "score")
