"""Alignment of two tokenizers' tokens over the same bytes, whole Arrow batches at a time.

The texts of a batch stand in one buffer, a blank before each. The ends of A's tokens and of B's are byte offsets into it,
counted per byte with one bincount each. Where both end, a group ends: one text's groups are numbered by prefix sums of
such places over the whole buffer, less what came before the text. A token of A and one of B overlap in the bytes between
two neighbouring ends of either, and in one such stretch only; so the links are the places where a token of either ends.

How many documents hold a pair of ids linked is counted over all documents, from each one's distinct pairs.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from gristmill.llm.common import small, stored
from gristmill.llm.pretokens import STRETCH, Kept, Pieces, by_spaces, byte_level, distinct, spread, stretches, vocabulary
from gristmill.llm.token_counts import byte_letters
from gristmill.llm.tokens import blocks, column_bytes, release

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, links array<int>"
#: Id pairs are broadcast to the documents' links up to so many (some 24 bytes each); beyond, both are shuffled by pair.
PAIRS_AT_ONCE = 2_000_000
#: A pair of ids as one number: A's times this, and B's.
B_IDS = 1 << 31
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


@dataclass
class Side:
    """One tokenizer: how it cuts texts into pieces, the ids of pieces, and the bytes of ids as one buffer and each one's place."""

    pieces: Callable[[np.ndarray, np.ndarray], Pieces]
    kept: Kept
    table: list[bytes]

    def __post_init__(self) -> None:
        self.sizes = np.fromiter(map(len, self.table), np.int64, len(self.table))
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.text = np.frombuffer(b"".join(self.table), np.uint8)

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        return self.text[spread(self.begin[ids], self.sizes[ids])]


def _whole(data: np.ndarray, offsets: np.ndarray) -> Pieces:
    starts = offsets[:-1][np.diff(offsets) > 0]
    return Pieces(starts, np.append(starts[1:], len(data))[: len(starts)], np.searchsorted(starts, offsets))


@lru_cache(2)
def _loaded(a_file: bytes, b_file: bytes) -> tuple[Side, Side]:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task is one thread
    a = Tokenizer.from_str(a_file.decode())
    a.encode_special_tokens = True  # their strings in texts are plain text
    letters = byte_letters()
    a_bytes = [bytes(letters.get(c, 0x3F) for c in a.id_to_token(i) or "") for i in range(a.get_vocab_size())]
    b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
    pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
    b_bytes = [bytes([int(m[1], 16)]) if b.is_byte(i) and (m := _BYTE_PIECE.fullmatch(p)) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    # B adds the blank before a text itself; a stretch from one blank to the next is like a text of its own unless pieces cross blanks
    crossing = any(re.search("[^▁]▁", p) for p in pieces)
    blank = array("i", [b.piece_to_id("▁")]).tobytes()

    def a_ids(words: list[bytes]) -> list[bytes]:
        return [array("i", x.ids).tobytes() for x in a.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]

    def b_ids(words: list[bytes]) -> list[bytes]:
        return [array("i", ids).tobytes() if w != b" " else blank for w, ids in zip(words, b.encode([w[1:].decode() for w in words], num_threads=1), strict=True)]

    return Side(byte_level, Kept(a_ids), a_bytes), Side(_whole if crossing else by_spaces, Kept(b_ids), b_bytes)


def _encoded(side: Side, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, first, odd): the tokens of all rows, each row's first one (and the end), and rows with a piece that its tokens
    don't spell."""
    pieces = side.pieces(data, offsets)
    if not len(pieces.starts):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64)
    values, sizes, at, which = distinct(side.kept, data, pieces.starts, pieces.ends)
    ends = np.cumsum(sizes)
    long = (pieces.ends - pieces.starts)[at]
    sums = np.append(0, np.cumsum(side.sizes[values]))
    off = sums[ends] - sums[ends - sizes] != long
    number = sizes[which]
    ids = values[spread((ends - sizes)[which], number)]
    same = ~off
    if not off.any():
        unlike = side.spelled(values) != data[spread(pieces.starts[at], long)]
        off = np.add.reduceat(unlike, np.cumsum(long) - long) if len(long) else off
    else:  # token by token only where lengths agree
        part = values[np.repeat(same, sizes)]
        unlike = side.spelled(part) != data[spread(pieces.starts[at][same], long[same])]
        if same.any():
            off[same] = np.add.reduceat(unlike, np.cumsum(long[same]) - long[same])
    odd = np.flatnonzero(off[which])
    return ids, np.append(0, np.cumsum(number))[pieces.first], np.unique(np.searchsorted(pieces.first, odd, "right") - 1)


@lru_cache(8)
def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(digits, number): the decimal digits of all values below n, a row for each place from the last one, and how many there are."""
    values = np.arange(n)
    rows, number = [(48 + values % 10).astype(np.uint8)], np.ones(n, np.int64)
    while (values := values // 10).any():
        rows.append((48 + values % 10).astype(np.uint8))
        number += values > 0
    return np.array(rows), number


def _decimal(values: np.ndarray, marks: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, ends): each value, below `most`, in decimal and its mark after it, one after the other, and where each ends."""
    digits, number = _digits(most)
    number = number[values]
    ends = np.cumsum(number + 1)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    out[ends - 1] = marks
    for k in range(len(digits)):
        has = np.flatnonzero(number > k)
        out[ends[has] - (2 + k)] = digits[k][values[has]]
    return out, ends


@dataclass
class Aligned:
    """What some rows' texts give: counts a row, the groups as text, and the distinct linked pairs of ids of each row."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[bytes]
    first: np.ndarray  # of pairs, by row (and the end)
    pairs: np.ndarray
    links: np.ndarray


def aligned(sides: tuple[Side, Side], data: np.ndarray, offsets: np.ndarray) -> tuple[Aligned, np.ndarray]:
    """Groups and links of the rows' bytes, each with its blank in front, and whether each row's tokens spell its bytes:
    those that don't have no tokens."""
    n = len(offsets) - 1
    (a, a_first, a_odd), (b, b_first, b_odd) = (_encoded(side, data, offsets) for side in sides)
    raw, good = data.tobytes(), np.ones(n, bool)
    for rows, ids, first, side in ((a_odd, a, a_first, sides[0]), (b_odd, b, b_first, sides[1])):
        for r in rows.tolist():
            good[r] &= side.spelled(ids[first[r] : first[r + 1]]).tobytes() == raw[offsets[r] : offsets[r + 1]]
    if not good.all():
        kept = np.repeat(good, np.diff(offsets))
        found, _ = aligned(sides, data[kept], np.append(0, np.cumsum(np.diff(offsets) * good)))
        return found, good
    end = len(data)
    a_size, b_size = (side.sizes for side in sides)
    a_end, b_end = np.cumsum(a_size[a]), np.cumsum(b_size[b])
    at_a, at_b = np.bincount(a_end, minlength=end + 1), np.bincount(b_end, minlength=end + 1)
    until_a, until_b, until_both = np.cumsum(at_a), np.cumsum(at_b), np.cumsum(at_a & at_b)
    per_row = lambda sums: np.diff(sums[offsets])
    either = np.flatnonzero(at_a | at_b)
    link_a, link_b = a[until_a[either - 1]], b[until_b[either - 1]]
    row = np.searchsorted(offsets, either, "left") - 1
    shift_b, shift = len(b_size).bit_length(), len(a_size).bit_length() + len(b_size).bit_length()
    code = np.sort(row << shift | link_a << shift_b | link_b)
    new = np.flatnonzero(np.append(True, np.diff(code) != 0)[: len(code)])
    links, code = np.diff(np.append(new, len(code))), code[new]
    pairs = (code >> shift_b & (1 << shift - shift_b) - 1) * B_IDS + (code & (1 << shift_b) - 1)
    # A's tokens of a group stand before B's, and after all tokens of the groups before
    a_group, b_group = until_both[a_end - 1], until_both[b_end - 1]
    a_at, b_at = np.arange(len(a)) + np.searchsorted(b_group, a_group, "left"), np.arange(len(b)) + np.searchsorted(a_group, b_group, "right")
    values, marks = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    values[a_at], values[b_at] = a, b
    marks[a_at[at_b[a_end] == 1]], marks[b_at[at_a[b_end] == 1]] = ord("|"), ord(";")
    text, ends = _decimal(values, marks, max(len(a_size), len(b_size)))
    ends, cut = np.append(0, ends), a_first + b_first
    spelled = text.tobytes()
    groups = [spelled[i : max(i, j - 1)] for i, j in zip(ends[cut[:-1]].tolist(), ends[cut[1:]].tolist(), strict=True)]
    n_links = np.bincount(row, minlength=n)
    return Aligned(per_row(until_a), per_row(until_b), per_row(until_both), n_links, groups, np.searchsorted(code >> shift, np.arange(n + 1)), pairs, links), good


def _joined(parts: list[Aligned]) -> Aligned:
    """One row's stretches as one row."""
    total = lambda name: np.array([sum(int(getattr(p, name)[0]) for p in parts)])
    pairs, which = np.unique(np.concatenate([p.pairs for p in parts]), return_inverse=True)
    links = np.bincount(which, np.concatenate([p.links for p in parts]), len(pairs)).astype(np.int64)
    return Aligned(total("n_a"), total("n_b"), total("n_groups"), total("n_links"), [b";".join(p.groups[0] for p in parts)], np.array([0, len(pairs)]), pairs, links)


def _one(sides: tuple[Side, Side], text: np.ndarray) -> Aligned:
    """One long text, in stretches at whose borders both tokenizers begin anew."""
    parts, none = [], np.zeros(0, np.uint8)
    for a, b in stretches(text, STRETCH):
        part, good = aligned(sides, text[a:b], np.array([0, b - a]))
        if not good[0]:
            return aligned(sides, none, np.array([0, 0]))[0]
        parts.append(part)
    return _joined(parts)


def align(docs: DataFrame, a: str = A, b: str = B, digest: bool = False) -> DataFrame:
    """A row for each row of docs, stored in the shared folder: row (a number of its own), doc_id, n_a, n_b (tokens), n_groups,
    n_links, groups, and pairs with links: the distinct linked pairs of ids, A's times B_IDS and B's, and how often each is.

    groups lists the ids of each group, `a1,a2|b1;a3|b2,b3`; with digest it is this text's SHA-256 in hexadecimal, '' for none.
    A (byte-level, by the tokenizers library) encodes a blank and the text, B (sentencepiece) the text, to which it adds the
    blank. Special tokens' strings are plain text. A text that is null or empty, or whose tokens' bytes differ from the blank
    and the text, has no tokens: zeros, no pairs.

    docs: doc_id, text; other columns are not read. Repeated rows and null ids are rows of their own; an empty table gives an
    empty one. Texts are worked on in stretches of a megabyte, cut at blanks; only a run without any such place is taken whole.
    """
    sc = docs.sparkSession.sparkContext
    files = sc.broadcast((vocabulary(a), vocabulary(b)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _loaded(*files.value)
        row = TaskContext.get().partitionId() << 32
        for batch in blocks(batches, "text", STRETCH):
            data, offs = column_bytes(batch.column(1))
            has = np.diff(offs) > 0
            begin = np.append(0, np.cumsum(np.diff(offs) + has))
            text = np.empty(int(begin[-1]), np.uint8)
            text[begin[:-1][has]] = 0x20
            inside = np.ones(len(text), bool)
            inside[begin[:-1][has]] = False
            text[inside] = data
            found = _one(sides, text) if len(data) > STRETCH else aligned(sides, text, begin)[0]
            groups = [x.decode() if not digest else hashlib.sha256(x).hexdigest() if x else "" for x in found.groups]
            first = pa.array(found.first, pa.int32())
            counts = (pa.array(x, pa.int64()) for x in (found.n_a, found.n_b, found.n_groups, found.n_links))
            lists = (pa.ListArray.from_arrays(first, pa.array(found.pairs, pa.int64())), pa.ListArray.from_arrays(first, pa.array(found.links, pa.int32())))
            yield pa.record_batch([pa.array(np.arange(row, row + batch.num_rows)), batch.column(0), *counts, pa.array(groups, pa.string()), *lists], [x.split()[0] for x in ALIGNED.split(", ")])
            row += batch.num_rows
        release()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.make_valid_utf8(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))
    return stored(texts.mapInArrow(run, ALIGNED), "aligned")


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, n, best) of every linked pair of ids, stored: how many documents hold it, and whether no pair of its A id is in more.

    Pairs are counted in each task before they are shuffled; a pair of one A id is one of B's vocabulary, so a group is bounded.
    """
    counts = found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.expr(f"pair div {B_IDS}L")))
    return stored(counts.select("pair", "n", (F.col("n") == most).alias("best")), "pair-counts")


def agreement(found: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """The rows of `align` with n_best, the links whose pair is in as many documents as any of its A id, and count_sum, the sum
    over links of how many documents hold their pair."""
    counts = pair_counts(found) if counts is None else counts
    links = found.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.links").cast("long").alias("times"))
    sums = links.join(small(counts, PAIRS_AT_ONCE), "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return found.join(sums, "row", "left").select(*found.columns, F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"))
