"""Exact token counts of every prefix of a text, by dynamic programming, for budgets and truncation without encoding again.

A byte-pair encoding is the one sequence of tokens in which every two neighbours encode to themselves. So the encoding
of a prefix is that of a shorter prefix and one token that goes with its last: for each end the tokens that end there are
tried, longest first, and the count is that of the shorter prefix and one. Two tokens go together unless, while the pieces
that they are made of are merged, a merge across their border comes first.

Texts are cut into pre-tokens before, and a prefix may cut them otherwise at its end only: blanks at the end are one
pre-token, and of an apostrophe with two letters the first one stands alone. The table keeps, for each text, the
differences of the counts of neighbouring prefixes, one byte a character.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from gristmill.llm.common import stored
from gristmill.llm.pretokens import STRETCH, Chars, Kept, looked_up, pre_tokens, spread, stretches, vocabulary
from gristmill.llm.tokens import binary_array, blocks, column_bytes, release

VOCABULARY = "byte_bpe_50k.json"
TABLE = "doc_id long, n_bytes long, n_chars long, n_tokens long, steps binary"
#: Pairs of tokens whose going together is kept.
_PAIRS = 1_000_000


def byte_letters() -> dict[str, int]:
    """Which byte each letter of a byte-level vocabulary stands for: printable ones for themselves, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class BytePairs:
    """A byte-level byte-pair tokenizer's merges, and the special strings that it takes out of texts."""

    def __init__(self, file: bytes):
        model = json.loads(file)
        letters = byte_letters()
        vocab = {k: v for k, v in model["model"]["vocab"].items() if all(c in letters for c in k)}
        self.text = {v: bytes(letters[c] for c in k) for k, v in vocab.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            a, b, c = vocab[a], vocab[b], vocab[a + b]
            self.rank[a, b] = rank
            if c in self.made:
                raise ValueError("a token that two merges make is not supported")
            self.made[c] = a, b
        if max(map(len, self.text.values())) > 128:
            raise ValueError("tokens of more than 128 bytes are not supported")
        self.specials = [x["content"].encode() for x in model.get("added_tokens", ())]
        self._goes: dict[int, bool] = {}
        self._edges: tuple[dict, dict] = {}, {}
        self.ends = ahocorasick.Automaton()
        for token, text in self.text.items():
            if token not in self.made or self._goes_together(*self.made[token], self.rank[self.made[token]]):
                self.ends.add_word(text.decode("latin-1"), token << 8 | len(text))
        self.ends.make_automaton()

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The pieces at one side of a token while it is merged, each with the rank of the merge that ends it."""
        found = self._edges[side].get(token)
        if found is None:
            found, at, until = [], token, float("inf")
            while at in self.made:
                found.append((at, until))
                until, at = self.rank[self.made[at]], self.made[at][side]
            found.append((at, until))
            self._edges[side][token] = found
        return found

    def _goes_together(self, left: int, right: int, least: float = float("inf")) -> bool:
        """Whether no merge across the border of two tokens comes first; of equal ones the one further left comes first."""
        rank = self.rank
        for a, before in self._edge(left, 1):
            for b, until in self._edge(right, 0):
                at = rank.get((a, b))
                if at is not None and at < before and at <= until and at < least:
                    return False
        return True

    def _learned(self, pair: int) -> bool:
        if len(self._goes) >= _PAIRS:
            self._goes.clear()
        found = self._goes[pair] = self._goes_together(pair >> 32, pair & 0xFFFFFFFF)
        return found

    def prefixes(self, word: bytes) -> tuple[list[int], list[int]]:
        """The number of tokens of each prefix of a pre-token by bytes, from the empty one, and each one's last token."""
        count, last, goes, done = [0], [-1], self._goes, -1
        for end, token in self.ends.iter(word.decode("latin-1")):  # at one end, the longest comes first
            if end != done:
                begin = end + 1 - (token & 0xFF)
                token >>= 8
                if begin:
                    pair = last[begin] << 32 | token
                    fits = goes.get(pair)
                    if not (self._learned(pair) if fits is None else fits):
                        continue
                count.append(count[begin] + 1)
                last.append(token)
                done = end
        return count, last

    def tokens(self, word: bytes) -> list[int]:
        """The tokens of a pre-token, read back from its prefixes."""
        _, last = self.prefixes(word)
        out, end = [], len(word)
        while end:
            out.append(last[end])
            end -= len(self.text[last[end]])
        return out[::-1]

    def by_characters(self, words: list[bytes]) -> list[bytes]:
        """Counts of the prefixes of each word that end with a character, as 32-bit values."""
        out = []
        for word in words:
            count = self.prefixes(word)[0]
            out.append(array("i", count[1:] if word.isascii() else [c for c, after in zip(count[1:], word[1:] + b"a", strict=True) if after & 0xC0 != 0x80]).tobytes())
        return out


@lru_cache(2)
def _loaded(file: bytes) -> tuple[BytePairs, Kept]:
    pairs = BytePairs(file)
    return pairs, Kept(pairs.by_characters)


def _counts(kept: Kept, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts, first): the token count of each row's prefix up to each character, and each row's first character (and the end)."""
    chars = Chars.of(data, offsets)
    found = pre_tokens(chars)
    n = len(chars.points)
    starts, ends = found.starts, np.append(found.starts[1:], n)[: len(found.starts)]
    table, at, number = looked_up(kept, data, chars.at[starts], chars.at[ends])
    whole = table[at + number - 1] if len(starts) else number
    # tokens of a row before each pre-token, by prefix sums of all and the row's share taken off
    before = np.cumsum(whole) - whole
    row_first = np.searchsorted(starts, chars.first)
    before -= np.repeat(np.append(before, 0)[row_first[:-1]], np.diff(row_first))
    out = np.repeat(before, number) + table[spread(at, number)]
    low, high = found.space_runs
    if len(low):
        table, at, number = looked_up(kept, data, chars.at[low], chars.at[high])
        out[spread(low, number)] = np.repeat(before[np.searchsorted(starts, low)], number) + table[spread(at, number)]
    out[found.contractions] = before[np.searchsorted(starts, found.contractions, "right") - 1] + 2
    return out, chars.first


def text_counts(pairs: BytePairs, kept: Kept, text: bytes) -> Iterator[np.ndarray]:
    """Counts of the prefixes of one text, in stretches. A special string is one token once it is whole."""
    base, at = 0, 0
    while at <= len(text):
        where, special = min(((i, -len(s), s) for s in pairs.specials if s and (i := text.find(s, at)) >= 0), default=(-1, 0, b""))[::2]
        end = where if special else len(text)
        part, total = text[at:end] + special[:-1], len(text[at:end].decode())
        own, done, size = 0, 0, np.frombuffer(part, np.uint8)
        for a, b in stretches(size, STRETCH):
            counts = _counts(kept, size[a:b], np.array([0, b - a]))[0] + own
            own = int(counts[-1]) if len(counts) else own
            yield base + counts
            if done < total <= done + len(counts):
                inside = int(counts[total - done - 1])
            done += len(counts)
        if not special:
            return
        base += (inside if total else 0) + 1
        yield np.array([base])
        at = end + len(special)


def _steps(counts: np.ndarray, last: int = 0) -> np.ndarray:
    return np.diff(counts, prepend=last).astype(np.int8)


def prefix_counts(docs: DataFrame, vocabulary_file: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_bytes, n_chars, n_tokens, steps) for every row of docs, stored in the shared folder.

    steps has a signed byte for each character: by how much the count of tokens changes when the prefix takes it in, so
    that their sum up to any place is the exact token count of that prefix, as the tokenizer itself gives it without begin or
    end tokens and with its special strings taken out of texts. n_tokens is the last of these counts.

    docs: doc_id, text; other columns are not read. A null text counts as empty: no bytes, no tokens. Repeated rows and null
    ids are rows of their own. An empty table gives an empty one. A text is worked on in stretches of a megabyte, cut at
    blanks; only a run without any such place is taken whole.
    """
    file = docs.sparkSession.sparkContext.broadcast(vocabulary(vocabulary_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, kept = _loaded(file.value)
        for batch in blocks(batches, "text", STRETCH):
            data, offs = column_bytes(batch.column(1))
            raw = data.tobytes()
            alone = len(raw) > STRETCH or any(s and s in raw for s in pairs.specials)
            if not alone:
                counts, first = _counts(kept, data, offs)
                steps = np.diff(counts, prepend=0)
                heads = first[:-1][np.diff(first) > 0]
                steps[heads] = counts[heads]
                blob, ends = steps.astype(np.int8), first
                tokens = np.where(np.diff(first) > 0, np.append(counts, 0)[first[1:] - 1], 0)
            else:
                parts, ends, tokens = [], [0], []
                for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                    last = n = 0
                    for counts in text_counts(pairs, kept, raw[a:b]):
                        parts.append(_steps(counts, last))
                        last, n = int(counts[-1]) if len(counts) else last, n + len(counts)
                    ends.append(ends[-1] + n)
                    tokens.append(last)
                blob = np.concatenate(parts) if parts else np.zeros(0, np.int8)
            sizes = (pa.array(x, pa.int64()) for x in (np.diff(offs), np.diff(ends), tokens))
            yield pa.record_batch([batch.column(0), *sizes, binary_array(blob.view(np.uint8), np.asarray(ends))], [x.split()[0] for x in TABLE.split(", ")])
        release()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.make_valid_utf8(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))
    return stored(texts.mapInArrow(run, TABLE), "prefixes")


def _summed(steps: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int64)


@F.pandas_udf(LongType())
def count_at(steps: pd.Series, chars: pd.Series) -> pd.Series:
    """Exact tokens of the first `chars` characters of a text; none of a null or of less than one, all beyond its end."""

    def one(x: bytes, n: object) -> int:
        n = 0 if pd.isna(n) else int(n)
        return int(np.frombuffer(x, np.int8)[: max(0, n)].sum(dtype=np.int64))

    return pd.Series([one(x, n) for x, n in zip(steps, chars, strict=True)], dtype="int64")


@F.pandas_udf(LongType())
def longest_prefix(steps: pd.Series, budget: pd.Series) -> pd.Series:
    """Characters of a text's longest prefix of at most `budget` tokens; a null budget takes none. A longer prefix may have fewer tokens."""

    def one(x: bytes, most: object) -> int:
        fits = np.flatnonzero(_summed(x) <= (-1 if pd.isna(most) else most))
        return int(fits[-1]) + 1 if len(fits) else 0

    return pd.Series([one(x, most) for x, most in zip(steps, budget, strict=True)], dtype="int64")
