"""The pieces that tokenizers cut texts into before they merge bytes, found for whole columns by numpy.

Byte-level tokenizers of the pattern below merge within a pre-token alone, and a piece model that has no piece with a
space after another character merges within a stretch from one space to the next alone. So texts of any length are
tokenized by their distinct pieces, and each worker keeps what the commonest pieces gave.

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from tokenizers import pre_tokenizers

from gristmill.llm.tokens import _AT_ONCE, _BASE_POWERS, _BYTE, mix

#: Texts are worked on in stretches of about so many bytes, cut where no piece lies across.
STRETCH = 1 << 20
#: Pieces of at most so many bytes are kept, and so many of them at most; the others are worked out again.
KEPT_BYTES, KEPT = 64, 200_000
LETTER, NUMBER, OTHER, SPACE, UNKNOWN = range(5)
_RULE = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
_CLASS = np.full(0x110000, UNKNOWN, np.uint8)


def vocabulary_path(name: str) -> str:
    """Where the installed public tokenizers have a file; a path is taken as it is."""
    if os.path.dirname(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def vocabulary(name: str) -> bytes:
    """A tokenizer's file, read by the driver once, so that executors need no such file. Its size is fixed."""
    with open(vocabulary_path(name), "rb") as f:
        return f.read()


def _class_of(c: str) -> int:
    """What the pattern takes a character for, told by what it joins in the tokenizers' own pre-tokenizer."""
    return next((k for k, x in enumerate("a1!") if len(_RULE.pre_tokenize_str(x + c)) == 1), SPACE)


def classes(points: np.ndarray) -> np.ndarray:
    """The class of each code point; a worker asks for each one once."""
    out = _CLASS[points]
    if (out == UNKNOWN).any():
        for c in np.unique(points[out == UNKNOWN]).tolist():
            _CLASS[c] = _class_of(chr(c))
        out = _CLASS[points]
    return out


@dataclass
class Pieces:
    """Pieces of the texts in one buffer, by byte; `first` has the first piece of each row (and the end)."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


@dataclass
class Chars:
    """Characters of the texts in one buffer: where their bytes begin (and the end), and the first of each row (and the end)."""

    at: np.ndarray
    first: np.ndarray
    points: np.ndarray
    kinds: np.ndarray

    @staticmethod
    def of(data: np.ndarray, offsets: np.ndarray) -> Chars:
        at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
        return Chars(at, np.searchsorted(at[:-1], offsets), points, classes(points))


def _row_edges(first: np.ndarray, n: int) -> np.ndarray:
    """Whether a row begins at each of n + 1 places; the end counts as one."""
    edge = np.zeros(n + 1, bool)
    edge[first] = True
    edge[n] = True
    return edge


@dataclass
class PreTokens:
    """Where pre-tokens begin, as characters, and what prefixes that end in the middle of something need to know."""

    starts: np.ndarray  # of characters, the end not among them
    space_runs: tuple[np.ndarray, np.ndarray]  # of two or more before something else in a row: a prefix has them as one
    contractions: np.ndarray  # places of the first letter of two after an apostrophe: a prefix has it as a piece of its own


def pre_tokens(chars: Chars) -> PreTokens:
    """Pre-tokens of every row, by the pattern above: alternatives as tests of the runs of one class of characters."""
    n = len(chars.points)
    none = np.zeros(0, np.int64)
    if n == 0:
        return PreTokens(none, (none, none), none)
    edge, kinds, points = _row_edges(chars.first, n), chars.kinds, chars.points
    begin = edge[:n].copy()
    begin[1:] |= kinds[1:] != kinds[:-1]
    runs = np.flatnonzero(begin)
    ends = np.append(runs[1:], n)
    # white space before something else of its row keeps its last character apart, and a blank goes to what follows
    spaces = (kinds[runs] == SPACE) & ~edge[ends]
    low, high = runs[spaces], ends[spaces]
    start = begin
    start[high - 1] = True
    start[high[points[high - 1] == 0x20]] = False
    # an apostrophe alone, with no blank before it, takes some letters after it
    alone = runs[(points[runs] == 0x27) & (ends - runs == 1) & start[runs] & ~edge[ends]]
    letter = points[alone + 1]
    one = alone[np.isin(letter, [ord(c) for c in "stmd"])]
    more = alone[~edge[np.minimum(alone + 2, n)]]
    two = more[np.any([(points[more + 1] == ord(a)) & (points[more + 2] == ord(b)) for a, b in ("re", "ve", "ll")], axis=0)]
    start[one + 1] = start[two + 1] = False
    for after in (one + 2, two + 3):
        start[after[after < n]] = True
    long = high - low > 1
    return PreTokens(np.flatnonzero(start), (low[long], high[long]), two + 1)


def byte_level(data: np.ndarray, offsets: np.ndarray) -> Pieces:
    """The pre-tokens of every row."""
    chars = Chars.of(data, offsets)
    starts = chars.at[pre_tokens(chars).starts]
    return Pieces(starts, np.append(starts[1:], len(data))[: len(starts)], np.searchsorted(starts, offsets))


def by_spaces(data: np.ndarray, offsets: np.ndarray) -> Pieces:
    """Stretches of every row that begin at the first of some blanks."""
    blank = data == 0x20
    start = blank.copy()
    start[1:] &= ~blank[:-1]
    start[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(start)
    return Pieces(starts, np.append(starts[1:], len(data))[: len(starts)], np.searchsorted(starts, offsets))


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ascending spans of bytes that don't overlap."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        low = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, low + _AT_ONCE, "right")))
        part = data[low : ends[j - 1]]
        up, down = _BASE_POWERS.to(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * up, out=sums[1:])
        out[i:j] = (sums[ends[i:j] - low] - sums[starts[i:j] - low]) * down[starts[i:j] - low]
        i = j
    return mix(out)


class Kept:
    """What a function gives for pieces, as 32-bit values. That of short pieces that stood more than once in a batch is kept for
    the next ones, up to a bound: half of it for what came lately, half for what came before."""

    def __init__(self, work: Callable[[list[bytes]], list[bytes]]):
        self.work, self.new, self.old = work, {}, {}

    def of(self, words: list[bytes], again: list[bool]) -> list[bytes]:
        """The values of distinct words; `again` tells which ones to keep."""
        out = list(map(self.new.get, words))
        missing, back = [], {}
        for i, x in enumerate(out):
            if x is None:
                x = out[i] = self.old.get(words[i])
                if x is None:
                    missing.append(i)
                else:
                    back[words[i]] = x
        for i, x in zip(missing, self.work([words[i] for i in missing]) if missing else (), strict=True):
            out[i] = x
            if again[i] and len(words[i]) <= KEPT_BYTES:
                back[words[i]] = x
        if len(self.new) + len(back) > KEPT // 2:
            self.new, self.old = {}, self.new
        self.new |= back
        return out


def distinct(kept: Kept, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(values, sizes, at, which): the values of all distinct pieces one after the other, how many each has, where each stands
    first, and each piece's number among them."""
    _, at, which, times = np.unique(_hashes(data, starts, ends), return_index=True, return_inverse=True, return_counts=True)
    raw = data.tobytes()
    found = kept.of([raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], (times > 1).tolist())
    sizes = np.fromiter(map(len, found), np.int64, len(found)) >> 2
    return np.frombuffer(b"".join(found), np.int32).astype(np.int64), sizes, at, which


def looked_up(kept: Kept, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, from, number): the values of all distinct pieces, and where each piece's are among them."""
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3
    values, sizes, _, which = distinct(kept, data, starts, ends)
    return values, (np.cumsum(sizes) - sizes)[which], sizes[which]


def spread(begin: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Places begin[0], begin[0] + 1, ... number[0] of them, then those of the next."""
    ahead = np.cumsum(number) - number
    return np.arange(int(number.sum())) + np.repeat(begin - ahead, number)


def stretches(data: np.ndarray, most: int = STRETCH) -> Iterator[tuple[int, int]]:
    """Spans of one text, each of about `most` bytes: cut at a blank after an ASCII letter or digit, where all kinds of pieces
    begin anew. A text without such a place is one span."""
    at, n = 0, len(data)
    while n - at > most:
        cut = -1
        low = at + most
        while cut < 0 and low < n:
            part = data[low - 1 : min(n, low + (1 << 16))]
            before = part[:-1] | 0x20
            fits = (part[1:] == 0x20) & ((before >= 97) & (before <= 122) | (part[:-1] >= 48) & (part[:-1] <= 57))
            where = np.flatnonzero(fits)
            cut = low + int(where[0]) if len(where) else -1
            low += 1 << 16
        if cut < 0:
            break
        yield at, cut
        at = cut
    yield at, n
