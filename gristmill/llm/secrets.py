"""Secret scans: fixed patterns, and guess cost of credential values by a minimum-cost segmentation.

The guess cost of a value is the least number of guesses (as log2) over all ways to cut it into segments, where a
segment is a word of the dictionary, a date, a repeated unit, a keyboard walk or brute force. A value in a credential
context whose cost is at least `min_bits` is a secret of kind `guess`, whatever its alphabet.
"""

from __future__ import annotations

import json
import math
import os
import re
from collections.abc import Callable, Iterator, Mapping
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: A credential word, then a separator, then a value: a wider context than the base pattern's.
CONTEXT = re.compile(r"""(?<![A-Za-z])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credential|auth|api[_ -]?key|access[_ -]?key|private[_ -]?key|pin)["']?[ \t]{0,4}(?:=>|:=|[:=])[ \t]{0,4}["']?([!-~]{6,})""", re.I | re.A)
#: RE2 for rows that may have anything at all; a superset of the patterns above.
MAY = r"(?i)AKIA[A-Z0-9]{12}|[0-9a-f]{32}|(?:pass|passwd|password|passphrase|passcode|pwd|secret|token|credential|auth|api[_ -]?key|access[_ -]?key|private[_ -]?key|pin)[\"']?[ \t]{0,4}[:=]|(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"
KINDS = ("assign", "access", "hex", "guess")

#: Frequent password words and English words, most frequent first.
WORDS = (
    "password 123456 qwerty letmein welcome admin dragon monkey master login princess football baseball shadow sunshine superman michael "
    "iloveyou trustno hello freedom whatever secret token key pass user test default changeme example root access private public love "
    "the and for you that this with have from they will what there when your can said each which their time about would make like into "
    "him has two more write see number way could people than first water been call who its now find long down day did get come made may "
    "part over new sound take only little work know place year live back give most very after thing our just name good sentence man think "
    "say great where help through much before line right too mean old any same tell boy follow came want show also around form three "
    "small set put end does another well large must big even such because turn here why ask went men read need land different home"
).split()
#: A vocabulary with word ends, in the order of the merges that made it, so frequent words come first. Without the file the dictionary is WORDS alone.
VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"


def dictionary(path: str | None = VOCABULARY) -> dict[str, int]:
    """word -> rank: how many guesses a guesser who knows the most frequent words needs. WORDS come first, then the whole
    words of three letters or more of the vocabulary at `path`, of which there are less than 50,000."""
    words = dict.fromkeys(WORDS)
    if path and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            known = json.load(f)["model"]["vocab"]
        whole = (x.removesuffix("</w>") for x in sorted(known, key=known.get) if x.endswith("</w>"))
        words |= dict.fromkeys(x for x in whole if len(x) >= 3 and x.isascii() and x.isalpha())
    return {w: i + 1 for i, w in enumerate(words)}


RANKS = {w: i + 1 for i, w in enumerate(WORDS)}
#: No longer word is looked for.
LONGEST = 24
_LEET = str.maketrans("@431!0$57", "aaeliosst")
_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
_NEXT = {(a, b) for row in _ROWS for a, b in zip(row, row[1:], strict=False)} | {(a, b) for up, low in zip(_ROWS, _ROWS[1:], strict=False) for i, a in enumerate(up) for b in low[max(0, i - 1) : i + 1]}
_NEXT |= {(b, a) for a, b in _NEXT}
_DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:(?:19|20)\d\d|\d\d)|(?:19|20)\d\d")


def _class_bits(text: str) -> float:
    """log2 of the alphabet a brute-force guesser needs for each character."""
    size = 26 * any("a" <= c <= "z" for c in text) + 26 * any("A" <= c <= "Z" for c in text) + 10 * any("0" <= c <= "9" for c in text) + 33 * any(not (c.isascii() and c.isalnum()) for c in text)
    return math.log2(size or 1)


def segments(value: str, ranks: Mapping[str, int] = RANKS) -> list[list[tuple[int, float, str]]]:
    """For each start the (end, cost in bits, kind) of the patterns that stand there."""
    n, low = len(value), value.lower()
    plain = low.translate(_LEET)
    found: list[list[tuple[int, float, str]]] = [[] for _ in range(n)]
    for i in range(n):
        for j in range(i + 3, min(n, i + LONGEST) + 1):
            for form, extra in ((low, 0), (plain, 2)):
                if rank := ranks.get(form[i:j]):
                    upper = sum(c.isupper() for c in value[i:j])
                    found[i].append((j, math.log2(rank) + extra + (upper and 1 + min(upper, j - i - upper)), "word"))
                    break
        if m := _DATE.match(value, i):
            found[i].append((m.end(), 7 if m.end() - i == 4 else 15.3, "date"))
    i = 0
    while i + 2 < n:  # walks, as long as they go
        j = i + 1
        turns, last = 0, None
        while j < n and ((low[j - 1], low[j]) in _NEXT or low[j].isalnum() and ord(low[j]) - ord(low[j - 1]) in (1, -1)):
            step = (ord(low[j]) - ord(low[j - 1])) if (low[j - 1], low[j]) not in _NEXT else 99
            turns += step != last
            last = step
            j += 1
        if j - i >= 3:
            found[i].append((j, math.log2(47 * (j - i)) + 2 * turns, "walk"))
        i = max(i + 1, j - 1)
    for unit in (1, 2, 3, 4, 5, 6, 7, 8):  # maximal runs of a unit, each once
        i = 0
        while i + 2 * unit <= n:
            j = i + unit
            while j < n and value[j] == value[j - unit]:
                j += 1
            if j - i >= max(3, 2 * unit):
                found[i].append((j, unit * _class_bits(value[i : i + unit]) + math.log2((j - i) / unit), "repeat"))
                i = j - unit + 1
            else:
                i = max(i + 1, j - unit + 1)
    return found


def guess_bits(value: str, ranks: Mapping[str, int] = RANKS) -> tuple[float, tuple[tuple[int, int, str], ...]]:
    """The least cost (bits) and the segmentation that has it; one bit is paid for each cut. "" costs 0."""
    n, each = len(value), _class_bits(value)
    best, by = [0.0] + [math.inf] * n, [(0, "")] * (n + 1)
    found = segments(value, ranks)
    for i in range(n):
        if best[i] + each < best[i + 1]:
            best[i + 1], by[i + 1] = best[i] + each, (i, "brute")
        for j, cost, kind in found[i]:
            if best[i] + cost + 1 < best[j]:
                best[j], by[j] = best[i] + cost + 1, (i, kind)
    cuts, at = [], n
    while at:
        start, kind = by[at]
        if cuts and kind == cuts[-1][2] == "brute":
            cuts[-1] = (start, cuts[-1][1], kind)
        else:
            cuts.append((start, at, kind))
        at = start
    return best[n], tuple(reversed(cuts))


class Finder:
    """Finds spans in texts; keeps the costs of the last values."""

    def __init__(self, ranks: Mapping[str, int] = RANKS, min_bits: float = 40.0):
        self.min_bits, self.bits = min_bits, lru_cache(4096)(lambda value: guess_bits(value, ranks)[0])

    def __call__(self, text: str) -> list[tuple[str, int, int]]:
        return find(text, self.min_bits, self.bits)


def find(text: str, min_bits: float = 40.0, bits: Callable[[str], float] = lambda x: guess_bits(x)[0]) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then by the order of KINDS."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    for m in CONTEXT.finditer(text):
        value = m[1].rstrip("\"'`,;:.)]}>!?*#$&%")
        if len(value) >= 6 and bits(value) >= min_bits:
            out.append(("guess", m.start(1), m.start(1) + len(value)))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def scan(docs: DataFrame, min_bits: float = 40.0, vocabulary: str | None = VOCABULARY) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) of each row's whole text; null and empty texts have no spans.

    The dictionary, of bounded size, is read by the driver and broadcast. Other columns of `docs` are not read; repeated rows are scanned each for itself.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(dictionary(vocabulary))
    struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_of = Finder(ranks.value, min_bits)
        for batch in batches:
            texts = batch.column(1)
            may = pc.fill_null(pc.match_substring_regex(texts, MAY), False).to_pylist()
            spans = [[dict(zip(("kind", "start", "end"), x, strict=True)) for x in spans_of(texts[i].as_py())] if hit else [] for i, hit in enumerate(may)]
            yield pa.record_batch([batch.column(0), pa.array(spans, struct)], ["doc_id", "spans"])

    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(run, "doc_id long, spans array<struct<kind string, start long, end long>>")


def redact(docs: DataFrame, mark: str = "[secret]", min_bits: float = 40.0, vocabulary: str | None = VOCABULARY) -> DataFrame:
    """The rows of `docs`, all columns, with each secret in `text` replaced by `mark`; overlapping spans as one.

    Of an assignment only the value goes. Null stays null; n_chars, where there is one, follows the text.
    """
    schema = docs.schema
    ranks = docs.sparkSession.sparkContext.broadcast(dictionary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_of = Finder(ranks.value, min_bits)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = batch.column(at)
            may = pc.fill_null(pc.match_substring_regex(texts, MAY), False)
            if not pc.any(may).as_py():
                yield batch
                continue
            changed = [_redacted(x.as_py(), mark, spans_of) if hit else x.as_py() for x, hit in zip(texts, may.to_pylist(), strict=True)]
            columns = list(batch.columns)
            columns[at] = pa.array(changed, texts.type)
            size = batch.schema.get_field_index("n_chars")
            if size >= 0:
                kept = columns[size].to_pylist()
                columns[size] = pa.array([len(new) if hit else old for new, hit, old in zip(changed, may.to_pylist(), kept, strict=True)], columns[size].type)
            yield pa.record_batch(columns, batch.schema.names)

    return docs.mapInArrow(run, schema)


def _redacted(text: str, mark: str, spans_of: Finder) -> str:
    spans = []
    for kind, start, end in spans_of(text):
        if kind == "assign" and (m := ASSIGN.match(text, start)):
            start = m.start(2)
        spans.append((start, end))
    out, at = [], 0
    for start, end in sorted(spans):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mark]
        at = end
    return "".join(out) + text[at:]

