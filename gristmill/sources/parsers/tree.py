"""A syntax tree as rows, depth first."""

from __future__ import annotations

from contextlib import contextmanager

COLUMNS = "file_id bigint, path string, lang string, pre int, parent int, last int, type string, field string, is_named boolean, start_byte int, end_byte int, start_row int, end_row int, text string, anc array<int>, anc_types array<string>"


class Tree:
    """Nodes are opened and closed like brackets; each gets its ancestors and, once closed, its last descendant."""

    def __init__(self, source: bytes):
        self.source = source
        self.rows: list[dict] = []
        self.open: list[dict] = []
        self.lines = [0] + [i + 1 for i, b in enumerate(source) if b == 10]

    def row_of(self, byte: int) -> int:
        from bisect import bisect_right

        return bisect_right(self.lines, byte) - 1

    @contextmanager
    def node(self, kind: str, start: int, end: int, field: str | None = None, text: bool = False, named: bool = True):
        row = {
            "pre": len(self.rows),
            "parent": self.open[-1]["pre"] if self.open else None,
            "type": kind,
            "field": field,
            "is_named": named,
            "start_byte": start,
            "end_byte": end,
            "start_row": self.row_of(start),
            "end_row": self.row_of(max(start, end - 1)) if end > start else self.row_of(start),
            "text": self.source[start:end].decode("utf-8", "replace") if text else None,
            "anc": [r["pre"] for r in self.open],
            "anc_types": [r["type"] for r in self.open],
        }
        self.rows.append(row)
        self.open.append(row)
        yield row
        self.open.pop()
        row["last"] = len(self.rows) - 1

    def leaf(self, kind: str, start: int, end: int, field: str | None = None, named: bool = True) -> None:
        with self.node(kind, start, end, field, True, named):
            pass
