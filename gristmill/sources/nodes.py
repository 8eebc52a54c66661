"""files(file_id, path, lang, source) to syntax-tree nodes, in Arrow batches; what doesn't parse goes to parse_errors."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from gristmill.sources.parsers.tree import COLUMNS

_NAMES = [c.split()[0] for c in COLUMNS.split(", ")]
_ERRORS = "file_id bigint, path string, lang string, error string"


def parse(lang: str, source: str) -> list[dict]:
    if lang == "python":
        from gristmill.sources.parsers import python

        return python.parse(source)
    from gristmill.sources.parsers import braces

    return braces.parse(lang, source)


def _tried(lang: str | None, source: str | None) -> tuple[list[dict], str | None]:
    try:
        return parse(lang, source or ""), None
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return [], f"{type(e).__name__}: {e}"


def _error(lang: str | None, source: str | None) -> str | None:
    rows, error = _tried(lang, source)
    if error is None and (broken := [r["start_row"] + 1 for r in rows if r["type"] == "ERROR"]):
        return "lines that don't parse: " + ", ".join(map(str, broken))
    return error


def nodes(files: DataFrame) -> DataFrame:
    """All nodes of the files that parse, at most some files' at a time in memory. Filter files by lang before."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held: list[dict] = []
            for r in batch.itertuples(index=False):
                held += [{"file_id": r.file_id, "path": r.path, "lang": r.lang} | row for row in _tried(r.lang, r.source)[0]]
                if len(held) > 20_000:
                    yield _frame(held)
                    held = []
            yield _frame(held)

    return files.select("file_id", "path", "lang", "source").mapInPandas(run, COLUMNS)


def _frame(rows: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_NAMES)
    out["parent"] = out["parent"].astype("Int32")
    return out


def parse_errors(files: DataFrame) -> DataFrame:
    """(file_id, path, lang, error) of the files without nodes, and of those that parse but for some lines."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(r.file_id, r.path, r.lang, e) for r in batch.itertuples(index=False) if (e := _error(r.lang, r.source))]
            yield pd.DataFrame(found, columns=["file_id", "path", "lang", "error"])

    return files.select("file_id", "path", "lang", "source").mapInPandas(run, _ERRORS)
