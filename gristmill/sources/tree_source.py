"""A folder of sources as a Spark data source, `source_tree`, listed and read by tasks, in batches and as a stream.

    spark.dataSource.register(SourceTree)
    spark.read.format("source_tree").load("/src")            # path, lang, n_bytes, modified, source
    spark.readStream.format("source_tree").load("/src")      # what has been changed since the last batch

The driver enters folders level by level, but only until there are enough of them for the tasks, and keeps no file's name:
a folder that it has entered is read again by a task, without what lies below it; the others with all that lies below. A
folder of very many files is dealt to several tasks by a hash of the name. Tasks hold one folder's open listing at a time.
"""

from __future__ import annotations

import os
import time
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from gristmill.sources.discovery import IGNORED_FOLDERS, SUFFIXES

SCHEMA = "path string, lang string, n_bytes bigint, modified timestamp, source string"
#: Files of one entered folder that a task reads; more are dealt to several.
FILES_A_TASK = 10_000


@dataclass
class Part(InputPartition):
    """A folder, with what is below it or not, or the share of its files whose name's hash is `share` modulo `of`."""

    folder: str
    deep: bool
    share: int = 0
    of: int = 1
    after: int = -1
    until: int | None = None


def _enter(root: str, folder: str, prefixes: tuple[str, ...]) -> tuple[list[str], int]:
    """Folders in a folder that are to be entered, as paths below the root, and how many files there are."""
    found, files = [], 0
    with os.scandir(os.path.join(root, folder)) as entries:
        for e in entries:
            if not e.is_dir(follow_symlinks=False):
                files += 1
            elif not e.name.startswith((".", *prefixes)) and e.name not in IGNORED_FOLDERS:
                found.append(f"{folder}/{e.name}".lstrip("/"))
    return found, files


def _language(name: str) -> str | None:
    stem, dot, suffix = name.rpartition(".")
    return SUFFIXES.get("." + suffix.lower()) if stem and dot else None


class _Tree:
    def __init__(self, options: dict):
        self.root = options["path"].removeprefix("file://")
        self.prefixes = tuple(x for x in options.get("prefixes", "").split(",") if x)
        self.parts = int(options.get("folders", 64))
        self.content = options.get("content", "true") == "true"

    def planned(self, after: int = -1, until: int | None = None) -> list[Part]:
        entered, todo = [], [""]
        while todo and len(todo) < self.parts:
            inner = []
            for folder in todo:
                below, files = _enter(self.root, folder, self.prefixes)
                inner += below
                entered += [Part(folder, False, k, n, after, until) for n in [-(-files // FILES_A_TASK)] for k in range(n)]
            todo = inner
        return entered + [Part(folder, True, 0, 1, after, until) for folder in todo]

    def latest(self, until: int) -> int:
        """The time of the latest change to a source file, up to `until`; -1 if there is none."""
        found, todo = -1, [""]
        while todo:
            folder = todo.pop()
            todo += _enter(self.root, folder, self.prefixes)[0]
            with os.scandir(os.path.join(self.root, folder)) as entries:
                found = max(found, max((t for e in entries if _language(e.name) and e.is_file() and (t := e.stat().st_mtime_ns) <= until), default=-1))
        return found

    def rows(self, part: Part) -> Iterator[tuple]:
        todo = [part.folder]
        while todo:
            folder = todo.pop()
            if part.deep:
                todo += _enter(self.root, folder, self.prefixes)[0]
            with os.scandir(os.path.join(self.root, folder)) as entries:
                for e in entries:
                    lang = _language(e.name)
                    if lang is None or part.of > 1 and zlib.crc32(os.fsencode(e.name)) % part.of != part.share or not e.is_file():
                        continue
                    at = e.stat()
                    if at.st_mtime_ns <= part.after or part.until is not None and at.st_mtime_ns > part.until:
                        continue
                    text = None
                    if self.content:
                        with open(e.path, "rb") as f:
                            text = f.read().decode("utf-8", "replace")
                    yield f"{folder}/{e.name}".lstrip("/"), lang, at.st_size, datetime.fromtimestamp(at.st_mtime_ns // 1000 / 1e6, timezone.utc).replace(tzinfo=None), text


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.tree = _Tree(options)

    def partitions(self) -> list[Part]:
        return self.tree.planned() or [Part("", False)]

    def read(self, partition: Part) -> Iterator[tuple]:
        return self.tree.rows(partition)


class _StreamReader(DataSourceStreamReader):
    """A batch has the files changed after the last batch's time and no later than `settle` seconds ago, so that a file
    that is just being written, or one more of the same moment, isn't passed over. Deleted files don't show.

    An offset is the latest change that there is, so that a tree without changes gives no batch: the driver looks at each
    file's time for it, one folder's listing after the other, and keeps none of them."""

    def __init__(self, options: dict):
        self.tree, self.settle = _Tree(options), float(options.get("settle", 1))

    def initialOffset(self) -> dict:
        return {"until": -1}

    def latestOffset(self) -> dict:
        return {"until": self.tree.latest(time.time_ns() - int(self.settle * 1e9))}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return self.tree.planned(start["until"], end["until"])

    def read(self, partition: Part) -> Iterator[tuple]:
        return self.tree.rows(partition)


class SourceTree(DataSource):
    """Options: path; prefixes of further folders to be passed over, with commas; folders, how many the driver looks for;
    content, false for names alone; settle, for streams. Links to folders are not followed; hidden folders not entered."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(self.options)
