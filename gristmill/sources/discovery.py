"""Source files: listing folders, and the rules of what is a source file as column expressions over a table of paths."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyarrow.fs import FileSelector, FileSystem, FileType, LocalFileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffix -> language, and folders that are never entered.
SUFFIXES = {".py": "python", ".php": "php", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".ts": "typescript", ".tsx": "typescript", ".go": "go"}
IGNORED_FOLDERS = ("__pycache__", "node_modules", ".venv", "venv", "env")
TEST_FOLDERS = ("test", "tests", "__tests__")


def language(path: Column) -> Column:
    """By the lower-cased suffix; null if it is no language's."""
    suffix = F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))
    return F.create_map(*(F.lit(x) for kv in SUFFIXES.items() for x in kv))[suffix]


def in_ignored_folder(path: Column, prefixes: tuple[str, ...] = ()) -> Column:
    """Whether a folder of the path is hidden, always ignored or starts with a prefix; the file's name never counts."""
    folders = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    starts = lambda d: d.rlike("^(" + "|".join(map(re.escape, (".", *prefixes))) + ")")
    return F.exists(folders, lambda d: starts(d) | d.isin(*IGNORED_FOLDERS))


def _glob(pattern: str) -> str:
    """A shell pattern as a regex for Java and Python alike; * crosses slashes."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (end := pattern.find("]", i + (pattern[i : i + 1] in ("!", "]")) + (pattern[i : i + 2] == "!]"))) > 0:
            inner = pattern[i:end].replace("\\", "\\\\").replace("[", "\\[")
            out += "[" + ("^" + inner[1:] if inner.startswith("!") else inner) + "]"
            i = end + 1
        else:
            out += re.escape(c)
    return f"(?s)^{out}$"


def ignore_patterns(text: str) -> list[str]:
    """The lines of an ignore file without blank ones and comments."""
    return [x for x in map(str.strip, text.splitlines()) if x and not x.startswith("#")]


def matches_ignore(path: Column, patterns: list[str]) -> Column:
    """A pattern names a file or folder literally; with ** it is matched with the whole path, ** being *; without a slash
    with the name and each folder; else with the whole path."""
    parts = F.split(path, "/")
    found = F.lit(False)
    for raw in patterns:
        p = raw.rstrip("/")
        found |= (path == p) | path.startswith(p + "/")
        if "**" in p:
            found |= path.rlike(_glob(p.replace("**", "*")))
        elif "/" not in p:
            found |= F.exists(parts, _rlike(_glob(p)))
        else:
            found |= path.rlike(_glob(p))
    return found


def _rlike(pattern: str):
    return lambda x: x.rlike(pattern)


def source_paths(paths: DataFrame, column: str = "path", prefixes: tuple[str, ...] = (), patterns: list[str] | None = None, lang: str | None = None) -> DataFrame:
    """The rows whose relative path is a source file's, with its lang."""
    path = F.col(column)
    kept = paths.where(~in_ignored_folder(path, prefixes) & ~matches_ignore(path, patterns or [])).withColumn("lang", language(path)).where("lang is not null")
    return kept if lang is None else kept.where(F.col("lang") == lang)


def is_test_file(path: Column) -> Column:
    """By the file's name, as each language's test runners find their files."""
    name = F.substring_index(path, "/", -1)
    lang = language(path)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    script = name.contains(".test.") | name.contains(".spec.") | name.startswith("test_") | stem.endswith("_test")
    return (
        F.when(lang == "python", name.startswith("test_") | stem.endswith("_test") | (name == "conftest.py"))
        .when(lang == "php", name.endswith("Test.php") | name.startswith("Test"))
        .when(lang.isin("javascript", "typescript"), script)
        .when(lang == "go", name.endswith("_test.go"))
        .otherwise(False)
    )


def in_test_folder(path: Column) -> Column:
    """Whether a part of the path, relative to the root, is a test folder's name."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, TEST_FOLDERS)))


#: The driver lists folders level by level until so many wait; then tasks list all that is below them.
FOLDERS = 256


class Store:
    """A folder in any store pyarrow knows: a local path or a URI that driver and tasks both reach."""

    def __init__(self, root: str | Path):
        root = str(root)
        self.fs, base = FileSystem.from_uri(root if "://" in root else Path(root).resolve().as_uri())
        self.base, self.local = base.rstrip("/"), isinstance(self.fs, LocalFileSystem)

    def entries(self, folder: str, prefixes: tuple[str, ...]) -> tuple[list[str], list[str]]:
        """(files, folders to be entered) in a folder, as paths below the root. Links to folders are files and not followed."""
        files, folders = [], []
        for found in self.fs.get_file_info(FileSelector(f"{self.base}/{folder}".rstrip("/") or "/")):
            path = f"{folder}/{found.base_name}".lstrip("/")
            if found.type != FileType.Directory:
                files.append(path)
            elif not found.base_name.startswith((".", *prefixes)) and found.base_name not in IGNORED_FOLDERS and not (self.local and os.path.islink(found.path)):
                folders.append(path)
        return files, folders

    def below(self, folder: str, prefixes: tuple[str, ...]) -> Iterator[list[str]]:
        """The files of a folder and of all below it, folder by folder."""
        todo = [folder]
        while todo:
            files, inner = self.entries(todo.pop(), prefixes)
            todo += inner
            yield files

    def read(self, path: str) -> bytes:
        with self.fs.open_input_stream(f"{self.base}/{path}") as f:
            return f.read()


def listed(spark: SparkSession, store: Store, prefixes: tuple[str, ...] = (), most: int = FOLDERS) -> DataFrame:
    """(path) of the files below a folder; ignored folders are not entered, hidden files stay."""
    found, folders = [], [""]
    while folders and len(folders) <= most:
        files, inner = zip(*(store.entries(f, prefixes) for f in folders), strict=True)
        found += [x for part in files for x in part]
        folders = [x for part in inner for x in part]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for folder in batch["path"]:
                for files in store.below(folder, prefixes):
                    yield pd.DataFrame({"path": pd.Series(files, dtype=object)})

    near = spark.createDataFrame([(p,) for p in found], "path string")
    if not folders:
        return near
    return near.unionByName(spark.createDataFrame([(p,) for p in folders], "path string").repartition(len(folders), "path").mapInPandas(walk, "path string"))


def files(spark: SparkSession, root: str | Path, prefixes: tuple[str, ...] = (), lang: str | None = None, ignore_file: str = ".gristmillignore") -> DataFrame:
    """files(file_id, path, lang, source, n_bytes) of a folder: a local path that all executors see, or a URI.

    Spark's own listing passes over names with a leading underscore, so folders are listed here, and tasks read. Bytes that
    are not UTF-8 become replacement characters. file_id is a hash of the path.
    """
    store = Store(root)
    patterns = ignore_patterns(store.read(ignore_file).decode("utf-8", "replace")) if store.fs.get_file_info(f"{store.base}/{ignore_file}").type == FileType.File else []
    rows = listed(spark, store, prefixes).withColumn("file_id", F.xxhash64("path"))
    kept = source_paths(rows, "path", prefixes, patterns, lang).select("file_id", "path", "lang").repartition("file_id")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 64):
                part = batch[i : i + 64]
                raw = [store.read(p) for p in part["path"]]
                yield pd.DataFrame({"file_id": part["file_id"], "path": part["path"], "lang": part["lang"], "source": [x.decode("utf-8", "replace") for x in raw], "n_bytes": [len(x) for x in raw]})

    return kept.mapInPandas(read, "file_id bigint, path string, lang string, source string, n_bytes bigint")
