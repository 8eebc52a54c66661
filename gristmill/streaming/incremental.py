"""Incremental analysis: of a stream of files only contents that are new are parsed; what a changed or deleted file gave is
taken back.

Beside the table of nodes, which has each content's nodes once, there is a log of signed rows (file and content), so that the
files as they are now are those whose signs sum to one. Both grow with what changes; no batch reads what earlier ones wrote:
which contents a file has had is in the file's own state, a hash each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gristmill.sources.nodes import nodes
from gristmill.sources.tables import cut

_CHANGES = "file_id bigint, path string, lang string, source string, content string, sign int, new boolean"
_STATE = "version bigint, file_id bigint, lang string, content string, known array<string>"


def content_hash(files: DataFrame) -> DataFrame:
    return files.withColumn("content", F.sha2(F.concat_ws("\0", "path", "lang", "source"), 256))


def new_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """The files whose path and content the table of known ones doesn't have."""
    return content_hash(files).join(known.select("content").distinct(), "content", "left_anti")


def file_changes(files: DataFrame) -> DataFrame:
    """Signed rows of a stream files(file_id, path, lang, source[, version]): -1 for what a file was, +1 for what it is.

    A path's greatest version counts; without that column a file_id is one. A null source deletes the file. `new` marks
    contents that the path never had, which alone are to be parsed; the source is null elsewhere. The same content again
    under a greater version changes nothing.
    """
    version = F.col("version" if "version" in files.columns else "file_id").cast("long").alias("version")
    rows = content_hash(files).select("file_id", "path", "lang", "source", F.when(F.col("source").isNotNull(), F.col("content")).alias("content"), version)

    def follow(group: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        last, file_id, lang, content, known = held.get if held.exists else (None, None, None, None, [])
        newest = None
        for part in parts:
            for row in part.itertuples(index=False):
                if (last is None or row.version > last) and (newest is None or (row.version, row.content or "") > (newest.version, newest.content or "")):
                    newest = row
        if newest is None:
            return
        now, known = newest.content, list(known)
        out = []
        if now != content:
            if content is not None:
                out.append((file_id, group[0], lang, None, content, -1, False))
            if now is not None:
                new = now not in known
                out.append((newest.file_id, group[0], newest.lang, newest.source if new else None, now, 1, new))
                known += [now] * new
        held.update((int(newest.version), int(newest.file_id), newest.lang, now, known))
        if out:
            yield pd.DataFrame(out, columns=[x.split()[0] for x in _CHANGES.split(", ")])

    return rows.groupBy("path").applyInPandasWithState(follow, _CHANGES, _STATE, "append", GroupStateTimeout.NoTimeout)


def node_stream(files: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes the nodes of new contents to a Parquet table, and the log of files beside it, in `out`-log; stops when all there
    is has been read. A batch that is run again replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        found = cut(batch)
        found.select("file_id", "path", "lang", "content", "sign").write.mode("overwrite").parquet(f"{out}-log/batch={number}")
        parsed = nodes(found.where("new")).join(found.where("new").select("file_id", "path", "content"), ["file_id", "path"])
        parsed.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return file_changes(files).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_files(spark: SparkSession, out: str) -> DataFrame:
    """(path, lang, content) of the files as they are now."""
    return spark.read.parquet(f"{out}-log").groupBy("path", "lang", "content").agg(F.sum("sign").alias("n")).where("n > 0").drop("n")


def current_nodes(spark: SparkSession, out: str) -> DataFrame:
    """The nodes of the files as they are now: those of changed and deleted files are left out."""
    return spark.read.parquet(out).drop("batch").join(current_files(spark, out).select("path", "content"), ["path", "content"], "left_semi")
