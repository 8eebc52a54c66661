"""From documents to packed training sequences: STAGES in order, each over all that the one before has kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import decontaminate, near_dedup, packing, quality, secrets
from gristmill.llm.common import small, stored, table

#: Up to so many keys of rows to be dropped are broadcast (8 bytes each); beyond, the texts are shuffled.
DROPPED_AT_ONCE = 1_000_000


def _key() -> Column:
    """Tells rows apart by id and text; what has the same of both shares its fate."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of docs whose key is not in dropped (key)."""
    dropped = small(stored(dropped.select(F.col("key").alias("dropped")).distinct(), "dropped"), DROPPED_AT_ONCE)
    return docs.join(dropped, _key() == dropped["dropped"], "left_anti")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier rejects go; so do rows without words."""
    return _without(docs, quality.classify(docs, table(spark, sf_dir, "labels")).where("not kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest id; of rows with one id, the one with the
    smallest text, and of equal texts that with the smallest hash of all columns. Rows with a null id stay."""
    found = stored(near_dedup.near_duplicates(docs).select("doc_id", "kept"), "groups")
    gone = small(stored(found.where("not kept").select("doc_id").distinct(), "gone"), DROPPED_AT_ONCE)
    docs = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    twice = stored(found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "twice")
    if twice.isEmpty():
        return docs
    rows = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    first = F.min_by(rows, F.struct(F.coalesce("text", F.lit("")), F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))))
    one = docs.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(first.alias("row")).select("row.*")
    return docs.join(twice, "doc_id", "left_anti").select(docs.columns).unionByName(one.select(docs.columns))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a window of ten words of a benchmark item go."""
    keyed = docs.select(_key().alias("doc_id"), "text")
    hits = decontaminate.matches(decontaminate.index(keyed), table(spark, sf_dir, "benchmark"))
    return _without(docs, hits.select(F.col("doc_id").alias("key")))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts give way to a mark; n_chars follows. No row goes."""
    return secrets.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each piece of each text with its place in a training sequence."""
    return packing.best_fit(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]

#: SQL can't express the language model's hashes, the guess costs or the packing: tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over all documents; each stage's result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
