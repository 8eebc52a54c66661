"""The registered queries of this subpackage and their SQL equivalents for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import alignment, decontaminate, langid, licenses, media, near_dedup, oracles, packing, quality, ranked, secrets, substrings, token_counts, warc
from gristmill.llm.common import new_path, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = lambda c: F.coalesce(F.crc32(c.cast("string").cast("binary")) % 4 == 2, F.lit(False))
    found = langid.identify(docs, langid.fit(docs, ~held(F.col("doc_id"))))
    return found.select("doc_id", held(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    at = F.transform("places", lambda x: x["at"])
    base = F.array_distinct(F.transform("places", lambda x: x["label"]))
    more = F.array_distinct(F.transform("templates", lambda x: x["template"]))
    joined = lambda x: F.array_join(F.array_sort(x), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(at).cast("long").alias("first_word"),
        F.array_max(at).cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.array_union(base, more)).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("templates", lambda x: x["containment"])), F.lit(0.0))).alias("score"),
    )


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_media(media.store_as_media(table(spark, sf_dir, "documents")))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), near_dedup.Settings(shingle=2))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    records = warc.read(spark, path, payloads=False)
    number = lambda c: F.regexp_extract(F.col(c), "^urn:page:(.*)$", 1).try_cast("long")
    return records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("key")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_join(F.array_sort(F.col("item_ids").cast("array<string>")), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.size("near_ids").cast("long").alias("n_near_items"))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicate(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["kind"] != "guess")
    return found.select("doc_id", *map(count, ("assign", "access", "hex")), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.agreement(alignment.align(table(spark, sf_dir, "documents"), digest=True))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts.prefix_counts(table(spark, sf_dir, "documents"))
    most = 512
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > most).alias("over_limit"), token_counts.longest_prefix("steps", F.lit(most)).alias("n_chars_kept"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranked.search(*ranked.index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
    return found.select("item_id", "rank", "doc_id", "score")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_language_id, op2_licenses, op3_media, op4_packing, op5_near_duplicates, op6_warc, op7_quality, op8_decontamination, op9_substrings, op10_secrets, op11_token_alignment, op12_token_counts, op13_ranked_search, pipeline)}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: sql() for name, sql in oracles.ORACLES.items()}
