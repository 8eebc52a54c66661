"""Interval and as-of joins, islands, global ranks, grouping sets, sketches, multiset differences and JSON over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators.lattice import lattice, merged, shredded, sketches, snapshot_diff
from gristmill.operators.ordered import asof_join as joined_as_of
from gristmill.operators.ordered import covered
from gristmill.operators.ordered import global_rank as ranked
from gristmill.operators.ordered import interval_join as joined_by_interval
from gristmill.operators.ordered import islands
from gristmill.sources.tables import cut, table

GAP = "3 hours"


def _islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    found = islands(events, ["user_id"], "ts", ["event_id"], GAP)
    return found.groupBy("user_id", F.col("island").alias("start")).agg(F.max("ts").alias("end"), F.count("*").alias("n"))


def event_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a user's events with no more than three hours between them."""
    return _islands(spark, sf_dir)


def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each error, how many other users' islands of events it lies in."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    errors = table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", micros("ts").alias("at"), F.col("user_id").cast("long").alias("own"))
    runs = _islands(spark, sf_dir).select(F.col("user_id").cast("long").alias("other"), micros("start").alias("r_from"), micros("end").alias("r_to"))
    found = covered(errors, cut(runs), 3_600_000_000)
    return found.groupBy("event_id").agg(F.sum("n").alias("n"), F.min("first").alias("first_user"))


def interval_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one customer's orders that are under way at the same time: from the order to its last shipment."""
    shipped = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("last"))
    day = lambda c: F.unix_date(F.col(c).cast("date")).cast("long")
    spans = table(spark, sf_dir, "orders").join(shipped, "o_orderkey").select("o_custkey", "o_orderkey", day("o_orderdate").alias("a"), day("last").alias("b"))
    spans = cut(spans)
    left = spans.select("o_custkey", F.col("o_orderkey").alias("l_order"), F.col("a").alias("l_from"), F.col("b").alias("l_to"))
    right = spans.select("o_custkey", F.col("o_orderkey").alias("r_order"), F.col("a").alias("r_from"), F.col("b").alias("r_to"))
    found = joined_by_interval(left, right, ["o_custkey"], 30).where("l_order < r_order")
    return found.select("o_custkey", "l_order", "r_order", (F.least("l_to", "r_to") - F.greatest("l_from", "r_from") + 1).alias("days"))


def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each error, the user's last view before it."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    errors = events.where("event_type = 'error'").select("event_id", "user_id", "ts")
    views = events.where("event_type = 'view'").select("user_id", F.col("ts").alias("seen"), F.col("event_id").alias("view_id"), "value")
    found = joined_as_of(errors, views, ["user_id"], "ts", "seen", ["view_id"])
    return found.select("event_id", F.col("match.view_id").alias("view_id"), F.col("match.value").alias("value"))


def global_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every line item by its price."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return ranked(lines, [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")]).select("l_orderkey", "l_linenumber", "rank")


def cube_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities, prices and numbers of suppliers by all combinations of flag, status and priority."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", "l_linestatus", F.col("l_quantity").cast("decimal(18,2)").alias("quantity"), F.col("l_extendedprice").cast("decimal(18,2)").alias("price"))
    found = lattice(lines.join(orders, "l_orderkey"), ["l_returnflag", "l_linestatus", "o_orderpriority"], ["quantity", "price"], "l_suppkey")
    return found.select("l_returnflag", "l_linestatus", "o_orderpriority", "grouping", "n", *(F.col(c).cast("double").alias(c) for c in ("quantity", "price")), F.col("n_distinct").alias("suppliers"))


def sketch_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact numbers of parts by three groupings, and whether sketches stored by flag, status and month give them within bounds."""
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", F.date_format("l_shipdate", "yyyy-MM").alias("month"), "l_partkey")
    stored = cut(sketches(lines, ["l_returnflag", "l_linestatus", "month"], "l_partkey"))
    out = None
    for by in ("l_returnflag", "month", None):
        group = F.lit("all") if by is None else F.col(by)
        found = merged(stored.withColumn("value", group), ["value"])
        exact = lines.groupBy(group.alias("value")).agg(F.countDistinct("l_partkey").alias("n"))
        rows = exact.join(found, "value").select(F.lit(by or "all").alias("grouped_by"), "value", "n", F.col("n").between(F.col("low"), F.col("high")).alias("within"))
        out = rows if out is None else out.unionByName(rows)
    return out


def snapshot_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documents of even ids against those of odd ones: copies removed, added and kept."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return snapshot_diff(lines.where("doc_id % 2 = 0"), lines.where("doc_id % 2 = 1"), ["line"])


def props_shredded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' JSON in columns; every 7th text is cut off and every 11th is null, to show what becomes of them."""
    events = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 11 == 0, F.lit(None)).when(F.col("event_id") % 7 == 0, F.expr("left(props, length(props) - 1)")).otherwise(F.col("props")).alias("props"))
    found = shredded(events, "props", {"k": "bigint", "missing": "string"})
    return found.select("event_id", F.substring_index("props_kind", "<", 1).alias("kind"), "k", "missing")


QUERIES = {f.__name__: f for f in (event_islands, interval_join, interval_overlaps, asof_join, global_rank, cube_sales, sketch_distinct, snapshot_lines, props_shredded)}
_ISLANDS = f"""i AS (SELECT user_id, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM (SELECT *, sum(b::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM
  (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL '{GAP}', true) AS b FROM events)) GROUP BY user_id, k)"""
_MONTHS = "strftime(l_shipdate, '%Y-%m')"
ORACLES = {
    "event_islands": f"WITH {_ISLANDS} SELECT * FROM i",
    "interval_join": f"""WITH {_ISLANDS} SELECT event_id, count(*) AS n, min(i.user_id) AS first_user FROM events e JOIN i ON e.ts BETWEEN i.start AND i."end" AND e.user_id <> i.user_id WHERE event_type = 'error' GROUP BY event_id""",
    "interval_overlaps": """WITH s AS (SELECT o_custkey, o_orderkey, o_orderdate::DATE AS a, max(l_shipdate)::DATE AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT x.o_custkey, x.o_orderkey AS l_order, y.o_orderkey AS r_order, (least(x.b, y.b) - greatest(x.a, y.a) + 1)::BIGINT AS days FROM s x JOIN s y ON x.o_custkey = y.o_custkey AND x.o_orderkey < y.o_orderkey AND x.a <= y.b AND y.a <= x.b WHERE x.a <= x.b AND y.a <= y.b""",
    "asof_join": "SELECT e.event_id, v.event_id AS view_id, v.value FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON e.user_id = v.user_id AND e.ts >= v.ts",
    "global_rank": "SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem",
    "cube_sales": """SELECT l_returnflag, l_linestatus, o_orderpriority, grouping(l_returnflag, l_linestatus, o_orderpriority)::BIGINT AS grouping, count(*) AS n, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS quantity,
  sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS price, count(DISTINCT l_suppkey) AS suppliers FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY CUBE (l_returnflag, l_linestatus, o_orderpriority)""",
    "sketch_distinct": " UNION ALL ".join(f"SELECT '{by}' AS grouped_by, {value} AS value, count(DISTINCT l_partkey) AS n, true AS within FROM lineitem GROUP BY ALL" for by, value in (("l_returnflag", "l_returnflag"), ("month", _MONTHS), ("all", "'all'"))),
    "snapshot_lines": """WITH c AS (SELECT line, count(*) FILTER (WHERE doc_id % 2 = 0) AS o, count(*) FILTER (WHERE doc_id % 2 = 1) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY line)
SELECT line, greatest(0, o - n)::BIGINT AS removed, greatest(0, n - o)::BIGINT AS added, least(o, n)::BIGINT AS kept FROM c""",
    "props_shredded": """WITH p AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 7 = 0 THEN left(props, len(props) - 1) ELSE props END AS p FROM events)
SELECT event_id, CASE WHEN p IS NULL THEN 'null' WHEN NOT json_valid(p) THEN 'bad' ELSE json_type(p) END AS kind, CASE WHEN json_valid(p) THEN (p ->> '$.k')::BIGINT END AS k, CASE WHEN json_valid(p) THEN p ->> '$.missing' END AS missing FROM p""",
}
