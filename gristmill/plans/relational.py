"""Statistics, thresholds, graphs, imports, coverage, snapshots and path rules over the star schema.

The star schema stands in for metrics of code: documents are files with metrics, trade between nations is a graph,
supplier names are dotted modules, parts are definitions that orders name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators import coverage, graph, snapshot, stats, thresholds
from gristmill.sources import discovery
from gristmill.sources.config import threshold_table
from gristmill.sources.tables import cut, table

MEASURES = ("l_quantity", "l_extendedprice", "l_linenumber")


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", *(F.floor(m).cast("bigint").alias(m) for m in MEASURES))
    return stats.unpivot(items, ["l_orderkey"], list(MEASURES))


def stats_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.percentiles(_values(spark, sf_dir))


def stats_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", F.lit("n_chars").alias("metric"), F.col("n_chars").alias("value"))
    return stats.percentiles(docs, ("lang", "metric"))


def stats_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest values of each metric: the report's feature."""
    items = stats.unpivot(table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), *(F.floor(m).cast("bigint").alias(m) for m in MEASURES)), ["id"], list(MEASURES))
    return stats.top(items, 10, "id").select("metric", "id", "value", F.col("rank").cast("bigint").alias("rank"))


def mimic_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.mimic(_values(spark, sf_dir))


_LANGS = {"en": "python", "fr": "php", "de": "javascript", "es": "go"}


def _as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    lang = F.create_map(*(F.lit(x) for kv in _LANGS.items() for x in kv))[F.col("lang")]
    count = lambda pattern: F.regexp_count("text", F.lit(pattern)).cast("bigint")
    file = F.concat("source", F.lit("/"), F.when(F.col("doc_id") % 7 == 0, "__init__.py").otherwise(F.concat(F.lit("d"), F.col("doc_id").cast("string"))))
    return table(spark, sf_dir, "documents").select(
        lang.alias("lang"), file.alias("file"), F.col("doc_id").alias("line"), F.col("doc_id").cast("string").alias("name"), (F.col("doc_id") % 2 == 0).alias("inside_class"),
        count("\\.").alias("statements"), count("[0-9]").alias("interface_types"), count("\n").alias("concrete_types"), count(",").alias("imports"), count("[A-Z]").alias("functions"),
        count("on").alias("arguments_positional"), count("en").alias("branches"), count("er").alias("calls"), count("th").alias("max_indentation"), count("it").alias("max_return_values"),
    )


def violations_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = thresholds.file_violations(_as_files(spark, sf_dir), threshold_table(spark))
    return found.select("file", "line", "unit_name", "metric", "value", "threshold")


def violations_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _as_files(spark, sf_dir)
    none = [F.lit(0).cast("bigint").alias(m) for m in thresholds.FUNCTION_CHECKS if m not in rows.columns]
    return thresholds.function_violations(rows.select("*", *none), threshold_table(spark)).select("line", "unit_name", "metric", "value", "threshold")


def violations_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return thresholds.focus(violations_file(spark, sf_dir), "src3/")


def _trade(spark: SparkSession, sf_dir: str, acyclic: bool = False, factor: float = 1.35) -> tuple[DataFrame, DataFrame]:
    """Nations as modules; an edge from a customer's nation to a supplier's where their line items are many for a pair."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("module"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("a"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("b"))
    # sums by order's customer and supplier come before the joins with their nations
    sold = lines.join(orders, "l_orderkey").groupBy("o_custkey", "l_suppkey").agg(F.count("*").alias("n"))
    pairs = cut(sold.join(customers, "o_custkey").join(suppliers, "l_suppkey").where("a <> b").groupBy("a", "b").agg(F.sum("n").alias("n")))
    limit = pairs.agg(F.avg("n") * factor).first()[0] or 0.0
    pairs = pairs.where(F.col("n") > limit)
    if acyclic:
        pairs = pairs.where("a < b")
    x, y = nation.select(F.col("k").alias("a"), F.col("module").alias("src")), nation.select(F.col("k").alias("b"), F.col("module").alias("dst"))
    return nation.select("module"), cut(pairs.join(x, "a").join(y, "b").select("src", "dst"))


def graph_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(*_trade(spark, sf_dir))


def graph_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reach(_trade(spark, sf_dir)[1]).select("src", "dst", F.col("level").cast("bigint").alias("level"))


def graph_indirect(spark: SparkSession, sf_dir: str) -> DataFrame:
    modules, edges = _trade(spark, sf_dir)
    return graph.indirect_dependencies(modules, edges)


def graph_scc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cycles(_trade(spark, sf_dir)[1])


def graph_longest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(graph.longest_path(_trade(spark, sf_dir, True)[1]),)], "longest bigint")


def graph_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    modules, edges = _trade(spark, sf_dir)
    found = thresholds.graph_violations(modules, edges, {"cycle_size": 1, "indirect_dependencies": 2, "dependency_depth": 1})
    return found.select("unit_name", "metric", "value", "threshold")


def graph_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.orphans(*_trade(spark, sf_dir, factor=3.0))


def _named(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Modules region.nation.supplier and nation.supplier; an edge to the supplier with the next key."""
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    nation = table(spark, sf_dir, "nation").join(region, "n_regionkey").select(F.col("n_nationkey").alias("s_nationkey"), "n_name", "r_name")
    names = table(spark, sf_dir, "supplier").join(nation, "s_nationkey")
    dotted = F.when(F.col("s_suppkey") % 3 == 0, F.concat_ws(".", "n_name", "s_name")).otherwise(F.concat_ws(".", "r_name", "n_name", "s_name"))
    names = cut(names.select("s_suppkey", F.replace(F.lower(dotted), F.lit(" "), F.lit("_")).alias("module")))
    after = names.select((F.col("s_suppkey") - 1).alias("s_suppkey"), F.col("module").alias("dst"))
    return names.select("module"), names.join(after, "s_suppkey").select(F.col("module").alias("src"), "dst")


def graph_coarsen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.coarsen(*_named(spark, sf_dir), 0.5)[1]


def module_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", F.split("p_type", " ")[0], F.col("p_brand"), F.when(F.col("p_partkey") % 5 == 0, "__init__.py").otherwise(F.concat(F.col("p_partkey").cast("string"), F.lit(".py"))))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), graph.module_name(path).alias("module"))


def import_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's module imports its neighbour by a name cut in one of five ways."""
    modules, edges = _named(spark, sf_dir)
    last = F.substring_index("dst", ".", -1)
    way = F.pmod(F.length("src") + F.length("dst"), F.lit(5))
    name = F.when(way == 0, F.col("dst")).when(way == 1, last).when(way == 2, F.concat(F.lit("."), last)).when(way == 3, F.concat(F.lit(".."), F.substring_index("dst", ".", -2))).otherwise(F.substring_index("dst", ".", -2))
    return graph.resolve_imports(edges.select("src", name.alias("name")), modules)


def _tests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts of a size are definitions, a third of them methods of a class that is the next part in the same size; tests are all
    orders, in a file for each priority, and name the parts of their line items in the size of the quantity. So about half
    of the definitions are named."""
    parts = table(spark, sf_dir, "part")
    sized = lambda key, size: F.concat(F.lit("p"), key.cast("string"), F.lit("_"), size.cast("int").cast("string"))
    key, size = F.col("p_partkey"), F.col("p_size")
    definitions = parts.select(sized(key, size).alias("name"), F.lit("function").alias("kind"), F.concat(F.col("p_brand"), F.lit(".py")).alias("file"), size.alias("line"), F.when(key % 3 == 0, sized(key + 1, size)).alias("containing_class"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    refs = table(spark, sf_dir, "lineitem").join(orders, "l_orderkey").select(F.col("o_orderpriority").alias("test_file"), F.concat(F.lit("test_"), F.col("l_orderkey").cast("string")).alias("test_name"), sized(F.col("l_partkey"), F.col("l_quantity")).alias("ref"))
    return definitions, refs


def coverage_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.covering(*_tests(spark, sf_dir)).select("file", "name", "line", "test_file", "test_name")


def coverage_unreferenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.unreferenced(*_tests(spark, sf_dir)).select("file", "name", "line")


def coverage_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.coverage_pct(*_tests(spark, sf_dir))


def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.show_tests(*_tests(spark, sf_dir)).select("file", "name", "n_tests", "tests")


def shrink_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the first half of the events against those of the second half."""
    events = table(spark, sf_dir, "events")
    half = (F.col("event_id") * 2 < F.lit(events.count())).alias("early")
    totals = [F.count("*").alias("files"), F.countDistinct("user_id").alias("code_units"), F.sum(F.length("props")).alias("statements"), F.countDistinct("event_type").alias("graph_nodes"), F.sum(F.when(F.col("event_type") == "click", 1).otherwise(0)).alias("graph_edges")]
    by = cut(events.select("*", half).groupBy("early").agg(*totals))
    return snapshot.check(snapshot.long(by.where("early")), snapshot.long(by.where("not early")), "code_units", 100)


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and suppliers' names as paths of many shapes."""
    k = F.col("p_partkey")
    folder = F.element_at(F.array(*map(F.lit, ("src", "tests", "node_modules/x", ".git", "__tests__/a", "vendor/lib", "docs.d", "env"))), (k % 8 + 1).cast("int"))
    stem = F.element_at(F.array(*map(F.lit, ("test_a", "a_test", "conftest", "aTest", "Testa", "a.test", "a.spec", "main", "__init__", "a"))), (F.floor(k / 8) % 10 + 1).cast("int"))
    suffix = F.element_at(F.array(*map(F.lit, (".py", ".PHP", ".js", ".jsx", ".mjs", ".ts", ".tsx", ".go", ".txt", ""))), (F.floor(k / 80) % 10 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(k.alias("id"), F.concat(folder, F.lit("/"), stem, suffix).alias("path"))


def discovery_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.source_paths(_paths(spark, sf_dir), prefixes=("docs",), patterns=["vendor/", "**/aTest*", "*.spec.ts"])


def test_file_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return _paths(spark, sf_dir).select("id", discovery.is_test_file(path).alias("by_name"), discovery.in_test_folder(path).alias("by_folder"))


QUERIES = {f.__name__: f for f in (stats_percentiles, stats_by_language, stats_topn, mimic_thresholds, violations_file, violations_function, violations_focus, graph_degree, graph_reach, graph_indirect, graph_scc, graph_longest_path, graph_violations, graph_orphans, graph_coarsen, module_names, import_resolve, coverage_map, coverage_unreferenced, coverage_pct, coverage_report, shrink_check, discovery_filter, test_file_flag)}

_VALUES = "v AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, l_orderkey * 10 + l_linenumber AS id, floor({m})::BIGINT AS value FROM lineitem" for m in MEASURES) + ")"
_RANKS = ", ".join(f"quantile_disc(value, {p / 100}) AS p{p}" for p in stats.PERCENTS)


def _limits() -> str:
    from gristmill.sources.config import load_thresholds

    return "limits(lang, metric, threshold) AS (VALUES " + ", ".join(f"('{a}', '{m}', {v}::BIGINT)" for a, x in load_thresholds([]).items() for m, v in x.items() if v is not None) + ")"


_COUNT = lambda p: f"len(regexp_extract_all(text, '{p}'))::BIGINT"
_FILES = "f AS (SELECT CASE lang " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _LANGS.items()) + f""" END AS lang, source || '/' || CASE WHEN doc_id % 7 = 0 THEN '__init__.py' ELSE 'd' || doc_id END AS file, doc_id,
  {_COUNT("[.]")} AS dots, {_COUNT("[0-9]")} AS digits, {_COUNT("[\n]")} AS lines, {_COUNT(",")} AS commas, {_COUNT("[A-Z]")} AS capitals,
  {_COUNT("on")} AS n_on, {_COUNT("en")} AS n_en, {_COUNT("er")} AS n_er, {_COUNT("th")} AS n_th, {_COUNT("it")} AS n_it FROM documents)"""
_FILE_ROWS = (
    "WITH "
    + _limits()
    + ", "
    + _FILES
    + """, long AS (SELECT lang, file, 'statements_per_file' AS metric, dots AS value FROM f UNION ALL SELECT lang, file, 'interface_types_per_file', digits FROM f UNION ALL
  SELECT lang, file, 'concrete_types_per_file', lines FROM f UNION ALL SELECT lang, file, 'functions_per_file', capitals FROM f UNION ALL
  SELECT lang, file, 'imported_names_per_file', commas FROM f WHERE file NOT LIKE '%/\\_\\_init\\_\\_.py' ESCAPE '\\')
SELECT file, 1 AS line, split_part(file, '/', 2) AS unit_name, metric, value, threshold FROM long JOIN limits USING (lang, metric) WHERE value > threshold"""
)
_TRADE = """WITH RECURSIVE sold AS (SELECT c_nationkey AS a, s_nationkey AS b, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
  JOIN supplier ON s_suppkey = l_suppkey WHERE c_nationkey <> s_nationkey GROUP BY ALL),
edges AS (SELECT x.n_name AS src, y.n_name AS dst, a, b FROM sold JOIN nation x ON x.n_nationkey = a JOIN nation y ON y.n_nationkey = b WHERE n > (SELECT avg(n) * 1.35 FROM sold)),
walk(src, dst, level) AS (SELECT src, dst, 1 FROM edges UNION SELECT w.src, e.dst, w.level + 1 FROM walk w JOIN edges e ON e.src = w.dst WHERE w.level < 25),
reach AS (SELECT src, dst, min(level)::BIGINT AS level FROM walk WHERE src <> dst GROUP BY ALL),
far AS (SELECT n_name AS module, (SELECT count(*) FROM reach WHERE src = n_name) AS reach, (SELECT count(*) FROM edges WHERE src = n_name) AS fan_out, (SELECT count(*) FROM edges WHERE dst = n_name) AS fan_in,
  (SELECT coalesce(max(level), 0) FROM reach WHERE src = n_name) AS eccentricity FROM nation),
rings AS (SELECT r.src AS module, least(r.src, min(r.dst)) AS component, count(*) + 1 AS size FROM reach r JOIN reach s ON s.src = r.dst AND s.dst = r.src GROUP BY r.src)"""
_NAMED = """WITH named AS (SELECT s_suppkey, replace(lower(CASE WHEN s_suppkey % 3 = 0 THEN n_name || '.' || s_name ELSE r_name || '.' || n_name || '.' || s_name END), ' ', '_') AS module
  FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey),
edges AS (SELECT a.module AS src, b.module AS dst FROM named a JOIN named b ON b.s_suppkey = a.s_suppkey + 1)"""
_IMPORTS = (
    _NAMED
    + """, imports AS (SELECT DISTINCT src, CASE (len(src) + len(dst)) % 5 WHEN 0 THEN dst WHEN 1 THEN split(dst, '.')[-1] WHEN 2 THEN '.' || split(dst, '.')[-1]
  WHEN 3 THEN '..' || array_to_string(split(dst, '.')[-2:], '.') ELSE array_to_string(split(dst, '.')[-2:], '.') END AS name FROM edges),
parts AS (SELECT src, name, split(src, '.') AS p, ltrim(name, '.') AS bare, len(name) - len(ltrim(name, '.')) AS dots FROM imports),
tried AS (SELECT src, name, 1 AS rank, array_to_string(list_concat(p[:greatest(len(p) - dots, 0)], [bare]), '.') AS t FROM parts WHERE dots > 0
  UNION ALL SELECT src, name, 2, bare FROM parts WHERE dots > 0 UNION ALL SELECT src, name, 1, name FROM parts WHERE dots = 0
  UNION ALL SELECT src, name, 1 + k, array_to_string(p[:k], '.') || '.' || name FROM parts, generate_series(1, 3) g(k) WHERE dots = 0 AND k < len(p)
  UNION ALL SELECT src, name, 99, module FROM parts JOIN (SELECT DISTINCT module FROM named) ON module LIKE '%.' || replace(name, '_', '\\_') ESCAPE '\\' WHERE dots = 0)
SELECT src, name, arg_min(t, (rank, t)) AS dst FROM tried WHERE t IN (SELECT module FROM named) GROUP BY src, name"""
)
_TESTS = """WITH d AS (SELECT 'p' || p_partkey || '_' || p_size AS name, p_brand || '.py' AS file, p_size AS line, CASE WHEN p_partkey % 3 = 0 THEN 'p' || (p_partkey + 1) || '_' || p_size END AS cls FROM part),
r AS (SELECT DISTINCT o_orderpriority AS test_file, 'test_' || l_orderkey AS test_name, 'p' || l_partkey || '_' || l_quantity::INTEGER AS ref FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
m AS (SELECT DISTINCT file, name, line, test_file, test_name FROM d JOIN r ON ref = name OR ref = cls),
u AS (SELECT file, name, line, name IN (SELECT ref FROM r) OR coalesce(cls IN (SELECT ref FROM r), false) AS covered FROM d)"""
_PATHS = """p AS (SELECT p_partkey AS id, ['src', 'tests', 'node_modules/x', '.git', '__tests__/a', 'vendor/lib', 'docs.d', 'env'][p_partkey % 8 + 1] AS folder,
  ['test_a', 'a_test', 'conftest', 'aTest', 'Testa', 'a.test', 'a.spec', 'main', '__init__', 'a'][(p_partkey // 8) % 10 + 1] AS stem,
  ['.py', '.PHP', '.js', '.jsx', '.mjs', '.ts', '.tsx', '.go', '.txt', ''][(p_partkey // 80) % 10 + 1] AS suffix FROM part),
q AS (SELECT *, folder || '/' || stem || suffix AS path, stem || suffix AS file,
  CASE WHEN suffix = '.py' THEN 'python' WHEN suffix = '.PHP' THEN 'php' WHEN suffix IN ('.js', '.jsx', '.mjs') THEN 'javascript' WHEN suffix IN ('.ts', '.tsx') THEN 'typescript' WHEN suffix = '.go' THEN 'go' END AS lang FROM p)"""
ORACLES = {
    "stats_percentiles": f"WITH {_VALUES} SELECT metric, count(*) AS n, {_RANKS}, max(value) AS max FROM v GROUP BY metric",
    "stats_by_language": f"SELECT lang, 'n_chars' AS metric, count(*) AS n, {_RANKS.replace('value', 'n_chars')}, max(n_chars) AS max FROM documents GROUP BY lang",
    "stats_topn": f"WITH {_VALUES} SELECT metric, id, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC, id) AS rank FROM v) WHERE rank <= 10",
    "mimic_thresholds": f"WITH {_VALUES} SELECT metric, greatest(quantile_disc(value, 0.95), 1) AS threshold FROM v GROUP BY metric",
    "violations_file": _FILE_ROWS,
    "violations_focus": f"SELECT * FROM ({_FILE_ROWS}) WHERE file LIKE 'src3/%'",
    "violations_function": "WITH " + _limits() + ", " + _FILES + """, long AS (SELECT lang, doc_id, 'statements_per_function' AS metric, 'statements_per_function' AS l, dots AS value FROM f UNION ALL
  SELECT lang, doc_id, 'positional_args', 'arguments_positional', n_on FROM f WHERE doc_id % 2 <> 0 UNION ALL SELECT lang, doc_id, 'branches_per_function', 'branches_per_function', n_en FROM f UNION ALL
  SELECT lang, doc_id, 'calls_per_function', 'calls_per_function', n_er FROM f UNION ALL SELECT lang, doc_id, 'max_indentation_depth', 'max_indentation_depth', n_th FROM f UNION ALL
  SELECT lang, doc_id, 'return_values_per_function', 'return_values_per_function', n_it FROM f)
SELECT doc_id AS line, doc_id::VARCHAR AS unit_name, long.metric, value, threshold FROM long JOIN limits ON limits.lang = long.lang AND limits.metric = l WHERE value > threshold""",
    "graph_degree": _TRADE + " SELECT module, fan_in, fan_out FROM far",
    "graph_reach": _TRADE + " SELECT src, dst, level FROM reach",
    "graph_indirect": _TRADE + " SELECT module, reach, reach - fan_out AS indirect, eccentricity FROM far",
    "graph_scc": _TRADE + " SELECT module, component, size FROM rings",
    "graph_longest_path": _TRADE + ", up AS (SELECT src, dst FROM edges WHERE a < b), path(dst, n) AS (SELECT dst, 1 FROM up UNION SELECT up.dst, n + 1 FROM path JOIN up ON up.src = path.dst) SELECT coalesce(max(n), 0)::BIGINT AS longest FROM path",
    "graph_violations": _TRADE + """ SELECT string_agg(module, ' -> ' ORDER BY module) AS unit_name, 'cycle_size' AS metric, size AS value, 1::BIGINT AS threshold FROM rings GROUP BY component, size
UNION ALL SELECT module, 'indirect_dependencies', reach - fan_out, 2 FROM far WHERE reach - fan_out > 2
UNION ALL SELECT 'graph', 'dependency_depth', max(level), 1 FROM walk WHERE NOT EXISTS (SELECT 1 FROM rings) HAVING max(level) > 1""",
    "graph_orphans": _TRADE.replace("1.35", "3.0") + " SELECT module FROM far WHERE fan_in + fan_out = 0",
    "graph_coarsen": _NAMED + " SELECT DISTINCT array_to_string(split(src, '.')[:2], '.') AS src, array_to_string(split(dst, '.')[:2], '.') AS dst FROM edges WHERE array_to_string(split(src, '.')[:2], '.') <> array_to_string(split(dst, '.')[:2], '.')",
    "module_names": "SELECT p_partkey AS id, replace(split_part(p_type, ' ', 1) || '/' || p_brand || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '/' || p_partkey END, '/', '.') AS module FROM part",
    "import_resolve": _IMPORTS,
    "coverage_map": _TESTS + " SELECT file, name, line, test_file, test_name FROM m",
    "coverage_unreferenced": _TESTS + " SELECT file, name, line FROM u WHERE NOT covered",
    "coverage_pct": _TESTS + " SELECT count(*) AS total, count(*) FILTER (WHERE covered) AS covered, floor(count(*) FILTER (WHERE covered) * 100 / count(*))::BIGINT AS pct FROM u",
    "coverage_report": _TESTS + """, g AS (SELECT file, name, list(test_file || '::' || test_name ORDER BY test_file || '::' || test_name) AS t FROM m GROUP BY ALL)
SELECT d.file, d.name, coalesce(len(t), 0)::BIGINT AS n_tests, CASE WHEN t IS NULL THEN 'UNTESTED' WHEN len(t) > 3 THEN array_to_string(t[:3], ', ') || ' +' || (len(t) - 3) || ' more' ELSE array_to_string(t, ', ') END AS tests FROM d LEFT JOIN g USING (file, name)""",
    "shrink_check": """WITH h AS (SELECT event_id * 2 < (SELECT count(*) FROM events) AS early, count(*) AS files, count(DISTINCT user_id) AS code_units, sum(len(props))::BIGINT AS statements, count(DISTINCT event_type) AS graph_nodes,
  count(*) FILTER (WHERE event_type = 'click') AS graph_edges FROM events GROUP BY ALL), l AS (UNPIVOT h ON files, code_units, statements, graph_nodes, graph_edges INTO NAME metric VALUE value)
SELECT metric, CASE WHEN metric = 'code_units' THEN 100 ELSE b.value END::BIGINT AS "limit", c.value, metric = 'code_units' AS is_target FROM (SELECT * FROM l WHERE early) b JOIN (SELECT * FROM l WHERE NOT early) c USING (metric) WHERE c.value > CASE WHEN metric = 'code_units' THEN 100 ELSE b.value END""",
    "discovery_filter": "WITH " + _PATHS + " SELECT id, path, lang FROM q WHERE folder NOT IN ('node_modules/x', '.git', 'vendor/lib', 'docs.d', 'env') AND lang IS NOT NULL AND stem <> 'aTest' AND file <> 'a.spec.ts'",
    "test_file_flag": "WITH " + _PATHS + """ SELECT id, CASE WHEN lang IS NULL THEN false WHEN lang = 'python' THEN stem LIKE 'test\\_%' ESCAPE '\\' OR stem LIKE '%\\_test' ESCAPE '\\' OR stem = 'conftest' WHEN lang = 'php' THEN stem LIKE 'Test%'
  WHEN lang = 'go' THEN stem LIKE '%\\_test' ESCAPE '\\' ELSE stem IN ('a.test', 'a.spec', 'test_a', 'a_test') END AS by_name, folder IN ('tests', '__tests__/a') AS by_folder FROM q""",
}
