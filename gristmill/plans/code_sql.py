"""The queries over the small sources as SQL over their nodes, for DuckDB.

The tree is written out as rows; from there on SQL goes its own way: what is inside a node is a range of numbers, pre to
last, where the DataFrame operators join on arrays of ancestors.
"""

from __future__ import annotations

from gristmill.operators import metrics as m
from gristmill.operators import thresholds as t
from gristmill.operators.stats import PERCENTS
from gristmill.sources.config import load_thresholds
from gristmill.sources.nodes import parse

_COLUMNS = ("pre", "parent", "last", "type", "field", "is_named", "start_byte", "end_byte", "start_row", "end_row", "text")


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool | int):
        return str(value).lower()
    return "'" + str(value).replace("'", "''") + "'"


def _in(kinds: tuple[str, ...]) -> str:
    return "(" + ", ".join(map(_literal, kinds)) + ")"


def _trees(samples: list[tuple[str, str, str]]) -> str:
    rows = [(i, path, lang, *(r[c] for c in _COLUMNS)) for i, (path, lang, source) in enumerate(samples) for r in parse(lang, source)]
    values = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    files = ", ".join(f"({i}, {_literal(p)}, {_literal(lang)}, {_literal(s)})" for i, (p, lang, s) in enumerate(samples))
    return f"""WITH files(file_id, path, lang, source) AS (VALUES {files}),
n(file_id, path, lang, {", ".join(_COLUMNS)}) AS MATERIALIZED (VALUES {values}),
up AS MATERIALIZED (SELECT x.file_id, x.pre, y.pre AS a, y.type AS k FROM n x JOIN n y ON y.file_id = x.file_id AND y.pre < x.pre AND x.last <= y.last)"""


def _above(x: str, kinds: tuple[str, ...], below: str = "-1") -> str:
    """Whether a node has an ancestor of some kinds, below a node."""
    return f"EXISTS (SELECT 1 FROM up u WHERE u.file_id = {x}.file_id AND u.pre = {x}.pre AND u.a > {below} AND u.k IN {_in(kinds)})"


def _count_above(x: str, kinds: tuple[str, ...], below: str) -> str:
    return f"(SELECT count(*) FROM up u WHERE u.file_id = {x}.file_id AND u.pre = {x}.pre AND u.a > {below} AND u.k IN {_in(kinds)})"


def _child(x: str, field: str, of: str, column: str = "pre") -> str:
    return f"(SELECT {x}.{column} FROM n {x} WHERE {x}.file_id = {of}.file_id AND {x}.parent = {of}.pre AND {x}.field = '{field}')"


def _fields(pairs: dict[str, str]) -> str:
    """Whether x, whose parent is p, is in one of the fields."""
    return "(" + " OR ".join(f"p.type = '{kind}' AND x.field = '{field}'" for kind, field in pairs.items()) + ")"


_FUNCTIONS = f"""fns AS MATERIALIZED (SELECT f.file_id, f.path, f.lang, f.pre AS fn, b.pre AS body, b.last AS stop, coalesce({_child("c", "name", "f", "text")}, '<anonymous>') AS name, f.start_row + 1 AS line,
  {_above("f", m.CLASS)} AS inside_class, f.parent AS fn_parent FROM n f JOIN n b ON b.file_id = f.file_id AND b.parent = f.pre AND b.field = 'body' WHERE f.type IN {_in(m.FUNC)} AND NOT {_above("f", m.FUNC)}),
body AS MATERIALIZED (SELECT f.fn, f.body, x.*, p.type AS parent_type FROM fns f JOIN n x ON x.file_id = f.file_id AND x.pre BETWEEN f.body AND f.stop LEFT JOIN n p ON p.file_id = x.file_id AND p.pre = x.parent),
counted AS (SELECT file_id, fn, count(*) FILTER (WHERE type IN {_in(m.STMT)} AND NOT {_above("body", m.STMT_PRUNE, "body.body")}) AS statements,
  max(CASE WHEN pre = body.body THEN 0 ELSE {_count_above("body", m.DEPTH, "body.body")} + (type IN {_in(m.DEPTH)})::INTEGER END) AS max_indentation,
  max(CASE WHEN pre = body.body THEN 0 ELSE {_count_above("body", m.NESTED, "body.body")} + (type IN {_in(m.NESTED)})::INTEGER END) AS nested_function_depth,
  count(*) FILTER (WHERE type = 'return_statement') AS returns, count(*) FILTER (WHERE type IN {_in(m.BRANCH)}) AS branches, count(*) FILTER (WHERE type IN {_in(m.CALL)}) AS calls,
  count(DISTINCT text) FILTER (WHERE type IN ('identifier', 'variable_name') AND pre <> body.body AND parent <> body.body AND ({" OR ".join(f"parent_type = '{k}' AND field = '{v}'" for k, v in m.ASSIGN.items())})
    AND NOT {_above("body", m.STMT_PRUNE, "body.body")}) AS local_variables FROM body GROUP BY file_id, fn),
given AS (SELECT f.file_id, f.fn, c.pre, c.type, c.text, max((c.type IN ('list_splat_pattern', 'keyword_separator') OR coalesce(c.text = '*', false))::INTEGER) OVER (PARTITION BY f.file_id, f.fn ORDER BY c.pre) AS seen,
  (SELECT count(*) > 0 FROM n x JOIN n p ON p.file_id = x.file_id AND p.pre = x.parent WHERE x.file_id = c.file_id AND x.parent = c.pre AND lower(x.text) IN ('true', 'false') AND {_fields(m.BOOL_DEFAULT)}) AS flag
  FROM fns f JOIN n l ON l.file_id = f.file_id AND l.parent = f.fn AND l.field = 'parameters' JOIN n c ON c.file_id = l.file_id AND c.parent = l.pre),
sorted AS (SELECT *, type IN {_in(m.PYTHON_PARAM)} AND NOT (type = 'identifier' AND coalesce(text = 'self', false)) AS python FROM given),
params AS (SELECT file_id, fn, count(*) FILTER (WHERE python AND seen = 0 OR type IN {_in(m.OTHER_PARAM)}) AS arguments_positional, count(*) FILTER (WHERE python AND seen = 1) AS arguments_keyword_only, count(*) FILTER (WHERE flag) AS boolean_parameters FROM sorted GROUP BY file_id, fn),
decorated AS (SELECT f.file_id, f.fn, CASE o.type WHEN 'attribute_group' THEN 1 ELSE (SELECT count(*) FROM n d WHERE d.file_id = o.file_id AND d.parent = o.pre AND d.type = 'decorator') END AS decorators
  FROM fns f JOIN n o ON o.file_id = f.file_id AND o.pre = f.fn_parent WHERE o.type IN ('decorated_definition', 'attribute_group')),
returned AS (SELECT r.file_id, r.fn, max(CASE WHEN v.type IN ('tuple', 'expression_list') THEN (SELECT count(*) FROM n e WHERE e.file_id = v.file_id AND e.parent = v.pre AND e.is_named) ELSE 1 END) AS max_return_values
  FROM body r JOIN n v ON v.file_id = r.file_id AND v.parent = r.pre AND v.is_named AND v.type <> 'comment' WHERE r.type = 'return_statement' AND NOT {_above("r", m.RETURN_PRUNE, "r.body")} GROUP BY r.file_id, r.fn),
blocks AS (SELECT y.file_id, y.fn, b.pre AS block, b.last AS stop FROM body y JOIN n b ON b.file_id = y.file_id AND b.parent = y.pre AND b.field = 'body' WHERE y.type = 'try_statement' AND NOT {_above("y", m.TRY_PRUNE, "y.body")}),
tried AS (SELECT file_id, fn, max(c) AS max_try_block_statements FROM (SELECT b.file_id, b.fn, b.block, count(*) AS c FROM blocks b JOIN n x ON x.file_id = b.file_id AND x.pre BETWEEN b.block AND b.stop
  WHERE x.type IN {_in(m.STMT)} AND NOT {_above("x", m.STMT_PRUNE, "b.block")} GROUP BY ALL) GROUP BY ALL),
rows AS MATERIALIZED (SELECT file_id, path, lang, name, line, inside_class, {", ".join(f"coalesce({'arguments_positional + arguments_keyword_only' if c == 'arguments' else c}, 0)::BIGINT AS {c}" for c in m.FUNCTION_METRICS)}
  FROM fns LEFT JOIN counted USING (file_id, fn) LEFT JOIN params USING (file_id, fn) LEFT JOIN decorated USING (file_id, fn) LEFT JOIN returned USING (file_id, fn) LEFT JOIN tried USING (file_id, fn))"""

_CLASSES = f"""classes AS (SELECT c.file_id, c.path, c.lang, coalesce({_child("x", "name", "c", "text")}, '<anonymous>') AS name, c.start_row + 1 AS line,
  (SELECT count(*) FROM n b JOIN n d ON d.file_id = b.file_id AND d.parent = b.pre AND d.type IN {_in(m.METHOD)} WHERE b.file_id = c.file_id AND b.parent = c.pre AND b.field = 'body') AS methods
  FROM n c WHERE c.type IN {_in(m.CLASS)} AND NOT {_above("c", m.FUNC)})"""

_ABSTRACT = " OR ".join(f"b.text LIKE '%{x}%'" for x in m.INTERFACE_BASES)
_OUTER = f"""outer_ AS (SELECT x.*, x.lang = 'python' AND EXISTS (SELECT 1 FROM n b WHERE b.file_id = x.file_id AND b.parent = x.pre AND b.field = 'superclasses' AND ({_ABSTRACT})) AS abstract FROM n x WHERE NOT {_above("x", (*m.FUNC, "interface_declaration", *m.IMPORT))})"""
_FILE_ROWS = f"""{_OUTER},
named AS (SELECT i.file_id, CASE WHEN i.lang <> 'python' THEN greatest(1, (SELECT count(*) FROM n c WHERE c.file_id = i.file_id AND c.parent = i.pre AND c.type IN ('namespace_use_clause', 'import_specifier')))
  ELSE greatest(0, (SELECT count(*) FROM n c WHERE c.file_id = i.file_id AND c.parent = i.pre AND c.type IN ('dotted_name', 'aliased_import')) - (i.type = 'import_from_statement')::INTEGER) END AS c
  FROM n i WHERE i.type IN {_in(m.IMPORT)} AND NOT {_above("i", (*m.FUNC, "interface_declaration"))}),
file_rows AS MATERIALIZED (SELECT file_id, path AS file, lang, coalesce((SELECT sum(statements) FROM rows r WHERE r.file_id = f.file_id), 0)::BIGINT AS statements,
  (SELECT count(*) FROM outer_ o WHERE o.file_id = f.file_id AND (o.type IN {_in(m.CLASS)} AND o.abstract OR o.type = 'interface_declaration' OR o.type = 'interface_type' AND o.lang = 'go')) AS interface_types,
  (SELECT count(*) FROM outer_ o WHERE o.file_id = f.file_id AND (o.type IN {_in(m.CLASS)} AND NOT o.abstract OR o.type = 'struct_type' AND o.lang = 'go')) AS concrete_types,
  coalesce((SELECT sum(c) FROM named WHERE named.file_id = f.file_id), 0)::BIGINT AS imports, (SELECT count(*) FROM outer_ o WHERE o.file_id = f.file_id AND o.type IN {_in(m.FUNC)}) AS functions FROM files f)"""

_NEAREST = f"(SELECT arg_max(u.k, u.a) FROM up u WHERE u.file_id = x.file_id AND u.pre = x.pre AND u.k IN {_in((*m.FUNC, *m.CLASS))})"
_UNITS = f"""units AS (SELECT path, 'module' AS kind, regexp_replace(split_part(path, '/', -1), '\\.[^.]*$', '') AS name, 1 AS start_line, end_row + 1 AS end_line, 0 AS start_byte, end_byte, file_id FROM n WHERE pre = 0
  UNION ALL SELECT x.path, CASE WHEN x.type IN {_in(m.CLASS)} THEN 'class' WHEN {_NEAREST} IN {_in(m.CLASS)} THEN 'method' ELSE 'function' END, c.text, x.start_row + 1, x.end_row + 1, x.start_byte, x.end_byte, x.file_id
  FROM n x JOIN n c ON c.file_id = x.file_id AND c.parent = x.pre AND c.field = 'name' WHERE x.type IN {_in((*m.FUNC, *m.CLASS))})"""

_DEFINING = tuple(k for k in m.FUNC if k != "generator_function_declaration")
_DEFINITIONS = f"""own AS (SELECT x.*, c.text AS name, (SELECT arg_max(d.text, d.parent) FROM up u JOIN n d ON d.file_id = u.file_id AND d.parent = u.a AND d.field = 'name' WHERE u.file_id = x.file_id AND u.pre = x.pre AND u.k IN {_in(m.CLASS)}) AS containing_class
  FROM n x JOIN n c ON c.file_id = x.file_id AND c.parent = x.pre AND c.field = 'name' WHERE x.type IN {_in((*_DEFINING, *m.CLASS))} AND NOT {_above("x", _DEFINING)}
  AND NOT EXISTS (SELECT 1 FROM n d WHERE d.file_id = x.file_id AND d.parent = x.parent AND d.type = 'decorator' AND d.text LIKE '%abstractmethod%')
  AND NOT EXISTS (SELECT 1 FROM n b WHERE b.file_id = x.file_id AND b.field = 'superclasses' AND ({_ABSTRACT}) AND (b.parent = x.pre OR EXISTS (SELECT 1 FROM up u WHERE u.file_id = x.file_id AND u.pre = x.pre AND u.a = b.parent)))),
definitions AS (SELECT name, CASE WHEN type IN {_in(m.CLASS)} THEN 'class' WHEN containing_class IS NOT NULL THEN 'method' ELSE 'function' END AS kind, path AS file, start_row + 1 AS line,
  CASE WHEN type NOT IN {_in(m.CLASS)} THEN containing_class END AS containing_class FROM own WHERE type IN {_in(m.CLASS)} OR NOT (name LIKE '\\_%' ESCAPE '\\' AND name <> '__init__' OR name LIKE 'test\\_%' ESCAPE '\\'))"""

_REFERENCES = "refs AS (SELECT DISTINCT file_id, path, pre, text AS ref FROM n WHERE type = 'identifier' OR field = 'attribute')"
_TESTS = f"""tops AS (SELECT x.file_id, x.path, x.pre, x.last, x.type, c.text AS name FROM n x JOIN n c ON c.file_id = x.file_id AND c.parent = x.pre AND c.field = 'name' WHERE x.parent = 0),
tests AS (SELECT file_id, path, pre, last, name FROM tops WHERE type IN {_in(m.FUNC)} AND regexp_matches(name, '^(test_|Test)')
  UNION ALL SELECT x.file_id, x.path, x.pre, x.last, s.name || '.' || c.text FROM tops s JOIN n b ON b.file_id = s.file_id AND b.parent = s.pre AND b.field = 'body' JOIN n x ON x.file_id = b.file_id AND x.parent = b.pre
  JOIN n c ON c.file_id = x.file_id AND c.parent = x.pre AND c.field = 'name' WHERE s.type IN {_in(m.CLASS)} AND s.name LIKE 'Test%' AND x.type IN {_in(m.FUNC)} AND c.text LIKE 'test\\_%' ESCAPE '\\')"""

#: What the sources import of each other, by hand; no path is longer than an edge, so nothing is reached indirectly.
_GRAPH = """edges(src, dst) AS (VALUES ('tests.test_a', 'pkg.a')), degrees AS (SELECT module, (SELECT count(*) FROM edges WHERE dst = module) AS fan_in, (SELECT count(*) FROM edges WHERE src = module) AS fan_out
  FROM (SELECT replace(regexp_replace(path, '\\.[^.]*$', ''), '/', '.') AS module FROM files))"""
_VALUES = (
    _GRAPH
    + ", long AS ("
    + " UNION ALL ".join(
        [f"SELECT '{c}' AS metric, {c} AS value FROM rows" for c in m.FUNCTION_METRICS]
        + ["SELECT 'methods', methods FROM classes"]
        + [f"SELECT '{'statements_per_file' if c == 'statements' else c}', {c} FROM file_rows" for c in ("statements", "interface_types", "concrete_types", "imports", "functions")]
        + [f"SELECT '{c}', {value} FROM degrees" for c, value in (("fan_in", "fan_in"), ("fan_out", "fan_out"), ("transitive_deps", "0"), ("dependency_depth", "fan_out"))]
    )
    + ")"
)


def _checked(source: str, checks: dict, line: str, name: str, whose: str, file: str) -> list[str]:
    out = []
    for column, (metric, limit, called, advice) in checks.items():
        applies = " AND NOT inside_class" if column == "arguments_positional" else ""
        message = f"{whose} || ' has ' || {column} || {_literal(f' {called} (threshold: ')} || threshold || ')'"
        out.append(f"SELECT {file} AS file, {line} AS line, {name} AS unit_name, '{metric}' AS metric, {column} AS value, threshold, {message} AS message, {_literal(advice)} AS suggestion FROM {source} r JOIN limits l ON l.lang = r.lang AND l.metric = '{limit}' WHERE {column} > threshold{applies}")
    return out


def _violations(lowered: int | None = None) -> str:
    limits = ", ".join(f"('{lang}', '{k}', {v if lowered is None else lowered})" for lang, x in load_thresholds([]).items() for k, v in x.items() if v is not None)
    parts = _checked("file_rows", t.FILE_CHECKS, "1", "split_part(file, '/', -1)", "'File'", "file")
    parts += _checked("rows", t.FUNCTION_CHECKS, "line", "name", "CASE WHEN inside_class THEN 'Method' ELSE 'Function' END || ' ''' || name || ''''", "path")
    parts += _checked("classes", t.CLASS_CHECKS, "line", "name", "'Class ''' || name || ''''", "path")
    return f"limits(lang, metric, threshold) AS (VALUES {limits}), found AS ({' UNION ALL '.join(parts)}) SELECT file, line, unit_name, metric, value::BIGINT AS value, threshold::BIGINT AS threshold, message, suggestion FROM found"


def oracles(samples: list[tuple[str, str, str]], imports: str) -> dict[str, str]:
    """imports: SQL of (file_id, name), written out by hand."""
    tree = _trees(samples)
    tables = lambda *parts: ", ".join((tree, *parts))
    ask = lambda *parts: tables(*parts[:-1]) + " " + parts[-1]
    counts = ", ".join(m.FUNCTION_METRICS)
    ranks = ", ".join(f"quantile_disc(value, {p / 100})::BIGINT AS p{p}" for p in PERCENTS)
    return {
        "code_function_metrics": ask(_FUNCTIONS, f"SELECT path, lang, name, line, inside_class, {counts} FROM rows"),
        "code_class_metrics": ask(_CLASSES, "SELECT path, lang, name, line, methods FROM classes"),
        "code_file_metrics": ask(_FUNCTIONS, _FILE_ROWS, "SELECT file, lang, statements, interface_types, concrete_types, imports, functions FROM file_rows"),
        "code_units": ask(_UNITS, "SELECT path, kind, name, start_line, end_line, start_byte, end_byte FROM units"),
        "code_imports": imports,
        "code_definitions": ask(_DEFINITIONS, "SELECT name, kind, file, line, containing_class FROM definitions"),
        "code_chunks": ask(_UNITS, "SELECT u.path AS file, name, start_line, end_line, substr(source, start_byte + 1, end_byte - start_byte) AS source FROM units u JOIN files USING (file_id) WHERE kind IN ('function', 'method')"),
        "code_references": ask(_REFERENCES, "SELECT DISTINCT path, ref FROM refs"),
        "code_test_references": ask(_REFERENCES, _TESTS, "SELECT DISTINCT t.path AS test_file, name AS test_name, ref FROM tests t JOIN refs r ON r.file_id = t.file_id AND r.pre > t.pre AND r.pre <= t.last"),
        "code_wide": ask(_FUNCTIONS, "SELECT split_part(path, '/', -1) AS file, name AS unit, statements AS stmts, arguments AS args, max_indentation AS depth, branches, local_variables AS vars, calls FROM rows"),
        "code_violations": tables(_FUNCTIONS, _FILE_ROWS, _CLASSES, _violations()),
        "code_strict_violations": tables(_FUNCTIONS, _FILE_ROWS, _CLASSES, _violations(0)),
        "code_metric_values": ask(_FUNCTIONS, _FILE_ROWS, _CLASSES, _VALUES, "SELECT metric, value::BIGINT AS value, count(*) AS n FROM long GROUP BY ALL"),
        "code_statistics": ask(_FUNCTIONS, _FILE_ROWS, _CLASSES, _VALUES, f"SELECT metric, count(*) AS n, {ranks}, max(value)::BIGINT AS max FROM long GROUP BY metric"),
        "code_totals": ask(_FUNCTIONS, _FILE_ROWS, _UNITS, _GRAPH, "SELECT count(*) AS files, (SELECT count(*) FROM units) AS code_units, sum(statements)::BIGINT AS statements, count(*) AS graph_nodes, (SELECT count(*) FROM edges) AS graph_edges FROM file_rows"),
    }
