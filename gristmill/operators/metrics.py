"""Metrics of functions, classes and files over a table of syntax-tree nodes.

nodes(file_id, path, lang, pre, parent, last, type, field, is_named, start_row, end_row, text, anc, anc_types): `pre` numbers
nodes depth first, `anc` and `anc_types` hold the ancestors from the root to the parent. A subtree aggregate is then a
group-by after exploding `anc` with the positions of the owners, never a range join; what must be pruned or counted on
the way down is a condition on the slice of `anc_types` below the owner. All metrics of functions come out of one
aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Kinds of nodes, as the trees have them.
FUNC = ("function_definition", "async_function_definition", "function_declaration", "generator_function_declaration", "method_definition", "method_declaration")
CLASS = ("class_definition", "class_declaration")
STMT = (
    "expression_statement", "return_statement", "delete_statement", "raise_statement", "pass_statement", "break_statement", "continue_statement", "assert_statement",
    "global_statement", "nonlocal_statement", "assignment", "augmented_assignment", "echo_statement", "throw_expression", "assignment_expression", "throw_statement", "variable_declaration",
)
STMT_PRUNE = ("function_definition", "async_function_definition", "class_definition", "function_declaration", "generator_function_declaration", "arrow_function", "class_declaration", "method_declaration", "method_definition")
DEPTH = (
    "if_statement", "elif_clause", "else_clause", "for_statement", "while_statement", "for_in_statement", "with_statement", "try_statement", "except_clause", "match_statement",
    "case_clause", "else_if_clause", "foreach_statement", "do_statement", "switch_statement", "case_statement", "catch_clause", "switch_case",
)
NESTED = ("function_definition", "async_function_definition", "anonymous_function_creation_expression", "function_declaration", "arrow_function", "generator_function_declaration")
BRANCH = ("if_statement", "elif_clause", "case_clause", "else_if_clause", "case_statement", "switch_case")
CALL = ("call", "function_call_expression", "member_call_expression", "scoped_call_expression", "call_expression", "new_expression")
ASSIGN = {"assignment": "left", "augmented_assignment": "left", "assignment_expression": "left", "variable_declarator": "name"}
BOOL_DEFAULT = {"default_parameter": "value", "typed_default_parameter": "value", "simple_parameter": "default_value", "required_parameter": "value", "optional_parameter": "value"}
PYTHON_PARAM = ("identifier", "typed_parameter", "default_parameter", "typed_default_parameter")
OTHER_PARAM = ("simple_parameter", "variadic_parameter", "required_parameter", "optional_parameter", "formal_parameter")
METHOD = ("function_definition", "async_function_definition", "method_declaration", "method_definition")
IMPORT = ("import_statement", "import_from_statement", "namespace_use_declaration", "import_declaration")
RETURN_PRUNE = ("function_definition", "async_function_definition", "function_declaration", "arrow_function", "generator_function_declaration")
TRY_PRUNE = (*RETURN_PRUNE, "method_declaration", "method_definition")
INTERFACE_BASES = ("Protocol", "ABC")
FUNCTION_METRICS = ("statements", "arguments", "arguments_positional", "arguments_keyword_only", "max_indentation", "nested_function_depth", "returns", "branches", "local_variables", "max_try_block_statements", "boolean_parameters", "decorators", "max_return_values", "calls")


def _in(c: Column, kinds: tuple[str, ...]) -> Column:
    return c.isin(*kinds)


def _any(types: Column, kinds: tuple[str, ...]) -> Column:
    return F.arrays_overlap(types, F.array(*map(F.lit, kinds)))


def _has(types: Column, kinds: tuple[str, ...]) -> Column:
    """How many of an array of types are of some kinds."""
    return F.size(F.filter(types, lambda t: t.isin(*kinds)))


def functions(nodes: DataFrame) -> DataFrame:
    """The function nodes that have rows: outermost ones, with a body; a function inside another has none."""
    f = nodes.where(_in(F.col("type"), FUNC) & ~_any(F.col("anc_types"), FUNC))
    body = nodes.where("field = 'body'").select("file_id", F.col("parent").alias("pre"), F.col("pre").alias("body"))
    name = nodes.where("field = 'name'").select("file_id", F.col("parent").alias("pre"), F.col("text").alias("name"))
    found = f.join(body, ["file_id", "pre"]).join(name, ["file_id", "pre"], "left")
    return found.select("file_id", "path", "lang", F.col("pre").alias("fn"), "body", F.coalesce("name", F.lit("<anonymous>")).alias("name"), (F.col("start_row") + 1).alias("line"), _any(F.col("anc_types"), CLASS).alias("inside_class"), F.col("parent").alias("fn_parent"))


def _below(nodes: DataFrame, owners: DataFrame, owner: str) -> DataFrame:
    """Each node under an owner, and the owner itself, with `over`, the types from below the owner down to its parent."""
    at = F.posexplode(F.concat("anc", F.array("pre")))
    inside = nodes.select("*", at.alias("depth", owner))
    over = F.slice("anc_types", F.col("depth") + 2, F.greatest(F.size("anc") - F.col("depth") - 1, F.lit(0)))
    return inside.join(owners, ["file_id", owner]).withColumn("over", over).withColumn("is_owner", F.col("pre") == F.col(owner))


def _in_functions(nodes: DataFrame, fns: DataFrame) -> DataFrame:
    """As _below for the bodies of functions(): a node is in one of them at most, that on its path after the outermost function,
    so there is a row a node to be joined and not one for each ancestor."""
    at = F.array_position(F.transform(F.concat("anc_types", F.array("type")), lambda t: t.isin(*FUNC)), True).cast("int")
    inside = nodes.withColumn("depth", at).where("depth > 0").withColumn("body", F.get(F.concat("anc", F.array("pre")), F.col("depth")))
    over = F.slice("anc_types", F.col("depth") + 2, F.greatest(F.size("anc") - F.col("depth") - 1, F.lit(0)))
    return inside.join(fns.select("file_id", "body", "fn"), ["file_id", "body"]).withColumn("over", over).withColumn("is_owner", F.col("pre") == F.col("body"))


def function_metrics(nodes: DataFrame) -> DataFrame:
    """One row a function with all its metrics, of one aggregation over the nodes below the function."""
    fns = functions(nodes)
    body = _in_functions(nodes, fns)
    t, over = F.col("type"), F.col("over")
    pure = ~_any(over, STMT_PRUNE)
    strict = ~F.col("is_owner")
    path = F.when(strict, F.concat("over", F.array("type"))).otherwise(F.array().cast("array<string>"))
    # names assigned to: a plain name in the node's target field, whose parent is an assignment
    target = F.lit(False)
    for kind, field in ASSIGN.items():
        target |= (F.try_element_at("anc_types", F.lit(-1)) == kind) & (F.col("field") == field)
    named = strict & target & _in(t, ("identifier", "variable_name")) & (F.size("over") > 0) & ~_any(over, STMT_PRUNE)
    agg = body.groupBy("file_id", "fn").agg(
        F.sum((_in(t, STMT) & pure).cast("bigint")).alias("statements"),
        F.max(_has(path, DEPTH)).cast("bigint").alias("max_indentation"),
        F.max(_has(path, NESTED)).cast("bigint").alias("nested_function_depth"),
        F.sum((t == "return_statement").cast("bigint")).alias("returns"),
        F.sum(_in(t, BRANCH).cast("bigint")).alias("branches"),
        F.sum(_in(t, CALL).cast("bigint")).alias("calls"),
        F.count_distinct(F.when(named, F.col("text"))).alias("local_variables"),
    )
    out = fns.join(agg, ["file_id", "fn"])
    for more in (parameters(nodes, fns), decorators(nodes, fns), return_values(nodes, fns), try_statements(nodes, fns)):
        out = out.join(more, ["file_id", "fn"], "left")
    return out.select("file_id", "path", "lang", "fn", "name", "line", "inside_class", *(F.coalesce(F.col(m), F.lit(0)).cast("bigint").alias(m) for m in FUNCTION_METRICS))


def parameters(nodes: DataFrame, fns: DataFrame) -> DataFrame:
    """arguments, arguments_positional, arguments_keyword_only and boolean_parameters; self isn't counted, splats aren't,
    and after a * Python's parameters are keyword-only."""
    lists = nodes.where("field = 'parameters'").select("file_id", F.col("parent").alias("fn"), F.col("pre").alias("list")).join(fns.select("file_id", "fn"), ["file_id", "fn"])
    children = nodes.select("file_id", F.col("parent").alias("list"), "pre", "type", "text").join(lists, ["file_id", "list"])
    star = F.col("type").isin("list_splat_pattern", "keyword_separator") | F.coalesce(F.col("text") == "*", F.lit(False))
    seen = F.max(star.cast("int")).over(Window.partitionBy("file_id", "fn").orderBy("pre"))
    python = _in(F.col("type"), PYTHON_PARAM) & ~((F.col("type") == "identifier") & (F.col("text") == "self"))
    rows = children.withColumn("seen", seen).withColumn("keyword", python & (F.col("seen") == 1)).withColumn("positional", (python & (F.col("seen") == 0)) | _in(F.col("type"), OTHER_PARAM))
    default = F.lit(False)
    for kind, field in BOOL_DEFAULT.items():
        default |= (F.try_element_at("anc_types", F.lit(-1)) == kind) & (F.col("field") == field)
    flags = nodes.where(default & F.lower("text").isin("true", "false")).select("file_id", F.col("parent").alias("pre")).distinct().withColumn("flag", F.lit(1))
    rows = rows.join(flags, ["file_id", "pre"], "left")
    n = lambda c: F.sum(F.col(c).cast("bigint"))
    return rows.groupBy("file_id", "fn").agg((n("positional") + n("keyword")).alias("arguments"), n("positional").alias("arguments_positional"), n("keyword").alias("arguments_keyword_only"), n("flag").alias("boolean_parameters"))


def decorators(nodes: DataFrame, fns: DataFrame) -> DataFrame:
    """Decorators beside a function under decorated_definition; one for an attribute group."""
    owner = nodes.where(_in(F.col("type"), ("decorated_definition", "attribute_group"))).select("file_id", F.col("pre").alias("fn_parent"), F.col("type").alias("of"))
    n = nodes.where("type = 'decorator'").groupBy("file_id", F.col("parent").alias("fn_parent")).agg(F.count("*").alias("n"))
    found = fns.select("file_id", "fn", "fn_parent").join(owner, ["file_id", "fn_parent"]).join(n, ["file_id", "fn_parent"], "left")
    return found.select("file_id", "fn", F.when(F.col("of") == "attribute_group", 1).otherwise(F.coalesce("n", F.lit(0))).alias("decorators"))


def return_values(nodes: DataFrame, fns: DataFrame) -> DataFrame:
    """The most values that a return outside nested functions has: those of a tuple or list of expressions, else one."""
    own = _in_functions(nodes.where("type = 'return_statement'"), fns).where(~_any(F.col("over"), RETURN_PRUNE)).select("file_id", "fn", F.col("pre").alias("ret"))
    value = nodes.where("is_named").select("file_id", F.col("parent").alias("ret"), F.col("pre").alias("value"), "type").join(own, ["file_id", "ret"]).where("type <> 'comment'")
    parts = nodes.where("is_named").groupBy("file_id", F.col("parent").alias("value")).agg(F.count("*").alias("parts"))
    sized = value.join(parts, ["file_id", "value"], "left").select("file_id", "fn", F.when(_in(F.col("type"), ("tuple", "expression_list")), F.coalesce("parts", F.lit(0))).otherwise(1).alias("n"))
    return sized.groupBy("file_id", "fn").agg(F.max("n").alias("max_return_values"))


def try_statements(nodes: DataFrame, fns: DataFrame) -> DataFrame:
    """The most statements in the body of a try outside nested functions."""
    tries = _in_functions(nodes.where("type = 'try_statement'"), fns).where(~_any(F.col("over"), TRY_PRUNE)).select("file_id", "fn", F.col("pre").alias("try"))
    bodies = nodes.where("field = 'body'").select("file_id", F.col("parent").alias("try"), F.col("pre").alias("block")).join(tries, ["file_id", "try"])
    statements = nodes.where(_in(F.col("type"), STMT) & F.array_contains("anc_types", "try_statement"))
    inside = _below(statements, bodies.select("file_id", "block", "fn"), "block").where(~_any(F.col("over"), STMT_PRUNE))
    return inside.groupBy("file_id", "fn", "block").agg(F.count("*").alias("n")).groupBy("file_id", "fn").agg(F.max("n").alias("max_try_block_statements"))


def class_metrics(nodes: DataFrame) -> DataFrame:
    """Methods of each class outside functions: direct children of its body."""
    classes = nodes.where(_in(F.col("type"), CLASS) & ~_any(F.col("anc_types"), FUNC))
    name = nodes.where("field = 'name'").select("file_id", F.col("parent").alias("pre"), F.col("text").alias("name"))
    body = nodes.where("field = 'body'").select("file_id", F.col("parent").alias("pre"), F.col("pre").alias("body"))
    methods = nodes.where(_in(F.col("type"), METHOD)).groupBy("file_id", F.col("parent").alias("body")).agg(F.count("*").alias("n"))
    found = classes.join(body, ["file_id", "pre"], "left").join(name, ["file_id", "pre"], "left").join(methods, ["file_id", "body"], "left")
    return found.select("file_id", "path", "lang", F.coalesce("name", F.lit("<anonymous>")).alias("name"), (F.col("start_row") + 1).alias("line"), F.coalesce("n", F.lit(0)).cast("bigint").alias("methods"))


def import_names(nodes: DataFrame) -> DataFrame:
    """(file_id, pre, names): how many names an import has, by language."""
    kinds = ("dotted_name", "aliased_import", "namespace_use_clause", "import_specifier")
    child = nodes.where(_in(F.col("type"), kinds)).groupBy("file_id", F.col("parent").alias("pre")).agg(F.sum(F.col("type").isin("dotted_name", "aliased_import").cast("int")).alias("dotted"), F.sum((~F.col("type").isin("dotted_name", "aliased_import")).cast("int")).alias("clauses"))
    found = nodes.where(_in(F.col("type"), IMPORT)).join(child, ["file_id", "pre"], "left")
    dotted, clauses = F.coalesce("dotted", F.lit(0)), F.coalesce("clauses", F.lit(0))
    names = F.when(F.col("lang") != "python", F.greatest(F.lit(1), clauses)).when(F.col("type") == "import_from_statement", F.greatest(F.lit(0), dotted - 1)).otherwise(dotted)
    return found.select("file_id", "pre", names.alias("names"), "anc_types")


def file_metrics(nodes: DataFrame) -> DataFrame:
    """Functions not inside others, their statements, interface and concrete types, imported names: a row a file."""
    outer = ~_any(F.col("anc_types"), (*FUNC, "interface_declaration", *IMPORT))
    supers = nodes.where("field = 'superclasses'").select("file_id", F.col("parent").alias("pre"), F.col("text").alias("bases"))
    typed = nodes.join(supers, ["file_id", "pre"], "left").withColumn("abstract", F.coalesce(F.col("bases").rlike("|".join(INTERFACE_BASES)), F.lit(False)) & (F.col("lang") == "python"))
    t = F.col("type")
    flags = typed.where(outer).select("file_id", (_in(t, CLASS) & F.col("abstract") | (t == "interface_declaration") | ((t == "interface_type") & (F.col("lang") == "go"))).cast("bigint").alias("i"), (_in(t, CLASS) & ~F.col("abstract") | ((t == "struct_type") & (F.col("lang") == "go"))).cast("bigint").alias("c"), _in(t, FUNC).cast("bigint").alias("f"))
    types = flags.groupBy("file_id").agg(F.sum("i").alias("interface_types"), F.sum("c").alias("concrete_types"), F.sum("f").alias("functions"))
    statements = function_statements(nodes).groupBy("file_id").agg(F.sum("statements").alias("statements"))
    imports = import_names(nodes).where(~_any(F.col("anc_types"), (*FUNC, "interface_declaration"))).groupBy("file_id").agg(F.sum("names").alias("imports"))
    files = nodes.where("pre = 0").select("file_id", F.col("path").alias("file"), "lang")
    out = files.join(types, "file_id", "left").join(statements, "file_id", "left").join(imports, "file_id", "left")
    return out.select("file_id", "file", "lang", *(F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("statements", "interface_types", "concrete_types", "imports", "functions")))


def function_statements(nodes: DataFrame) -> DataFrame:
    body = _in_functions(nodes.where(_in(F.col("type"), STMT)), functions(nodes))
    return body.where(~_any(F.col("over"), STMT_PRUNE)).groupBy("file_id", "fn").agg(F.count("*").alias("statements"))


def code_units(nodes: DataFrame) -> DataFrame:
    """Modules, and functions, methods and classes with a name, at any depth: a function whose nearest function or class
    is a class is a method."""
    name = nodes.where("field = 'name'").select("file_id", F.col("parent").alias("pre"), F.col("text").alias("name"))
    near = F.try_element_at(F.filter("anc_types", lambda t: t.isin(*FUNC, *CLASS)), F.lit(-1))
    near = F.when(F.exists("anc_types", lambda t: t.isin(*FUNC, *CLASS)), near)
    kind = F.when(_in(F.col("type"), CLASS), "class").when(near.isin(*CLASS), "method").otherwise("function")
    own = nodes.where(_in(F.col("type"), (*FUNC, *CLASS))).join(name, ["file_id", "pre"])
    own = own.select("file_id", "path", kind.alias("kind"), "name", (F.col("start_row") + 1).alias("start_line"), (F.col("end_row") + 1).alias("end_line"), "start_byte", "end_byte")
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    root = nodes.where("pre = 0").select("file_id", "path", F.lit("module").alias("kind"), stem.alias("name"), F.lit(1).alias("start_line"), (F.col("end_row") + 1).alias("end_line"), F.lit(0).alias("start_byte"), "end_byte")
    return root.unionByName(own)


def chunks(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Functions and methods with their source: what duplication looks at."""
    units = code_units(nodes).where("kind in ('function', 'method')").join(files.select("file_id", F.encode("source", "utf-8").alias("raw")), "file_id")
    source = F.decode(F.substring(F.col("raw"), F.col("start_byte") + 1, F.col("end_byte") - F.col("start_byte")), "utf-8")
    return units.select(F.xxhash64("file_id", "start_byte", "end_byte").alias("chunk_id"), F.col("path").alias("file"), "name", "start_line", "end_line", source.alias("source"))


def imports(nodes: DataFrame, compatible: bool = False) -> DataFrame:
    """(file_id, name) of each import at any depth. compatible: JavaScript's, TypeScript's and PHP's give none."""
    direct = nodes.where("type in ('import_statement', 'import_from_statement')").select("file_id", "lang", F.col("pre").alias("at"), F.col("type").alias("of"))
    child = nodes.select("file_id", F.col("parent").alias("at"), "type", "field", "text", "pre")
    rows = child.join(direct, ["file_id", "at"])
    aliased = nodes.where("field = 'name'").select("file_id", F.col("parent").alias("pre"), F.col("text").alias("aliased"))
    python = rows.where("lang = 'python'").join(aliased, ["file_id", "pre"], "left")
    python = python.where("of = 'import_from_statement' and field = 'module_name' or of = 'import_statement' and type in ('dotted_name', 'aliased_import')").select("file_id", F.when(F.col("type") == "aliased_import", F.col("aliased")).otherwise(F.col("text")).alias("name"))
    bare = F.regexp_replace("text", "^[\"'`]|[\"'`]$", "")
    go = nodes.where("lang = 'go' and field = 'path' and type like '%string_literal'").select("file_id", bare.alias("name"))
    found = python.unionByName(go)
    if not compatible:
        found = found.unionByName(rows.where("lang in ('javascript', 'typescript') and field = 'source'").select("file_id", bare.alias("name")))
        found = found.unionByName(nodes.where("type = 'namespace_name' and array_contains(anc_types, 'namespace_use_declaration')").select("file_id", F.col("text").alias("name")))
    return found


def definitions(nodes: DataFrame) -> DataFrame:
    """Functions, methods and classes that tests should name: none inside functions, no test_ or _ names but __init__,
    none marked abstract, and no class derived from Protocol or ABC nor its members. Class names are not filtered."""
    func = tuple(k for k in FUNC if k != "generator_function_declaration")
    name = nodes.where("field = 'name'").select("file_id", F.col("parent").alias("pre"), F.col("text").alias("name"))
    own = nodes.where(_in(F.col("type"), (*func, *CLASS)) & ~_any(F.col("anc_types"), func)).join(name, ["file_id", "pre"])
    marked = nodes.where("type = 'decorator' and text like '%abstractmethod%'").select("file_id", "parent").distinct()
    own = own.join(marked, ["file_id", "parent"], "left_anti")
    abstract = nodes.where("field = 'superclasses'").where(F.col("text").rlike("|".join(INTERFACE_BASES))).select("file_id", F.col("parent").alias("up"))
    up = own.select("file_id", "pre", F.explode(F.concat("anc", F.array("pre"))).alias("up")).join(abstract, ["file_id", "up"], "left_semi").select("file_id", "pre").distinct()
    own = own.join(up, ["file_id", "pre"], "left_anti")
    classes = nodes.where(_in(F.col("type"), CLASS)).join(name, ["file_id", "pre"]).select("file_id", F.col("pre").alias("class"), F.col("name").alias("containing_class"))
    near = F.try_element_at(F.filter(F.arrays_zip("anc", "anc_types"), lambda x: x["anc_types"].isin(*CLASS)), F.lit(-1))["anc"]
    near = F.when(_any(F.col("anc_types"), CLASS), near)
    own = own.withColumn("class", near).join(classes, ["file_id", "class"], "left")
    is_class = _in(F.col("type"), CLASS)
    private = (F.col("name").startswith("_") & (F.col("name") != "__init__")) | F.col("name").startswith("test_")
    kind = F.when(is_class, "class").when(F.col("containing_class").isNotNull(), "method").otherwise("function")
    return own.where(is_class | ~private).select("name", kind.alias("kind"), F.col("path").alias("file"), (F.col("start_row") + 1).alias("line"), F.when(~is_class, F.col("containing_class")).alias("containing_class"))


def references(nodes: DataFrame) -> DataFrame:
    """(path, ref): identifiers, and the attribute's name of attribute nodes, each once a file."""
    return nodes.where("type = 'identifier' or field = 'attribute'").select("path", F.col("text").alias("ref")).distinct()


def test_files(nodes: DataFrame) -> DataFrame:
    """(file_id) of Python files that are tests by what is in them: an import at the top names a test framework anywhere in its
    text, and a function at any depth is called test_ something."""
    top = nodes.where("lang = 'python' and type in ('import_statement', 'import_from_statement') and parent = 0").select("file_id", F.col("pre").alias("at"))
    named = nodes.where(F.col("text").rlike("pytest|unittest")).select("file_id", F.explode(F.concat("anc", F.array("pre"))).alias("at"))
    imported = named.join(top, ["file_id", "at"], "left_semi").select("file_id").distinct()
    tests = nodes.where("field = 'name' and text like 'test\\_%'").select("file_id", F.col("parent").alias("pre"))
    functions = nodes.where("type in ('function_definition', 'async_function_definition')").select("file_id", "pre")
    return imported.join(functions.join(tests, ["file_id", "pre"]).select("file_id").distinct(), "file_id")


def test_references(nodes: DataFrame) -> DataFrame:
    """(test_file, test_name, ref) of test functions at the top of a file and of test methods of Test classes there."""
    name = nodes.where("field = 'name'").select("file_id", F.col("parent").alias("pre"), F.col("text").alias("name"))
    top = nodes.where(_in(F.col("type"), (*FUNC, *CLASS)) & (F.size("anc") <= 3)).join(name, ["file_id", "pre"]).select("file_id", "path", "pre", "parent", "type", "name", F.size("anc").alias("depth"))
    tests = top.where(_in(F.col("type"), FUNC) & (F.col("depth") == 1) & F.col("name").rlike("^(test_|Test)")).select("file_id", "path", "pre", "name")
    suites = top.where(_in(F.col("type"), CLASS) & (F.col("depth") == 1) & F.col("name").startswith("Test")).select("file_id", F.col("pre").alias("suite"), F.col("name").alias("suite_name"))
    body = nodes.where("field = 'body'").select("file_id", F.col("pre").alias("parent"), F.col("parent").alias("suite"))
    methods = top.where(_in(F.col("type"), FUNC) & F.col("name").startswith("test_")).join(body, ["file_id", "parent"]).join(suites, ["file_id", "suite"])
    tests = tests.unionByName(methods.select("file_id", "path", "pre", F.concat_ws(".", "suite_name", "name").alias("name")))
    refs = nodes.where("type = 'identifier' or field = 'attribute'").select("file_id", F.explode("anc").alias("pre"), F.col("text").alias("ref"))
    return refs.join(tests, ["file_id", "pre"]).select(F.col("path").alias("test_file"), F.col("name").alias("test_name"), "ref").distinct()


def metric_values(function_rows: DataFrame, class_rows: DataFrame, file_rows: DataFrame) -> DataFrame:
    """(metric, value) of all functions, classes and files: what the statistics are taken of."""
    from gristmill.operators.stats import unpivot

    parts = [unpivot(function_rows, [], list(FUNCTION_METRICS)), unpivot(class_rows, [], ["methods"])]
    parts.append(unpivot(file_rows.withColumnRenamed("statements", "statements_per_file"), [], ["statements_per_file", "interface_types", "concrete_types", "imports", "functions"]))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def totals(file_rows: DataFrame, units: DataFrame, modules: DataFrame, edges: DataFrame) -> DataFrame:
    """The one row of global metrics."""
    one = file_rows.agg(F.count("*").alias("files"), F.coalesce(F.sum("statements"), F.lit(0)).alias("statements"))
    count = lambda df, c: df.agg(F.count("*").alias(c))
    return one.crossJoin(count(units, "code_units")).crossJoin(count(modules.select("module").distinct(), "graph_nodes")).crossJoin(count(edges, "graph_edges")).select("files", "code_units", "statements", "graph_nodes", "graph_edges")
