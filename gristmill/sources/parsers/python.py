"""Python to nodes, by the standard library's parser: kinds and fields are those the metrics know."""

from __future__ import annotations

import ast
import re

from gristmill.sources.parsers.tree import Tree

_SIMPLE = {ast.Pass: "pass_statement", ast.Break: "break_statement", ast.Continue: "continue_statement", ast.Raise: "raise_statement", ast.Assert: "assert_statement", ast.Delete: "delete_statement", ast.Return: "return_statement"}
_NAMES = {ast.Global: "global_statement", ast.Nonlocal: "nonlocal_statement"}
_LOOPS = {ast.For: "for_statement", ast.AsyncFor: "for_statement", ast.While: "while_statement", ast.With: "with_statement", ast.AsyncWith: "with_statement"}


class _Walk:
    def __init__(self, source: bytes, broken: set[int] = frozenset()):
        self.tree, self.source, self.broken = Tree(source), source, broken

    def span(self, n: ast.AST) -> tuple[int, int]:
        lines = self.tree.lines
        return lines[n.lineno - 1] + n.col_offset, lines[n.end_lineno - 1] + n.end_col_offset

    def block(self, body: list[ast.stmt], field: str | None = "body") -> None:
        start = min(self.span(d)[0] for d in [body[0], *getattr(body[0], "decorator_list", [])])
        with self.tree.node("block", start, self.span(body[-1])[1], field):
            for s in body:
                self.statement(s)

    def find(self, what: str, start: int, end: int) -> tuple[int, int]:
        """The first place of a word, or of a name's spelling, between two bytes."""
        m = re.compile(rb"(?<![\w.])" + re.escape(what.encode()) + rb"(?!\w)").search(self.source, start, end)
        return m.span() if m else (start, start)

    def definition(self, n: ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef, field: str | None = None) -> None:
        start, end = self.span(n)
        if n.decorator_list:
            marks = [(self.span(d)[0], d) for d in n.decorator_list]
            first = self.source.rfind(b"@", 0, marks[0][0] + 1)
            with self.tree.node("decorated_definition", first, end, field):
                for _, d in marks:
                    a, b = self.span(d)
                    with self.tree.node("decorator", self.source.rfind(b"@", 0, a + 1), b, None, True):
                        self.expression(d)
                self.plain(n, start, end, "definition")
        else:
            self.plain(n, start, end, field)

    def plain(self, n, start: int, end: int, field: str | None) -> None:
        is_class = isinstance(n, ast.ClassDef)
        with self.tree.node("class_definition" if is_class else "function_definition", start, end, field):
            self.tree.leaf("identifier", *self.find(n.name, start + 3, end), "name")
            if is_class:
                parts = [*n.bases, *(k.value for k in n.keywords)]
                if parts:
                    with self.tree.node("argument_list", self.span(parts[0])[0], max(self.span(p)[1] for p in parts), "superclasses", True):
                        for p in parts:
                            self.expression(p)
            else:
                self.parameters(n.args, start)
                if n.returns:
                    self.expression(n.returns, "return_type")
            self.block(n.body)

    def parameters(self, a: ast.arguments, at: int) -> None:
        positional = [*a.posonlyargs, *a.args]
        defaults = [None] * (len(positional) - len(a.defaults)) + list(a.defaults)
        with self.tree.node("parameters", at, at, "parameters"):
            for i, (p, d) in enumerate(zip(positional, defaults, strict=True)):
                self.parameter(p, d)
                if a.posonlyargs and i + 1 == len(a.posonlyargs):
                    self.tree.leaf("positional_separator", at, at)
            if a.vararg:
                self.splat("list_splat_pattern", a.vararg)
            elif a.kwonlyargs:
                self.tree.leaf("keyword_separator", at, at)
            for p, d in zip(a.kwonlyargs, a.kw_defaults, strict=True):
                self.parameter(p, d)
            if a.kwarg:
                self.splat("dictionary_splat_pattern", a.kwarg)

    def splat(self, kind: str, p: ast.arg) -> None:
        start, end = self.span(p)
        with self.tree.node(kind, start, end):
            self.tree.leaf("identifier", start, start + len(p.arg.encode()))

    def parameter(self, p: ast.arg, default: ast.expr | None) -> None:
        start, end = self.span(p)
        name = (start, start + len(p.arg.encode()))
        if default is None and p.annotation is None:
            self.tree.leaf("identifier", *name)
            return
        kind = "typed_parameter" if default is None else "default_parameter" if p.annotation is None else "typed_default_parameter"
        with self.tree.node(kind, start, end if default is None else self.span(default)[1]):
            self.tree.leaf("identifier", *name, None if default is None else "name")
            if p.annotation:
                with self.tree.node("type", *self.span(p.annotation), "type"):
                    self.expression(p.annotation)
            if default is not None:
                self.expression(default, "value")

    def clause(self, kind: str, body: list[ast.stmt], start: int, field: str | None = None) -> None:
        with self.tree.node(kind, start, self.span(body[-1])[1], field):
            self.block(body)

    def statement(self, s: ast.stmt) -> None:
        start, end = self.span(s)
        if isinstance(s, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            self.definition(s)
        elif isinstance(s, ast.Pass) and s.lineno in self.broken:
            self.tree.leaf("ERROR", start, end)
        elif type(s) in _SIMPLE:
            with self.tree.node(_SIMPLE[type(s)], start, end):
                for child in ast.iter_child_nodes(s):
                    bare = isinstance(s, ast.Return) and isinstance(child, ast.Tuple) and self.source[self.span(child)[0] : self.span(child)[0] + 1] != b"("
                    self.expression(child, kind="expression_list" if bare else None)
        elif type(s) in _NAMES:
            with self.tree.node(_NAMES[type(s)], start, end):
                for name in s.names:
                    self.tree.leaf("identifier", *self.find(name, start, end))
        elif isinstance(s, ast.Import):
            with self.tree.node("import_statement", start, end):
                for a in s.names:
                    self.imported(a)
        elif isinstance(s, ast.ImportFrom):
            with self.tree.node("import_from_statement", start, end):
                after = start + 4
                while self.source[after : after + 1].isspace():
                    after += 1
                stop = after + len(re.match(rb"[\w.\s]*?(?=\s*\bimport\b)", self.source[after:end]).group())
                self.tree.leaf("relative_import" if s.level else "dotted_name", after, stop, "module_name")
                for a in s.names:
                    if a.name == "*":
                        self.tree.leaf("wildcard_import", *self.span(a))
                    else:
                        self.imported(a)
        elif isinstance(s, ast.Expr):
            with self.tree.node("expression_statement", start, end):
                self.expression(s.value)
        elif isinstance(s, ast.Assign | ast.AnnAssign | ast.AugAssign):
            with self.tree.node("expression_statement", start, end):
                self.assignment(s)
        elif isinstance(s, ast.If):
            self.conditional(s, "if_statement", start, end)
        elif type(s) in _LOOPS:
            with self.tree.node(_LOOPS[type(s)], start, end):
                for child in ast.iter_child_nodes(s):
                    if not isinstance(child, ast.stmt):
                        self.expression(child)
                self.block(s.body)
                if getattr(s, "orelse", None):
                    self.clause("else_clause", s.orelse, self.span(s.body[-1])[1], "alternative")
        elif isinstance(s, ast.Try | ast.TryStar):
            with self.tree.node("try_statement", start, end):
                self.block(s.body)
                for h in s.handlers:
                    with self.tree.node("except_clause", *self.span(h)):
                        if h.type:
                            self.expression(h.type)
                        self.block(h.body, None)
                if s.orelse:
                    self.clause("else_clause", s.orelse, self.span(s.orelse[0])[0])
                if s.finalbody:
                    with self.tree.node("finally_clause", self.span(s.finalbody[0])[0], end):
                        self.block(s.finalbody, None)
        elif isinstance(s, ast.Match):
            with self.tree.node("match_statement", start, end):
                self.expression(s.subject, "subject")
                with self.tree.node("block", self.span(s.cases[0].pattern)[0], end, "body"):
                    for c in s.cases:
                        with self.tree.node("case_clause", self.span(c.pattern)[0], self.span(c.body[-1])[1], "alternative"):
                            if c.guard:
                                self.expression(c.guard, "guard")
                            self.block(c.body, "consequence")
        else:
            with self.tree.node(_snake(s), start, end):
                for child in ast.iter_child_nodes(s):
                    self.expression(child)

    def imported(self, a: ast.alias) -> None:
        start, end = self.span(a)
        if a.asname:
            with self.tree.node("aliased_import", start, end, "name"):
                self.tree.leaf("dotted_name", start, start + len(a.name.encode()), "name")
                self.tree.leaf("identifier", end - len(a.asname.encode()), end, "alias")
        else:
            self.tree.leaf("dotted_name", start, end, "name")

    def conditional(self, s: ast.If, kind: str, start: int, end: int) -> None:
        """elif comes as an If alone in orelse that is spelled elif."""
        chain, tail = [], s.orelse
        while len(tail) == 1 and isinstance(tail[0], ast.If) and self.source[self.span(tail[0])[0] :].startswith(b"elif"):
            chain.append(tail[0])
            tail = tail[0].orelse
        with self.tree.node(kind, start, end):
            self.expression(s.test, "condition")
            self.block(s.body, "consequence")
            for c in chain:
                with self.tree.node("elif_clause", self.span(c)[0], self.span(c.body[-1])[1], "alternative"):
                    self.expression(c.test, "condition")
                    self.block(c.body, "consequence")
            if tail:
                self.clause("else_clause", tail, self.span(tail[0])[0], "alternative")

    def assignment(self, s) -> None:
        """a = b = 1 nests, the inner assignment being the outer one's right."""
        start, end = self.span(s)
        targets = s.targets if isinstance(s, ast.Assign) else [s.target]
        kind = "augmented_assignment" if isinstance(s, ast.AugAssign) else "assignment"

        def nested(rest: list, field: str | None) -> None:
            with self.tree.node(kind, self.span(rest[0])[0], end, field):
                self.expression(rest[0], "left")
                if isinstance(s, ast.AnnAssign):
                    with self.tree.node("type", *self.span(s.annotation), "type"):
                        self.expression(s.annotation)
                if len(rest) > 1:
                    nested(rest[1:], "right")
                elif s.value is not None:
                    self.expression(s.value, "right")

        nested(targets, None)

    def expression(self, e: ast.AST, field: str | None = None, kind: str | None = None) -> None:
        if not hasattr(e, "lineno"):
            for child in ast.iter_child_nodes(e):
                self.expression(child)
            return
        start, end = self.span(e)
        if isinstance(e, ast.Name):
            self.tree.leaf("identifier", start, end, field)
        elif isinstance(e, ast.Constant):
            value = e.value
            kind = "string" if isinstance(value, str | bytes) else "none" if value is None else str(value).lower() if isinstance(value, bool) else "integer" if isinstance(value, int) else "float"
            self.tree.leaf(kind, start, end, field)
        elif isinstance(e, ast.Attribute):
            with self.tree.node("attribute", start, end, field):
                self.expression(e.value, "object")
                self.tree.leaf("identifier", end - len(e.attr.encode()), end, "attribute")
        elif isinstance(e, ast.Call):
            with self.tree.node("call", start, end, field):
                self.expression(e.func, "function")
                with self.tree.node("argument_list", self.span(e.func)[1], end, "arguments"):
                    for a in e.args:
                        self.expression(a)
                    for k in e.keywords:
                        self.expression(k.value, "value")
        elif isinstance(e, ast.Lambda):
            with self.tree.node("lambda", start, end, field):
                self.parameters(e.args, start)
                self.expression(e.body, "body")
        else:
            with self.tree.node(kind or _snake(e), start, end, field):
                for child in ast.iter_child_nodes(e):
                    self.expression(child)


def _snake(n: ast.AST) -> str:
    return re.sub(r"(?<!^)(?=[A-Z])", "_", type(n).__name__).lower()


#: So many lines of a file may be broken; each costs a parse.
MOST_BROKEN = 200


def _mended(raw: bytes) -> tuple[ast.Module, set[int]]:
    """The module without the lines that keep it from parsing, and their numbers. Such a line gives way to a pass statement as
    far indented, or, if that doesn't help, to blanks, and last the line before it goes; every byte keeps its place."""
    lines, tried = raw.split(b"\n"), {}
    for _ in range(2 * MOST_BROKEN):
        try:
            return ast.parse(b"\n".join(lines)), set(tried)
        except SyntaxError as e:
            error, at = e, min(max(1, e.lineno or 1), len(lines))
        while at and (tried.get(at) == 2 or not lines[at - 1].strip()):
            at -= 1
        if not at:
            raise error
        line = lines[at - 1]
        indent = len(line) - len(line.lstrip())
        mark = b"pass" if at not in tried and len(line) - indent >= 4 else b""
        tried[at] = 1 if mark else 2
        lines[at - 1] = (line[:indent] + mark).ljust(len(line))
    raise error


def parse(source: str) -> list[dict]:
    """The nodes of a module. Lines that don't parse are nodes of type ERROR and no statements; SyntaxError if there are too many."""
    raw = source.encode("utf-8", "surrogatepass").removeprefix(b"\xef\xbb\xbf").replace(b"\r\n", b"\n").replace(b"\r", b"\n").replace(b"\0", b" ")
    module, broken = _mended(raw)
    walk = _Walk(raw, broken)
    with walk.tree.node("module", 0, len(raw)):
        for s in module.body:
            walk.statement(s)
        if broken and not any(r["type"] == "ERROR" for r in walk.tree.rows):
            start = walk.tree.lines[min(broken) - 1]
            walk.tree.leaf("ERROR", start, start)
    return walk.tree.rows
