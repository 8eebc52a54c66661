"""PHP, JavaScript, TypeScript and Go to nodes: a tokenizer and a statement parser for languages with braces.

It gives the kinds that the metrics read: functions, classes and their members, parameters, statements, clauses, calls,
assignments, imports. Expressions are not parsed in full: inside one, only calls, assignments, functions, names and
what they hold become nodes.
"""

from __future__ import annotations

import re

from gristmill.sources.parsers.tree import Tree

_TOKEN = re.compile(
    rb"""(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z)|\#(?!\[)[^\n]*)|(?P<string>"(?:\\.|[^"\\])*"?|'(?:\\.|[^'\\])*'?|`(?:\\.|[^`\\])*`?)"""
    rb"""|(?P<number>\d[\w.]*)|(?P<name>[$@\#]?[A-Za-z_\x80-\xff][\w\x80-\xff]*|\$)"""
    rb"""|(?P<op>=>|\?->|->|::|\.\.\.|===|!==|==|!=|<=|>=|&&|\|\||\?\?=|\?\?|\?\.|:=|<-|\+\+|--|[-+*/%&|^.]=|<<=|>>=|.)""",
    re.S,
)
_ASSIGN = {b"=", b"+=", b"-=", b"*=", b"/=", b"%=", b".=", b"&=", b"|=", b"^=", b"??=", b"<<=", b">>="}
_OPEN, _CLOSE = {b"(": b")", b"[": b"]", b"{": b"}"}, {b")", b"]", b"}"}
_MODIFIERS = {b"public", b"private", b"protected", b"static", b"abstract", b"final", b"readonly", b"export", b"default", b"async", b"declare", b"override", b"get", b"set", b"var", b"const"}
_NO_CALL = {b"if", b"for", b"while", b"switch", b"catch", b"return", b"function", b"func", b"foreach", b"elseif", b"match", b"array", b"list", b"isset", b"unset", b"empty", b"typeof", b"case", b"in", b"of", b"else", b"do", b"fn", b"throw", b"await", b"yield", b"echo", b"range", b"go", b"defer", b"use"}
_PHP_NAMES = {"function_declaration": "function_definition", "method_definition": "method_declaration"}


class _Parser:
    def __init__(self, lang: str, source: bytes):
        self.lang, self.tree = lang, Tree(source)
        self.php, self.go = lang == "php", lang == "go"
        self.script = not (self.php or self.go)
        self.tokens: list[tuple[str, bytes, int, int]] = []
        at = 0
        if self.php:
            m = re.search(rb"<\?(?:php|=)?", source)
            at = m.end() if m else len(source)
        last = b""
        while at < len(source):
            if self.script and source[at : at + 1] == b"/" and source[at : at + 2] not in (b"//", b"/*") and (not last or last in b"(,=:[!&|?{};+-*%<>~^" or last in (b"return", b"=>", b"&&", b"||")):
                if m := re.compile(rb"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*").match(source, at):
                    self.tokens.append(("string", m.group(), at, m.end()))
                    at, last = m.end(), b"/x/"
                    continue
            m = _TOKEN.match(source, at)
            kind, text = m.lastgroup, m.group()
            if kind == "comment" and text[:1] == b"#" and not self.php:
                m = re.compile(rb"#\w*").match(source, at)
                kind, text = "name", m.group()
            if self.php and source[at : at + 2] == b"?>":
                m2 = re.search(rb"<\?(?:php|=)?", source[at:])
                at = at + m2.end() if m2 else len(source)
                continue
            if kind == "space":
                # Go ends statements at line ends after these
                if self.go and b"\n" in text and self.tokens and (self.tokens[-1][0] in ("name", "number", "string") and self.tokens[-1][1] not in (b"if", b"for", b"func", b"switch", b"else", b"var", b"const", b"type", b"import", b"package", b"case", b"default", b"go", b"defer", b"range", b"select", b"interface", b"struct", b"map", b"chan") or self.tokens[-1][1] in (b")", b"]", b"}", b"++", b"--")):
                    self.tokens.append(("op", b";", at, at))
            elif kind != "comment":
                self.tokens.append((kind, text, m.start(), m.end()))
                last = text
            at = m.end()
        self.i = 0
        # where each bracket closes
        self.match: dict[int, int] = {}
        stack: list[int] = []
        for k, (kind, text, _, _) in enumerate(self.tokens):
            if kind == "op" and text in _OPEN:
                stack.append(k)
            elif kind == "op" and text in _CLOSE and stack and _OPEN[self.tokens[stack[-1]][1]] == text:
                self.match[stack.pop()] = k
        for k in stack:
            self.match[k] = len(self.tokens)

    # -- looking --
    def text(self, k: int | None = None) -> bytes:
        k = self.i if k is None else k
        return self.tokens[k][1] if 0 <= k < len(self.tokens) else b""

    def kind(self, k: int | None = None) -> str:
        k = self.i if k is None else k
        return self.tokens[k][0] if 0 <= k < len(self.tokens) else "end"

    def start(self, k: int) -> int:
        return self.tokens[k][2] if k < len(self.tokens) else len(self.tree.source)

    def end(self, k: int) -> int:
        return self.tokens[min(k, len(self.tokens) - 1)][3] if self.tokens else 0

    def close(self, k: int) -> int:
        return min(self.match.get(k, k), len(self.tokens))

    def until(self, k: int, stop: int, ends: set[bytes]) -> int:
        """The first token from k on, outside brackets, that is one of ends."""
        while k < stop and self.text(k) not in ends:
            k = self.close(k) + 1 if self.text(k) in _OPEN and self.kind(k) == "op" else k + 1
        return min(k, stop)

    def newline_between(self, a: int, b: int) -> bool:
        return b"\n" in self.tree.source[self.end(a) : self.start(b)]

    # -- statements --
    def program(self) -> list[dict]:
        root = {"php": "program", "go": "source_file"}.get(self.lang, "program")
        with self.tree.node(root, 0, len(self.tree.source)):
            self.statements(0, len(self.tokens))
        return self.tree.rows

    def statements(self, k: int, stop: int) -> None:
        while k < stop:
            k = max(k + 1, self.statement(k, stop))

    def block(self, k: int, field: str | None = "body", kind: str = "statement_block") -> int:
        """A braced block at k, or one statement; the token after it."""
        if self.text(k) == b"{":
            end = self.close(k)
            with self.tree.node({"php": "compound_statement", "go": "block"}.get(self.lang, kind), self.start(k), self.end(end), field):
                self.statements(k + 1, end)
            return end + 1
        return self.statement(k, len(self.tokens))

    def simple(self, kind: str, k: int, stop: int, first: int) -> int:
        """A statement up to ; or, in scripts, a line's end where nothing is open."""
        end = first
        while end < stop and self.text(end) not in (b";", b"}"):
            nxt = self.close(end) + 1 if self.kind(end) == "op" and self.text(end) in _OPEN else end + 1
            if self.script and nxt < stop and self.newline_between(nxt - 1, nxt) and self.ends_line(nxt - 1, nxt):
                end = nxt
                break
            end = nxt
        end = min(end, stop)
        with self.tree.node(kind, self.start(k), self.end(max(k, end - 1))):
            if kind == "return_statement" and first < end:
                self.returned(first, end)
            else:
                self.expression(first, end)
        return end + 1 if self.text(end) == b";" else max(end, k + 1)

    def ends_line(self, a: int, b: int) -> bool:
        joins = (b".", b"?.", b",", b"+", b"-", b"*", b"/", b"&&", b"||", b"?", b":", b"=", b"=>", b"(", b"[", b"??")
        return self.text(a) not in joins and self.text(b) not in (*joins, b"{", b")")

    def returned(self, first: int, end: int) -> None:
        commas = self.until(first, end, {b","}) < end
        if self.go and commas:
            with self.tree.node("expression_list", self.start(first), self.end(end - 1)):
                at = first
                while at < end:
                    to = self.until(at, end, {b","})
                    with self.tree.node("expression", self.start(at), self.end(to - 1)):
                        self.expression(at, to)
                    at = to + 1
        else:
            with self.tree.node("expression", self.start(first), self.end(end - 1)):
                self.expression(first, end)

    def statement(self, k: int, stop: int) -> int:
        first = k
        if self.kind(k) == "op" and self.text(k) == b"@" or self.kind(k) == "name" and self.text(k)[:1] == b"@" and self.script:  # decorators of what follows
            to = k + 1
            while self.text(to) == b".":
                to += 2
            to = self.close(to) + 1 if self.text(to) == b"(" else to
            self.tree.leaf("decorator", self.start(k), self.end(to - 1))
            return to
        while self.text(k) in _MODIFIERS and (self.text(k) not in (b"var", b"const", b"get", b"set", b"async", b"static") or self.text(k) in (b"async", b"static") and self.text(k + 1) in (b"function", b"fn")) and self.kind(k + 1) in ("name", "op") and self.text(k + 1) not in (b"(", b"=", b".", b";"):
            k += 1
        t = self.text(k)
        after = self.text(k + 1)
        if t == b"{":
            return self.block(k, None)
        if t == b";":
            return k + 1
        if t in (b"function", b"func") and (self.kind(k + 1) == "name" or after in (b"*", b"&") or self.go and after == b"("):
            return self.function(k, first)
        if t in (b"class", b"trait", b"enum") and self.kind(k + 1) == "name":
            return self.class_like(k, first, "class_declaration" if t != b"enum" else "enum_declaration")
        if t == b"interface" and self.kind(k + 1) == "name":
            return self.class_like(k, first, "interface_declaration")
        if self.go and t == b"type":
            return self.go_types(k)
        if t in (b"import", b"use") and after not in (b"(", b".") or self.go and t == b"import":
            return self.import_(k, stop)
        if t == b"if":
            return self.if_(k, "if_statement", stop)
        if t in (b"for", b"while", b"foreach"):
            return self.loop(k, t, stop)
        if t == b"do" and after == b"{":
            with self.tree.node("do_statement", self.start(k), self.end(self.close(k + 1))):
                to = self.block(k + 1)
            return self.until(to, stop, {b";", b"}"}) + 1 if self.text(to) == b"while" else to
        if t in (b"switch", b"select"):
            return self.switch(k, stop)
        if t == b"try":
            return self.try_(k)
        kinds = {b"return": "return_statement", b"break": "break_statement", b"continue": "continue_statement", b"throw": "throw_expression" if self.php else "throw_statement", b"echo": "echo_statement"}
        if t in kinds and self.kind(k) == "name":
            wrap = self.php and t == b"throw"
            if wrap:
                with self.tree.node("expression_statement", self.start(k), self.end(self.until(k, stop, {b";"}) - 1)):
                    return self.simple(kinds[t], k, stop, k + 1)
            return self.simple(kinds[t], k, stop, k + 1)
        if self.script and t in (b"let", b"const", b"var"):
            return self.declaration(k, stop)
        if self.go and t in (b"var", b"const", b"package"):
            return self.simple({b"var": "var_declaration", b"const": "const_declaration", b"package": "package_clause"}[t], k, stop, k + 1)
        if self.php and t == b"namespace" and self.kind(k + 1) == "name":
            to = self.until(k, stop, {b";", b"{"})
            return to + (self.text(to) == b";") if self.text(to) != b"{" else self.block(to, None)
        if self.script and t in (b"type", b"declare", b"namespace", b"module") and self.kind(k + 1) == "name":
            if t in (b"namespace", b"module") and self.text(self.until(k, stop, {b"{", b";"})) == b"{":
                return self.block(self.until(k, stop, {b"{"}), None)
            return self.simple("type_alias_declaration", k, stop, k + 1)
        if self.go and t in (b"go", b"defer"):
            return self.simple(t.decode() + "_statement", k, stop, k + 1)
        if self.go and self.until(k, self.until(k, stop, {b";"}), {b":=", *_ASSIGN}) < self.until(k, stop, {b";"}):
            short = self.text(self.until(k, self.until(k, stop, {b";"}), {b":=", *_ASSIGN})) == b":="
            return self.simple("short_var_declaration" if short else "assignment_statement", k, stop, k)
        return self.simple("expression_statement", first, stop, k)

    def declaration(self, k: int, stop: int) -> int:
        kind = "variable_declaration" if self.text(k) == b"var" else "lexical_declaration"
        begin = len(self.tree.rows)
        to = self.simple(kind, k, stop, k + 1)
        for row in self.tree.rows[begin + 1 :]:  # assignments right below are declarators
            if row["type"] == "assignment_expression" and row["parent"] == begin:
                row["type"] = "variable_declarator"
                for child in self.tree.rows[row["pre"] + 1 : row["last"] + 1]:
                    if child["parent"] == row["pre"] and child["field"] in ("left", "right"):
                        child["field"] = "name" if child["field"] == "left" else "value"
                    at = len(row["anc"])
                    child["anc_types"][at] = "variable_declarator"
        return to

    def if_(self, k: int, kind: str, stop: int) -> int:
        opened = self.text(k + 1) == b"("
        cond = (k + 2, self.close(k + 1)) if opened and not self.go else (k + 1, self.until(k + 1, stop, {b"{"}))
        with self.tree.node(kind, self.start(k), self.end(cond[1])) as row:
            self.expression(*cond)
            at = self.block(cond[1] + (opened and not self.go), "consequence")
            while self.php and (self.text(at) == b"elseif" or self.text(at) == b"else" and self.text(at + 1) == b"if"):
                j = at + (self.text(at) == b"else")
                with self.tree.node("else_if_clause", self.start(at), self.end(self.close(j + 1)), "alternative") as part:
                    self.expression(j + 2, self.close(j + 1))
                    at = self.block(self.close(j + 1) + 1)
                    self.stretch(part, at)
            if self.text(at) == b"else":
                j = at + 1
                if self.go:
                    at = self.if_(j, "if_statement", stop) if self.text(j) == b"if" else self.block(j, "alternative")
                else:
                    with self.tree.node("else_clause", self.start(at), self.end(j), "alternative") as part:
                        at = self.if_(j, "if_statement", stop) if self.text(j) == b"if" else self.block(j, None)
                        self.stretch(part, at)
            self.stretch(row, at)
        return at

    def stretch(self, row: dict, at: int) -> None:
        """A node's end becomes that of the token before `at`."""
        row["end_byte"] = max(row["end_byte"], self.end(at - 1))
        row["end_row"] = self.tree.row_of(max(0, row["end_byte"] - 1))

    def loop(self, k: int, word: bytes, stop: int) -> int:
        j = k + 1 + (self.text(k + 1) == b"await")
        opened = self.text(j) == b"(" and not self.go
        head = (j + 1, self.close(j)) if opened else (j, self.until(j, stop, {b"{"}))
        kind = {b"for": "for_statement", b"while": "while_statement", b"foreach": "foreach_statement"}[word]
        if self.script and word == b"for" and self.until(head[0], head[1], {b"of", b"in"}) < head[1]:
            kind = "for_in_statement"
        with self.tree.node(kind, self.start(k), self.end(head[1])) as row:
            self.expression(*head)
            at = self.block(head[1] + opened)
            self.stretch(row, at)
        return at

    def switch(self, k: int, stop: int) -> int:
        opened = self.text(k + 1) == b"(" and not self.go
        head = (k + 2, self.close(k + 1)) if opened else (k + 1, self.until(k + 1, stop, {b"{"}))
        brace = head[1] + opened
        end = self.close(brace)
        kind = "expression_switch_statement" if self.go else "switch_statement"
        with self.tree.node(kind, self.start(k), self.end(end)), self.tree.node("switch_block" if self.php else "switch_body", self.start(brace), self.end(end), "body"):
            self.expression(*head)
            at = brace + 1
            while at < end:
                word = self.text(at)
                to = self.until(at, end, {b":", b"=>"})
                nxt = to + 1
                while nxt < end and self.text(nxt) not in (b"case", b"default"):
                    nxt = self.close(nxt) + 1 if self.text(nxt) in _OPEN and self.kind(nxt) == "op" else nxt + 1
                name = ("case_statement" if word == b"case" else "default_statement") if self.php else ("expression_case" if word == b"case" else "default_case") if self.go else ("switch_case" if word == b"case" else "switch_default")
                with self.tree.node(name, self.start(at), self.end(nxt - 1)):
                    self.expression(at + 1, to)
                    self.statements(to + 1, nxt)
                at = max(nxt, at + 1)
        return end + 1

    def try_(self, k: int) -> int:
        with self.tree.node("try_statement", self.start(k), self.end(k)) as row:
            at = self.block(k + 1)
            while self.text(at) == b"catch":
                j = self.close(at + 1) + 1 if self.text(at + 1) == b"(" else at + 1
                with self.tree.node("catch_clause", self.start(at), self.end(self.close(j)), "handler"):
                    at = self.block(j)
            if self.text(at) == b"finally":
                with self.tree.node("finally_clause", self.start(at), self.end(self.close(at + 1)), "finalizer"):
                    at = self.block(at + 1)
            self.stretch(row, at)
        return at

    # -- definitions --
    def function(self, k: int, first: int, kind: str = "function_declaration", field: str | None = None) -> int:
        j = k + 1
        if self.go and self.text(j) == b"(":  # a receiver, or a function's literal
            kind = "method_declaration"
            j = self.close(j) + 1
        if self.text(j) == b"*":
            kind, j = "generator_function_declaration", j + 1
        while self.text(j) in (b"&", b"*"):
            j += 1
        return self.callable(first, j, _PHP_NAMES.get(kind, kind) if self.php else kind, field)

    def callable(self, first: int, name: int, kind: str, field: str | None = None) -> int:
        """From a name or, without one, the parameters on."""
        named = self.text(name) != b"("
        params = self.until(name + named, len(self.tokens), {b"(", b"{", b";"})
        brace = self.until(self.close(params) + 1, len(self.tokens), {b"{", b";", b"=>"}) if self.text(params) == b"(" else params
        if self.script and self.text(self.close(params) + 1) == b":":  # a result type may be a type literal
            if self.text(self.close(params) + 2) == b"{" and self.text(self.close(self.close(params) + 2) + 1) in (b"{", b";"):
                brace = self.close(self.close(params) + 2) + 1
        if self.go and self.text(brace) == b"{" and self.text(brace - 1) in (b"interface", b"struct"):
            brace = self.until(self.close(brace) + 1, len(self.tokens), {b"{", b";"})
        body = self.text(brace) == b"{"
        end = self.close(brace) if body else min(brace, len(self.tokens) - 1)
        with self.tree.node(kind, self.start(first), self.end(end), field):
            if named:
                self.tree.leaf("property_identifier" if kind == "method_definition" else "name" if self.php else "identifier", self.start(name), self.end(name), "name")
            self.parameters(params)
            if body:
                self.block(brace)
        return end + 1

    def parameters(self, k: int) -> None:
        if self.text(k) != b"(":
            return
        end = self.close(k)
        with self.tree.node("parameter_list" if self.go else "formal_parameters", self.start(k), self.end(end), "parameters"):
            at = k + 1
            while at < end:
                to = self.until(at, end, {b","})
                if to > at:
                    self.parameter(at, to)
                at = to + 1

    def parameter(self, at: int, to: int) -> None:
        eq = self.until(at, to, {b"="})
        a, b = self.start(at), self.end(to - 1)
        if self.php:
            kind, field = ("variadic_parameter" if any(self.text(x) == b"..." for x in range(at, to)) else "simple_parameter"), "default_value"
        elif self.lang == "typescript":
            kind, field = ("optional_parameter" if any(self.text(x) == b"?" for x in range(at, eq)) else "required_parameter"), "value"
        elif self.go:
            kind, field = "parameter_declaration", "value"
        elif eq < to:
            kind, field = "assignment_pattern", "right"
        elif self.text(at) == b"...":
            kind, field = "rest_pattern", "value"
        else:
            self.tree.leaf("identifier", a, b) if self.kind(at) == "name" else self.tree.leaf("object_pattern", a, b)
            return
        with self.tree.node(kind, a, b):
            if self.kind(at) == "name" and not self.php:
                self.tree.leaf("identifier", self.start(at), self.end(at), "pattern")
            if eq < to - 1:
                one = to - eq == 2
                word = self.text(eq + 1).lower()
                kind = "true" if word == b"true" else "false" if word == b"false" else "expression"
                if one:
                    self.tree.leaf("boolean" if self.php and kind != "expression" else kind, self.start(eq + 1), self.end(to - 1), field)
                else:
                    with self.tree.node("expression", self.start(eq + 1), b, field):
                        self.expression(eq + 1, to)

    def class_like(self, k: int, first: int, kind: str) -> int:
        brace = self.until(k, len(self.tokens), {b"{", b";"})
        end = self.close(brace)
        with self.tree.node(kind, self.start(first), self.end(end)):
            self.tree.leaf("name" if self.php else "type_identifier" if self.lang == "typescript" else "identifier", self.start(k + 1), self.end(k + 1), "name")
            with self.tree.node("declaration_list" if self.php else "class_body", self.start(brace), self.end(end), "body"):
                if kind != "interface_declaration":
                    self.members(brace + 1, end)
        return end + 1

    def members(self, at: int, end: int) -> None:
        while at < end:
            first = at
            if self.text(at) in (b"#",) and self.text(at + 1) == b"[":
                at = self.close(at + 1) + 1
                continue
            if self.script and self.text(at)[:1] == b"@":
                to = at + 1
                while self.text(to) == b".":
                    to += 2
                to = self.close(to) + 1 if self.text(to) == b"(" else to
                self.tree.leaf("decorator", self.start(at), self.end(to - 1))
                at = to
                continue
            while at < end and self.text(at) in _MODIFIERS and self.text(at + 1) not in (b"(", b"=", b";"):
                at += 1
            if self.php and self.text(at) == b"function":
                j = at + 1 + (self.text(at + 1) == b"&")
                at = self.callable(first, j, "method_declaration")
            elif self.script and (self.text(at + 1) == b"(" or self.text(at) == b"*" or self.text(at + 1) == b"<") and self.kind(at) in ("name", "string", "op") and self.text(at) not in (b";", b"}", b"["):
                at = self.callable(first, at + (self.text(at) == b"*"), "method_definition")
            else:
                stop = self.until(at, end, {b";"})
                if self.script:
                    j = at
                    while j < stop and not (j > at and self.newline_between(j - 1, j) and self.ends_line(j - 1, j)):
                        j = self.close(j) + 1 if self.text(j) in _OPEN and self.kind(j) == "op" else j + 1
                    stop = min(j, stop)
                with self.tree.node("property_declaration" if self.php else "field_definition", self.start(first), self.end(max(first, stop - 1))):
                    self.expression(at, stop)
                at = stop + (self.text(stop) == b";") if stop > at else at + 1

    def go_types(self, k: int) -> int:
        group = self.text(k + 1) == b"("
        end = self.close(k + 1) if group else self.until(k, len(self.tokens), {b";"})
        with self.tree.node("type_declaration", self.start(k), self.end(end)):
            at = k + 1 + group
            while at < end:
                to = self.until(at, end, {b";"})
                brace = self.until(at, to, {b"{"})
                with self.tree.node("type_spec", self.start(at), self.end(max(at, to - 1))):
                    self.tree.leaf("type_identifier", self.start(at), self.end(at), "name")
                    if brace < to and self.text(at + 1) in (b"struct", b"interface"):
                        self.tree.leaf("struct_type" if self.text(at + 1) == b"struct" else "interface_type", self.start(at + 1), self.end(self.close(brace)), "type")
                at = to + 1
        return end + 1

    def import_(self, k: int, stop: int) -> int:
        if self.go:
            group = self.text(k + 1) == b"("
            end = self.close(k + 1) if group else self.until(k, stop, {b";"})
            with self.tree.node("import_declaration", self.start(k), self.end(end)):
                for x in range(k + 1, min(end + 1, len(self.tokens))):
                    if self.kind(x) == "string":
                        with self.tree.node("import_spec", self.start(x), self.end(x)):
                            self.tree.leaf("interpreted_string_literal", self.start(x), self.end(x), "path")
            return end + 1
        end = self.until(k, stop, {b";"})
        if self.script:
            strings = [x for x in range(k, end) if self.kind(x) == "string"]
            end = min(end, strings[0] + 1) if strings else min(end, k + 2)
            with self.tree.node("import_statement", self.start(k), self.end(end - 1)):
                if strings:
                    self.tree.leaf("string", self.start(strings[0]), self.end(strings[0]), "source")
            return end + (self.text(end) == b";")
        with self.tree.node("namespace_use_declaration", self.start(k), self.end(max(k, end - 1))):
            at = k + 1
            while at < end:
                to = self.until(at, end, {b","})
                with self.tree.node("namespace_use_clause", self.start(at), self.end(to - 1)):
                    name = at + (self.text(at) in (b"function", b"const"))
                    stop_at = name
                    while stop_at < to and (self.kind(stop_at) == "name" or self.text(stop_at) == b"\\") and self.text(stop_at) != b"as":
                        stop_at += 1
                    if stop_at > name:
                        self.tree.leaf("namespace_name", self.start(name), self.end(stop_at - 1))
                at = to + 1
        return end + 1

    # -- expressions --
    def expression(self, k: int, stop: int) -> None:
        """Parts between commas; an assignment holds its target and what is assigned."""
        while k < stop:
            to = self.until(k, stop, {b",", b";"})
            self.part(k, to)
            k = to + 1

    def part(self, k: int, to: int) -> None:
        eq = self.until(k, to, _ASSIGN)
        if k < eq < to and not (self.script and self.text(eq + 1) == b"=>") and not self.go:
            kind = "assignment_expression" if self.text(eq) == b"=" else "augmented_assignment_expression"
            with self.tree.node(kind, self.start(k), self.end(to - 1)):
                if self.kind(k) == "name" and (eq - k == 1 or self.lang == "typescript" and self.text(k + 1) == b":"):
                    self.tree.leaf("variable_name" if self.php else "identifier", self.start(k), self.end(k), "left")
                else:
                    with self.tree.node("pattern", self.start(k), self.end(eq - 1), "left"):
                        self.chain(k, eq)
                with self.tree.node("expression", self.start(eq), self.end(to - 1), "right"):
                    self.part(eq + 1, to)
        else:
            self.chain(k, to)

    def chain(self, k: int, to: int) -> None:
        while k < to:
            t, kind = self.text(k), self.kind(k)
            if kind == "name" and t in (b"function", b"func", b"fn") and self.text(k + 1) in (b"(", b"*", b"&") or kind == "name" and t == b"function" and self.text(k + 2) == b"(":
                k = self.literal(k, to)
            elif self.script and (arrow := self.arrow(k, to)):
                k = arrow
            elif kind == "name" and t == b"new":
                end = self.until(k + 1, to, {b"(", b",", b";"})
                call = self.text(end) == b"("
                with self.tree.node("object_creation_expression" if self.php else "new_expression", self.start(k), self.end(self.close(end) if call else max(k, end - 1))):
                    if call:
                        self.expression(end + 1, self.close(end))
                k = self.close(end) + 1 if call else max(end, k + 1)
            elif kind == "name" and self.text(k + 1) == b"(" and t not in _NO_CALL:
                end = self.close(k + 1)
                before = self.text(k - 1)
                name = "call_expression" if not self.php else "member_call_expression" if before in (b"->", b"?->") else "scoped_call_expression" if before == b"::" else "function_call_expression"
                with self.tree.node(name, self.start(k), self.end(end)):
                    self.tree.leaf("identifier", self.start(k), self.end(k), "function")
                    with self.tree.node("arguments", self.start(k + 1), self.end(end), "arguments"):
                        self.expression(k + 2, end)
                k = end + 1
            elif kind == "op" and t in _OPEN:
                end = self.close(k)
                self.object(k + 1, end) if t == b"{" and self.script else self.statements(k + 1, end) if t == b"{" and self.php else self.expression(k + 1, end)
                k = end + 1
            else:
                if kind == "name":
                    after_dot = self.text(k - 1) in (b".", b"?.")
                    self.tree.leaf("variable_name" if self.php and t[:1] == b"$" else "property_identifier" if after_dot else "identifier", self.start(k), self.end(k))
                k += 1

    def object(self, k: int, end: int) -> None:
        """Members of an object: methods, and values of any kind."""
        while k < end:
            to = self.until(k, end, {b","})
            j = k
            while self.text(j) in (b"async", b"get", b"set", b"*") and self.text(j + 1) not in (b"(", b":", b","):
                j += 1
            if self.kind(j) in ("name", "string") and self.text(j + 1) == b"(" and self.text(self.close(j + 1) + 1) in (b"{", b":"):
                self.callable(k, j, "method_definition")
            else:
                self.chain(k, to)
            k = to + 1

    def arrow(self, k: int, to: int) -> int | None:
        j = k + (self.text(k) == b"async")
        if self.text(j) == b"(":
            sign = self.close(j) + 1
            if self.text(sign) == b":":
                sign = self.until(sign, to, {b"=>", b",", b";"})
        elif self.kind(j) == "name":
            sign = j + 1
        else:
            return None
        if sign >= to or self.text(sign) != b"=>":
            return None
        body = sign + 1
        end = self.close(body) + 1 if self.text(body) == b"{" else to
        with self.tree.node("arrow_function", self.start(k), self.end(end - 1)):
            if self.text(j) == b"(":
                self.parameters(j)
            if self.text(body) == b"{":
                self.block(body)
            else:
                with self.tree.node("expression", self.start(body), self.end(max(body, end - 1)), "body"):
                    self.part(body, end)
        return end

    def literal(self, k: int, to: int) -> int:
        """A function that is a value."""
        t, j = self.text(k), k + 1
        if t == b"fn":
            params = self.until(j, to, {b"("})
            sign = self.until(self.close(params) + 1, to, {b"=>"})
            with self.tree.node("arrow_function", self.start(k), self.end(max(k, to - 1))):
                self.parameters(params)
                with self.tree.node("expression", self.start(min(sign + 1, to - 1)), self.end(to - 1), "body"):
                    self.part(sign + 1, to)
            return to
        while self.text(j) in (b"*", b"&"):
            j += 1
        kind = "anonymous_function_creation_expression" if self.php else "func_literal" if self.go else "function_expression"
        if self.php:  # between parameters and body may stand what is taken along
            return self.callable(k, j, kind)
        return self.callable(k, j, kind)


def parse(lang: str, source: str) -> list[dict]:
    """The nodes of a file; brackets left open end with the file."""
    return _Parser(lang, source.encode("utf-8", "surrogatepass")).program()
