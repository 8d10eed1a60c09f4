"""A small TypeScript parser: enough of the grammar to find declarations, scopes and uses of names.

Operators are not ranked, as only what an expression contains matters here.  A
statement that can't be parsed becomes an ``error`` node, and parsing goes on
after it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_WORD = re.compile(r"#?[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*")
_NUMBER = re.compile(r"0[xXbBoO][0-9a-fA-F_]+n?|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9]+)?n?")
_PUNCT = re.compile(r"\.\.\.|===|!==|\*\*=|<<=|&&=|\|\|=|\?\?=|=>|==|!=|<=|\+\+|--|&&|\|\||\?\?|\?\.(?![0-9])|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\*\*|<<|[{}()\[\];,<>+\-*/%&|^!~?:=.@#]")
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
#: After these words a slash begins a regular expression.
_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "instanceof", "yield", "await"}
_MODIFIERS = {"export", "default", "declare", "abstract", "async", "public", "private", "protected", "static", "readonly", "override", "accessor"}
_BINARY = {
    "=", "+", "-", "*", "/", "%", "&", "|", "^", "<", ">", "==", "!=", "===", "!==", "<=", "&&", "||", "??", "**", "<<", ",",
    "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "**=", "<<=", "&&=", "||=", "??=",
}
_TYPE_WORDS = {"any", "bigint", "boolean", "never", "null", "number", "object", "string", "symbol", "this", "undefined", "unknown", "void", "true", "false"}
_PREFIX_WORDS = {"typeof", "void", "delete", "await", "yield"}


class ParseError(ValueError):
    pass


@dataclass(slots=True)
class Token:
    kind: str  # word, number, string, template, regex, punct, end
    text: str
    pos: int
    line: int
    fresh: bool  # first on its line
    parts: list[list[Token]] = field(default_factory=list)
    end: int = 0


@dataclass(slots=True, eq=False)
class Node:
    kind: str
    pos: int
    line: int
    name: str | None = None
    text: str | None = None
    kids: list[Node] = field(default_factory=list)
    flags: frozenset[str] = frozenset()
    parent: Node | None = None
    extra: dict = field(default_factory=dict)
    end: int = 0

    def walk(self):
        yield self
        for k in self.kids:
            yield from k.walk()


def tokenize(src: str, at: int = 0, line: int = 1, inside: bool = False) -> tuple[list[Token], int, int]:
    """Tokens up to the end, or up to the brace that closes a template's expression."""
    out: list[Token] = []
    depth, fresh, n = 0, True, len(src)

    def put(kind: str, text: str, to: int, parts: list[list[Token]] | None = None) -> None:
        nonlocal at, line, fresh
        out.append(Token(kind, text, at, line, fresh, parts or [], to))
        line += src.count("\n", at, to)
        at, fresh = to, False

    while at < n:
        c = src[at]
        if c == "\n":
            at, line, fresh = at + 1, line + 1, True
        elif c.isspace() or c == "﻿":
            at += 1
        elif src.startswith("//", at) or src.startswith("#!", at):
            to = src.find("\n", at)
            at = n if to < 0 else to
        elif src.startswith("/*", at):
            to = src.find("*/", at + 2)
            to = n if to < 0 else to + 2
            if "\n" in src[at:to]:
                fresh = True
            line += src.count("\n", at, to)
            at = to
        elif c in "\"'":
            to = at + 1
            while to < n and src[to] != c and src[to] != "\n":
                to += 2 if src[to] == "\\" else 1
            put("string", src[at : min(to + 1, n)], min(to + 1, n))
        elif c == "`":
            to, ln, parts = at + 1, line, []
            while to < n and src[to] != "`":
                if src[to] == "\\":
                    to += 2
                elif src.startswith("${", to):
                    toks, to, _ = tokenize(src, to + 2, ln + src.count("\n", at, to), True)
                    parts.append(toks)
                else:
                    to += 1
            put("template", src[at : min(to + 1, n)], min(to + 1, n), parts)
        elif m := _WORD.match(src, at):
            put("word", m[0], m.end())
        elif (c.isdigit() or c == ".") and (m := _NUMBER.match(src, at)) and (c != "." or m.end() > at + 1):
            put("number", m[0], m.end())
        elif c == "/" and _starts_regex(out) and (m := _REGEX.match(src, at)):
            put("regex", m[0], m.end())
        elif m := _PUNCT.match(src, at):
            if inside:
                depth += (m[0] == "{") - (m[0] == "}")
                if depth < 0:
                    out.append(Token("end", "", at, line, fresh))
                    return out, at + 1, line
            put("punct", m[0], m.end())
        else:
            at += 1
    out.append(Token("end", "", n, line, True))
    return out, n, line


def _starts_regex(out: list[Token]) -> bool:
    if not out:
        return True
    t = out[-1]
    return t.text in _BEFORE_REGEX if t.kind == "word" else t.kind == "punct" and t.text not in (")", "]", "}", "++", "--")


class Parser:
    def __init__(self, src: str, jsx: bool = False, tokens: list[Token] | None = None):
        self.src, self.jsx = src, jsx
        self.toks = tokens if tokens is not None else tokenize(src)[0]
        self.i = 0

    # ------------------------------------------------------------- primitives

    @property
    def t(self) -> Token:
        return self.toks[self.i]

    def ahead(self, k: int = 1) -> Token:
        return self.toks[min(self.i + k, len(self.toks) - 1)]

    def at(self, *texts: str) -> bool:
        return self.t.text in texts and self.t.kind in ("word", "punct")

    def eat(self, *texts: str) -> bool:
        if self.at(*texts):
            self.i += 1
            return True
        return False

    def need(self, text: str) -> Token:
        if not self.at(text):
            raise ParseError(f"line {self.t.line}: expected {text!r}, found {self.t.text!r}")
        self.i += 1
        return self.toks[self.i - 1]

    def word(self) -> Token:
        if self.t.kind != "word":
            raise ParseError(f"line {self.t.line}: expected a name, found {self.t.text!r}")
        self.i += 1
        return self.toks[self.i - 1]

    def node(self, kind: str, start: Token | None = None, **kw) -> Node:
        s = start or self.t
        return Node(kind, s.pos, s.line, **kw)

    def done(self, n: Node) -> Node:
        n.end = self.toks[self.i - 1].end if self.i else n.pos
        return n

    def end_statement(self) -> None:
        if not self.eat(";") and not self.at("}") and self.t.kind != "end" and not self.t.fresh:
            raise ParseError(f"line {self.t.line}: unexpected {self.t.text!r}")

    # ------------------------------------------------------------- statements

    def file(self) -> Node:
        root = self.node("file")
        while self.t.kind != "end":
            root.kids.append(self.safe_statement())
        for n in root.walk():
            for k in n.kids:
                k.parent = n
        return root

    def safe_statement(self) -> Node:
        start = self.i
        try:
            return self.statement()
        except (ParseError, IndexError, RecursionError) as e:
            bad = self.node("error", self.toks[start], text=str(e))
            self.i, depth = start + 1, 0
            while self.t.kind != "end":
                if depth <= 0 and self.t.fresh and self.t.pos > bad.pos and (self.t.text in _MODIFIERS or self.t.text in ("const", "let", "var", "function", "class", "interface", "type", "import", "enum", "if", "for", "return", "}")):
                    break
                depth += (self.t.text in ("{", "(", "[")) - (self.t.text in ("}", ")", "]"))
                if depth < 0 and self.t.text == "}":
                    break
                self.i += 1
            if self.i == start + 1 and self.at("}"):
                self.i += 1
            return bad

    def block(self, kind: str = "block") -> Node:
        n = self.node(kind)
        self.need("{")
        while not self.at("}"):
            if self.t.kind == "end":
                raise ParseError("unclosed block")
            n.kids.append(self.safe_statement())
        self.need("}")
        return self.done(n)

    def statement(self) -> Node:
        t = self.t
        if self.at("{"):
            return self.block()
        if self.eat(";"):
            return self.node("empty", t)
        if self.at("@"):
            decorators = self.decorators()
            n = self.statement()
            n.kids[:0] = decorators
            return n
        if t.kind != "word":
            return self.expression_statement()
        if t.text == "import" and self.ahead().text not in ("(", "."):
            return self.import_()
        if t.text == "export":
            return self.export()
        return self.declaration(frozenset()) or self.control() or self.expression_statement()

    def decorators(self) -> list[Node]:
        out = []
        while self.eat("@"):
            out.append(self.unary())
        return out

    def expression_statement(self) -> Node:
        n = self.node("expressionstatement")
        n.kids.append(self.expression())
        self.end_statement()
        return n

    def declaration(self, flags: frozenset[str]) -> Node | None:
        """A declaration here, after modifiers; None if there is none."""
        t, a = self.t, self.ahead()
        if t.kind != "word":
            return None
        if t.text in ("declare", "abstract", "async") and a.kind == "word" and not a.fresh and (t.text != "async" or a.text == "function"):
            if t.text == "declare" and a.text == "global":
                self.i += 2
                return self.module_body(self.node("moduledeclaration", t, name="global"))
            self.i += 1
            return self.declaration(flags | {t.text})
        if t.text == "function":
            return self.function(flags)
        if t.text == "class":
            return self.class_("class", flags)
        if t.text == "interface" and a.kind == "word":
            return self.interface(flags)
        if t.text == "type" and a.kind == "word" and not a.fresh and self.ahead(2).text in ("=", "<"):
            return self.alias(flags)
        if t.text == "enum" or (t.text == "const" and a.text == "enum"):
            self.eat("const")
            return self.enum(flags)
        if t.text in ("namespace", "module") and (a.kind in ("word", "string")) and not a.fresh and self.ahead(2).text in ("{", "."):
            self.i += 1
            n = self.node("moduledeclaration", t, name=a.text.strip("\"'"), flags=flags)
            self.i += 1
            while self.eat("."):
                n.name += "." + self.word().text
            return self.module_body(n)
        if t.text in ("const", "let", "var") and (a.kind == "word" or a.text in ("{", "[")):
            n = self.variables(flags)
            self.end_statement()
            return n
        return None

    def module_body(self, n: Node) -> Node:
        n.kids.append(self.block("moduleblock"))
        return self.done(n)

    def variables(self, flags: frozenset[str]) -> Node:
        n = self.node("variablestatement", flags=flags)
        self.i += 1
        while True:
            v = self.node("variable", flags=flags)
            self.binding(v)
            self.eat("!")
            if self.eat(":"):
                v.kids.append(self.type())
            if self.eat("="):
                init = self.assignment()
                v.extra["init"] = init
                v.kids.append(init)
            n.kids.append(self.done(v))
            if not self.eat(","):
                return self.done(n)

    def binding(self, n: Node) -> None:
        """A name, or a pattern whose elements become binding nodes below ``n``."""
        if self.at("{", "["):
            close = "}" if self.t.text == "{" else "]"
            self.i += 1
            while not self.eat(close):
                if self.eat(","):
                    continue
                b = self.node("bindingelement")
                self.eat("...")
                if close == "}":
                    key = self.t
                    if self.at("["):
                        self.need("[")
                        b.kids.append(self.assignment())
                        self.need("]")
                    else:
                        self.i += 1
                    if self.eat(":"):
                        self.binding(b)
                    else:
                        b.name = key.text
                else:
                    self.binding(b)
                if self.eat("="):
                    b.kids.append(self.assignment())
                n.kids.append(self.done(b))
        else:
            n.name = self.word().text

    def control(self) -> Node | None:
        t = self.t
        n = self.node(t.text + "statement")
        if t.text in ("if", "while", "with"):
            self.i += 1
            self.need("(")
            n.kids.append(self.expression())
            self.need(")")
            n.kids.append(self.statement())
            if t.text == "if" and self.eat("else"):
                n.kids.append(self.statement())
        elif t.text == "do":
            self.i += 1
            n.kids.append(self.statement())
            self.need("while")
            self.need("(")
            n.kids.append(self.expression())
            self.need(")")
            self.eat(";")
        elif t.text == "for":
            self.i += 1
            self.eat("await")
            self.need("(")
            if self.at("const", "let", "var"):
                n.kids.append(self.for_variables())
            elif not self.at(";"):
                n.kids.append(self.expression(no_in=True))
            if self.eat("of", "in"):
                n.kids.append(self.expression())
            else:
                self.need(";")
                if not self.at(";"):
                    n.kids.append(self.expression())
                self.need(";")
                if not self.at(")"):
                    n.kids.append(self.expression())
            self.need(")")
            n.kids.append(self.statement())
        elif t.text == "switch":
            self.i += 1
            self.need("(")
            n.kids.append(self.expression())
            self.need(")")
            self.need("{")
            while not self.eat("}"):
                if self.eat("case"):
                    n.kids.append(self.expression())
                    self.need(":")
                elif self.at("default") and self.ahead().text == ":":
                    self.i += 2
                else:
                    n.kids.append(self.safe_statement())
                if self.t.kind == "end":
                    raise ParseError("unclosed switch")
        elif t.text == "try":
            self.i += 1
            n.kids.append(self.block())
            if self.at("catch"):
                c = self.node("catchclause")
                self.i += 1
                if self.eat("("):
                    v = self.node("variable")
                    self.binding(v)
                    if self.eat(":"):
                        v.kids.append(self.type())
                    self.need(")")
                    c.kids.append(self.done(v))
                c.kids.append(self.block())
                n.kids.append(self.done(c))
            if self.eat("finally"):
                n.kids.append(self.block())
        elif t.text in ("return", "throw"):
            self.i += 1
            if not self.t.fresh and not self.at(";", "}") and self.t.kind != "end":
                n.kids.append(self.expression())
            self.end_statement()
        elif t.text in ("break", "continue"):
            self.i += 1
            if self.t.kind == "word" and not self.t.fresh:
                self.i += 1
            self.end_statement()
        elif t.text == "debugger":
            self.i += 1
            self.end_statement()
        elif self.ahead().text == ":" and self.ahead().kind == "punct":
            self.i += 2
            n.kind = "labeledstatement"
            n.kids.append(self.statement())
        else:
            return None
        return self.done(n)

    def for_variables(self) -> Node:
        n = self.node("variablestatement")
        self.i += 1
        while True:
            v = self.node("variable")
            self.binding(v)
            if self.eat(":"):
                v.kids.append(self.type())
            if self.eat("="):
                v.extra["init"] = self.assignment(no_in=True)
                v.kids.append(v.extra["init"])
            n.kids.append(self.done(v))
            if not self.eat(","):
                return self.done(n)

    # -------------------------------------------------------- imports, exports

    def import_(self) -> Node:
        n = self.node("import")
        self.i += 1
        names: list[tuple[str, str, str]] = []  # local, imported, form
        kind = ""
        if self.at("type") and self.ahead().text not in ("from", ",", "=") or self.at("type") and self.ahead().text == "from" and self.ahead(2).text == "from":
            self.i += 1
            kind = "type-"
        if self.t.kind == "string":
            pass
        else:
            if self.t.kind == "word" and self.ahead().text == "=":
                local = self.word().text
                self.i += 1
                n.kind, n.name = "importequals", local
                n.kids.append(self.expression())
                self.end_statement()
                return self.done(n)
            if self.t.kind == "word":
                local = self.word().text
                names.append((local, "default", kind + "default"))
                self.eat(",")
            if self.eat("*"):
                self.need("as")
                local = self.word().text
                names.append((local, "*", kind + "namespace"))
            elif self.at("{"):
                names += self.specifiers(kind)
            self.need("from")
        n.text = self.t.text.strip("\"'")
        self.i += 1
        if self.eat("with", "assert"):
            self.object()
        self.end_statement()
        n.extra["names"] = names
        return self.done(n)

    def specifiers(self, kind: str) -> list[tuple[str, str, str]]:
        out = []
        self.need("{")
        while not self.eat("}"):
            if self.eat(","):
                continue
            k = kind
            if self.at("type") and self.ahead().kind in ("word", "string") and self.ahead().text != "as":
                self.i += 1
                k = "type-"
            name = self.t.text.strip("\"'")
            self.i += 1
            local = name
            if self.eat("as"):
                local = self.t.text.strip("\"'")
                self.i += 1
            out.append((local, name, k + "named"))
        return out

    def export(self) -> Node:
        t = self.t
        n = self.node("export", t)
        self.i += 1
        if self.eat("="):
            n.kind = "exportassignment"
            n.kids.append(self.expression())
            self.end_statement()
            return self.done(n)
        if self.at("as") and self.ahead().text == "namespace":
            self.i += 3
            self.end_statement()
            return n
        if self.at("type") and self.ahead().text in ("{", "*"):
            self.i += 1
        if self.eat("*"):
            n.extra["star"] = True
            if self.eat("as"):
                n.name = self.t.text.strip("\"'")
                self.i += 1
            self.need("from")
            n.text = self.t.text.strip("\"'")
            self.i += 1
            self.end_statement()
            return self.done(n)
        if self.at("{"):
            n.extra["names"] = self.specifiers("")
            if self.eat("from"):
                n.text = self.t.text.strip("\"'")
                self.i += 1
            self.end_statement()
            return self.done(n)
        decorators = self.decorators()
        flags = frozenset({"export"})
        if self.eat("default"):
            flags |= {"default"}
            if self.at("function", "class", "interface", "abstract") or self.at("async") and self.ahead().text == "function":
                d = self.declaration(flags)
                d.kids[:0] = decorators
                return d
            n.kind = "exportassignment"
            n.kids.append(self.assignment())
            self.end_statement()
            return self.done(n)
        d = self.declaration(flags)
        if d is None:
            if self.at("import"):
                return self.import_()
            raise ParseError(f"line {self.t.line}: export of {self.t.text!r}")
        d.kids[:0] = decorators
        return d

    # ------------------------------------------------- functions, classes, types

    def function(self, flags: frozenset[str], kind: str = "function") -> Node:
        n = self.node(kind, flags=flags)
        self.eat("async")
        self.need("function")
        self.eat("*")
        if self.t.kind == "word":
            n.name = self.word().text
        self.signature(n)
        self.body(n)
        return self.done(n)

    def signature(self, n: Node) -> None:
        self.type_parameters(n)
        self.need("(")
        while not self.eat(")"):
            if self.eat(","):
                continue
            p = self.node("parameter")
            p.kids += self.decorators()
            mods = set()
            while self.t.text in ("public", "private", "protected", "readonly", "override") and self.ahead().kind == "word" or self.t.text in ("public", "private", "protected", "readonly") and self.ahead().text in ("{", "["):
                mods.add(self.t.text)
                self.i += 1
            p.flags = frozenset(mods)
            self.eat("...")
            self.binding(p)
            self.eat("?")
            if self.eat(":"):
                p.kids.append(self.type())
            if self.eat("="):
                p.kids.append(self.assignment())
            n.kids.append(self.done(p))
        if self.eat(":"):
            n.kids.append(self.return_type())

    def return_type(self) -> Node:
        t = self.t
        if self.at("asserts") and self.ahead().kind == "word" and not self.ahead().fresh:
            n = self.node("typepredicate", t)
            self.i += 2
            if self.eat("is"):
                n.kids.append(self.type())
            return n
        if t.kind == "word" and self.ahead().text == "is" and not self.ahead().fresh:
            n = self.node("typepredicate", t)
            self.i += 2
            n.kids.append(self.type())
            return n
        return self.type()

    def body(self, n: Node) -> None:
        if self.at("{"):
            n.extra["body"] = self.block("body")
            n.kids.append(n.extra["body"])
        else:
            self.end_statement()

    def type_parameters(self, n: Node) -> None:
        if not self.eat("<"):
            return
        names = n.extra.setdefault("types", [])
        while not self.eat(">"):
            if self.eat(","):
                continue
            while self.at("const", "in", "out") and self.ahead().kind == "word":
                self.i += 1
            names.append(self.word().text)
            if self.eat("extends"):
                n.kids.append(self.type())
            if self.eat("="):
                n.kids.append(self.type())

    def heritage(self, n: Node, interface: bool) -> None:
        while self.at("extends", "implements"):
            clause = self.t.text
            self.i += 1
            while True:
                h = self.node("heritage", text=clause)
                if clause == "extends" and not interface:
                    s = self.t
                    h.kids.append(self.postfix(self.primary(), calls=True, generic=False))
                    if self.at("<"):
                        h.kids += self.type_arguments()
                    h.extra["space"] = "value"
                else:
                    s = self.t
                    h.kids.append(self.type_reference())
                    h.extra["space"] = "type"
                self.done(h)
                h.name = self.src[s.pos : h.end]
                n.kids.append(h)
                if not self.eat(","):
                    break

    def class_(self, kind: str, flags: frozenset[str]) -> Node:
        n = self.node(kind, flags=flags)
        self.need("class")
        if self.t.kind == "word" and not self.at("extends", "implements"):
            n.name = self.word().text
        self.type_parameters(n)
        self.heritage(n, False)
        self.need("{")
        while not self.eat("}"):
            if self.eat(";"):
                continue
            n.kids.append(self.member())
        return self.done(n)

    def property_name(self) -> tuple[str | None, list[Node]]:
        if self.eat("["):
            e = self.assignment()
            self.need("]")
            return None, [e]
        t = self.t
        if t.kind not in ("word", "string", "number"):
            raise ParseError(f"line {t.line}: unexpected {t.text!r} in a body")
        self.i += 1
        return (t.text.strip("\"'") if t.kind == "string" else t.text), []

    def member(self) -> Node:
        start = self.t
        decorators = self.decorators()
        flags = set()
        while self.t.text in _MODIFIERS and self.t.kind == "word" and (self.ahead().kind in ("word", "string", "number") or self.ahead().text in ("[", "*", "{")) and not (self.ahead().fresh and self.t.text not in ("static", "readonly", "public", "private", "protected")):
            flags.add(self.t.text)
            self.i += 1
        if "static" in flags and self.at("{"):
            n = self.block()
            return n
        kind = "property"
        if self.at("get", "set") and (self.ahead().kind in ("word", "string", "number") or self.ahead().text == "["):
            kind = self.t.text + "accessor"
            self.i += 1
        self.eat("*")
        n = self.node(kind, start, flags=frozenset(flags))
        n.kids += decorators
        if self.at("[") and self.ahead().kind == "word" and self.ahead(2).text == ":":
            n.kind = "indexsignature"
            self.i += 3
            n.kids.append(self.type())
            self.need("]")
            self.need(":")
            n.kids.append(self.type())
            self.end_statement()
            return self.done(n)
        n.name, kids = self.property_name()
        n.kids += kids
        self.eat("?", "!")
        if self.at("(", "<"):
            if kind == "property":
                n.kind = "constructor" if n.name == "constructor" else "method"
            self.signature(n)
            self.body(n)
            return self.done(n)
        if self.eat(":"):
            n.kids.append(self.type())
        if self.eat("="):
            n.extra["init"] = self.assignment()
            n.kids.append(n.extra["init"])
        self.end_statement()
        return self.done(n)

    def interface(self, flags: frozenset[str]) -> Node:
        n = self.node("interface", flags=flags)
        self.i += 1
        n.name = self.word().text
        self.type_parameters(n)
        self.heritage(n, True)
        n.kids += self.type_members()
        return self.done(n)

    def type_members(self) -> list[Node]:
        out = []
        self.need("{")
        while not self.eat("}"):
            if self.eat(";", ","):
                continue
            out.append(self.type_member())
        return out

    def type_member(self) -> Node:
        start = self.t
        while self.at("readonly", "-", "+") and (self.ahead().kind in ("word", "string", "number") or self.ahead().text in ("[", "readonly")):
            self.i += 1
        if self.at("(", "<") or self.at("new") and self.ahead().text in ("(", "<"):
            self.eat("new")
            n = self.node("callsignature", start)
            self.signature(n)
            return self.done(n)
        if self.at("[") and self.ahead().kind == "word" and self.ahead(2).text in (":", "in"):
            n = self.node("mappedtype" if self.ahead(2).text == "in" else "indexsignature", start)
            n.extra["types"] = [self.ahead().text]
            self.i += 3
            n.kids.append(self.type())
            if self.eat("as"):
                n.kids.append(self.type())
            self.need("]")
            self.eat("-", "+")
            self.eat("?")
            if self.eat(":"):
                n.kids.append(self.type())
            return self.done(n)
        kind = "propertysignature"
        if self.at("get", "set") and (self.ahead().kind in ("word", "string") or self.ahead().text == "["):
            kind = self.t.text + "accessor"
            self.i += 1
        n = self.node(kind, start)
        n.name, kids = self.property_name()
        n.kids += kids
        self.eat("?")
        if self.at("(", "<"):
            n.kind = "methodsignature" if kind == "propertysignature" else kind
            self.signature(n)
        elif self.eat(":"):
            n.kids.append(self.type())
        return self.done(n)

    def alias(self, flags: frozenset[str]) -> Node:
        n = self.node("typealias", flags=flags)
        self.i += 1
        n.name = self.word().text
        self.type_parameters(n)
        self.need("=")
        n.kids.append(self.type())
        self.end_statement()
        return self.done(n)

    def enum(self, flags: frozenset[str]) -> Node:
        n = self.node("enum", flags=flags)
        self.need("enum")
        n.name = self.word().text
        self.need("{")
        while not self.eat("}"):
            if self.eat(","):
                continue
            m = self.node("enummember")
            m.name, kids = self.property_name()
            m.kids += kids
            if self.eat("="):
                m.kids.append(self.assignment())
            n.kids.append(self.done(m))
        return self.done(n)

    # -------------------------------------------------------------------- types

    def type(self) -> Node:
        """A type: its parts in a row, as their ranks do not matter."""
        n = self.node("type")
        self.eat("|", "&")
        while True:
            self.type_operand(n)
            if self.eat("|", "&"):
                continue
            if self.at("extends") and not self.t.fresh:
                self.i += 1
                self.type_operand(n)
                while self.eat("|", "&"):
                    self.type_operand(n)
                if self.eat("?"):
                    n.kids.append(self.type())
                    self.need(":")
                    n.kids.append(self.type())
            return self.done(n)

    def type_operand(self, n: Node) -> None:
        while self.at("keyof", "unique", "readonly", "infer") and (self.ahead().kind in ("word", "template", "string", "number") or self.ahead().text in ("{", "(", "[")) and not self.ahead().fresh:
            if self.t.text == "infer":
                n.extra.setdefault("types", []).append(self.ahead().text)
            self.i += 1
        t = self.t
        if self.at("new") or self.at("abstract") and self.ahead().text == "new" or self.at("<") or self.at("(") and self.arrow_follows():
            self.eat("abstract")
            self.eat("new")
            f = self.node("functiontype", t)
            self.type_parameters(f)
            self.signature(f)
            self.need("=>")
            f.kids.append(self.return_type())
            n.kids.append(self.done(f))
        elif self.eat("("):
            n.kids.append(self.type())
            self.need(")")
        elif self.at("{"):
            lit = self.node("typeliteral")
            lit.kids += self.type_members()
            n.kids.append(self.done(lit))
        elif self.eat("["):
            while not self.eat("]"):
                if self.eat(","):
                    continue
                self.eat("...")
                if self.t.kind == "word" and (self.ahead().text == ":" or self.ahead().text == "?" and self.ahead(2).text == ":"):
                    self.i += 1
                    self.eat("?")
                    self.need(":")
                n.kids.append(self.type())
                self.eat("?")
        elif self.at("typeof"):
            self.i += 1
            if self.at("import"):
                n.kids.append(self.import_type())
            else:
                n.kids.append(self.type_reference("typequery"))
        elif self.at("import"):
            n.kids.append(self.import_type())
        elif t.kind in ("string", "number", "template") or self.at("-"):
            self.eat("-")
            lit = self.node("literal", text=self.t.text)
            for part in self.t.parts:
                lit.kids.append(Parser(self.src, self.jsx, part).type())
            self.i += 1
            n.kids.append(self.done(lit))
        elif t.kind == "word":
            n.kids.append(self.type_reference())
        else:
            raise ParseError(f"line {t.line}: unexpected {t.text!r} in a type")
        while self.at("[") and not self.t.fresh:
            self.i += 1
            if not self.at("]"):
                n.kids.append(self.type())
            self.need("]")

    def import_type(self) -> Node:
        n = self.node("importtype")
        self.need("import")
        self.need("(")
        n.text = self.t.text
        self.i += 1
        if self.eat(","):
            self.object()
        self.need(")")
        while self.eat("."):
            self.word()
        if self.at("<"):
            n.kids += self.type_arguments()
        return self.done(n)

    def type_reference(self, kind: str = "typereference") -> Node:
        n = self.node(kind)
        if self.t.text in _TYPE_WORDS and self.ahead().text != ".":
            n.kids.append(self.node("keyword", text=self.word().text))
            return self.done(n)
        left = self.node("identifier", name=self.word().text)
        left.end = self.toks[self.i - 1].end
        left.pos = self.toks[self.i - 1].pos
        while self.at(".") and self.ahead().kind == "word":
            self.i += 1
            q = self.node("qualifiedname", kids=[left])
            q.pos, q.line, q.name = left.pos, self.t.line, self.word().text
            left = self.done(q)
        n.kids.append(left)
        if self.at("<") and not self.t.fresh:
            n.kids += self.type_arguments()
        return self.done(n)

    def type_arguments(self) -> list[Node]:
        out = []
        self.need("<")
        while not self.eat(">"):
            if self.eat(","):
                continue
            out.append(self.type())
        return out

    # -------------------------------------------------------------- expressions

    def expression(self, no_in: bool = False) -> Node:
        first = self.assignment(no_in)
        if not self.at(","):
            return first
        n = self.node("sequence", kids=[first])
        n.pos, n.line = first.pos, first.line
        while self.eat(","):
            n.kids.append(self.assignment(no_in))
        return self.done(n)

    def assignment(self, no_in: bool = False) -> Node:
        """An expression without commas: operands and operators in a row."""
        if f := self.arrow():
            return f
        first = self.unary()
        parts, text = [first], []
        while True:
            if self.at("?") and self.t.kind == "punct":
                self.i += 1
                parts.append(self.assignment())
                self.need(":")
                parts.append(self.assignment(no_in))
                text.append("?")
            elif self.at("as", "satisfies") and not self.t.fresh:
                self.i += 1
                if self.at("const"):
                    self.i += 1
                else:
                    parts.append(self.type())
            elif self.at("instanceof") or (self.at("in") and not no_in):
                text.append(self.t.text)
                self.i += 1
                parts.append(self.unary())
            elif self.t.kind == "punct" and self.t.text in _BINARY and self.t.text != ",":
                op = self.t
                self.i += 1
                while op.text == ">" and self.at(">", "=", "==", "===") and self.t.pos == self.toks[self.i - 1].end:
                    self.i += 1
                text.append(op.text)
                parts.append(self.arrow() or self.unary())
            elif self.at("!") and not self.t.fresh:
                self.i += 1
            else:
                break
        if len(parts) == 1 and not text:
            return first
        n = Node("operation", first.pos, first.line, text=" ".join(text), kids=parts)
        return self.done(n)

    def arrow_follows(self) -> bool:
        """Whether the parenthesis here closes before an arrow (perhaps after a return type)."""
        depth, k = 0, self.i
        while k < len(self.toks):
            x = self.toks[k].text if self.toks[k].kind == "punct" else ""
            depth += (x in ("(", "[", "{")) - (x in (")", "]", "}"))
            if depth == 0:
                break
            if self.toks[k].kind == "end":
                return False
            k += 1
        nxt = self.toks[min(k + 1, len(self.toks) - 1)]
        if nxt.text == "=>":
            return True
        if nxt.text != ":":
            return False
        save = self.i
        try:
            self.i = k + 2
            self.return_type()
            return self.at("=>")
        except ParseError:
            return False
        finally:
            self.i = save

    def arrow(self) -> Node | None:
        t, save = self.t, self.i
        is_async = self.at("async") and not self.ahead().fresh and (self.ahead().kind == "word" and self.ahead(2).text == "=>" or self.ahead().text in ("(", "<"))
        if is_async:
            self.i += 1
        n = self.node("arrowfunction", t)
        if self.t.kind == "word" and self.ahead().text == "=>":
            p = self.node("parameter")
            p.name = self.word().text
            n.kids.append(self.done(p))
        elif self.at("(") and self.arrow_follows():
            self.signature(n)
        elif self.at("<") and not (self.jsx and self.ahead(2).text not in (",", "extends")):
            try:
                self.signature(n)
            except ParseError:
                self.i = save
                return None
        else:
            self.i = save
            return None
        if not self.at("=>"):
            self.i = save
            return None
        self.i += 1
        if self.at("{"):
            n.extra["body"] = self.block("body")
            n.kids.append(n.extra["body"])
        else:
            n.extra["body"] = self.assignment()
            n.kids.append(n.extra["body"])
        return self.done(n)

    def unary(self) -> Node:
        t = self.t
        if t.kind == "punct" and t.text in ("!", "~", "+", "-", "++", "--", "..."):
            self.i += 1
            n = self.node("unary", t, text=t.text)
            n.kids.append(self.arrow() or self.unary())
            return self.done(n)
        if t.kind == "word" and t.text in _PREFIX_WORDS and self.ahead().text not in (")", ",", "=", ".", ":", ";", "]", "}", "=>"):
            self.i += 1
            n = self.node("unary", t, text=t.text)
            if not (t.text == "yield" and self.t.fresh):
                self.eat("*")
                n.kids.append(self.arrow() or self.unary())
            return self.done(n)
        if self.at("<") and not self.jsx:
            save = self.i
            try:
                n = self.node("unary", t)
                n.kids += self.type_arguments()
                n.kids.append(self.unary())
                return self.done(n)
            except ParseError:
                self.i = save
        e = self.postfix(self.primary())
        if self.at("++", "--") and not self.t.fresh:
            self.i += 1
        return e

    def postfix(self, e: Node, calls: bool = True, generic: bool = True) -> Node:
        while True:
            t = self.t
            if self.at(".", "?.") and (self.ahead().kind == "word" or t.text == "?."):
                self.i += 1
                if self.at("("):
                    e = self.call(e)
                elif self.eat("["):
                    n = Node("elementaccess", e.pos, e.line, kids=[e, self.expression()])
                    self.need("]")
                    e = self.done(n)
                else:
                    n = Node("propertyaccess", e.pos, self.t.line, name=self.word().text, kids=[e])
                    e = self.done(n)
            elif self.at("["):
                if t.fresh and e.kind in ("arrowfunction",):
                    return e
                self.i += 1
                n = Node("elementaccess", e.pos, e.line, kids=[e, self.expression()])
                self.need("]")
                e = self.done(n)
            elif self.at("(") and calls:
                e = self.call(e)
            elif t.kind == "template":
                n = Node("tagged", e.pos, e.line, kids=[e, self.primary()])
                e = self.done(n)
            elif self.at("!") and not t.fresh and self.ahead().text != "=" and (self.ahead().kind == "punct" or self.ahead().fresh):
                self.i += 1
            elif self.at("<") and generic and (calls or True):
                save = self.i
                try:
                    args = self.type_arguments()
                    if not (self.at("(") or self.t.kind == "template" or (self.t.kind == "punct" and self.t.text in (")", "]", ",", ";", ":", "}", ".", "?."))):
                        raise ParseError("not type arguments")
                except ParseError:
                    self.i = save
                    return e
                if self.at("(") and calls:
                    e = self.call(e)
                    e.kids += args
                else:
                    n = Node("instantiation", e.pos, e.line, kids=[e, *args])
                    e = self.done(n)
                    if not calls:
                        return e
            else:
                return e

    def call(self, callee: Node) -> Node:
        n = Node("call", callee.pos, callee.line, kids=[callee])
        n.extra["callee"] = callee
        n.kids += self.arguments()
        return self.done(n)

    def arguments(self) -> list[Node]:
        out = []
        self.need("(")
        while not self.eat(")"):
            if self.eat(","):
                continue
            out.append(self.assignment())
        return out

    def primary(self) -> Node:
        t = self.t
        if t.kind in ("string", "number", "regex"):
            self.i += 1
            return self.done(self.node("literal", t, text=t.text))
        if t.kind == "template":
            n = self.node("template", t, text=re.sub(r"\$\{[^}]*\}", "${}", t.text))
            self.i += 1
            for part in t.parts:
                sub = Parser(self.src, self.jsx, part)
                n.kids.append(sub.expression())
            return self.done(n)
        if self.at("("):
            self.i += 1
            n = self.node("parenthesized", t, kids=[self.expression()])
            self.need(")")
            return self.done(n)
        if self.at("["):
            n = self.node("array", t)
            self.i += 1
            while not self.eat("]"):
                if self.eat(","):
                    continue
                n.kids.append(self.assignment())
            return self.done(n)
        if self.at("{"):
            return self.object()
        if self.at("<") and self.jsx:
            return self.element()
        if t.kind != "word":
            raise ParseError(f"line {t.line}: unexpected {t.text!r}")
        if t.text == "function" or t.text == "async" and self.ahead().text == "function" and not self.ahead().fresh:
            return self.function(frozenset(), "functionexpression")
        if t.text == "class":
            return self.class_("classexpression", frozenset())
        if t.text == "new":
            self.i += 1
            if self.at("."):
                self.i += 2
                return self.done(self.node("metaproperty", t))
            n = self.node("new", t)
            callee = self.postfix(self.primary(), calls=False)
            n.extra["callee"] = callee.kids[0] if callee.kind == "instantiation" else callee
            n.kids.append(callee)
            if self.at("("):
                n.kids += self.arguments()
            return self.done(n)
        self.i += 1
        if t.text in ("this", "super", "null", "true", "false", "import"):
            return self.done(self.node("keyword", t, text=t.text))
        return self.done(self.node("identifier", t, name=t.text))

    def object(self) -> Node:
        n = self.node("objectliteral")
        self.need("{")
        while not self.eat("}"):
            if self.eat(","):
                continue
            start = self.t
            if self.eat("..."):
                n.kids.append(self.assignment())
                continue
            accessor = None
            if self.at("async") and (self.ahead().kind in ("word", "string") or self.ahead().text in ("*", "[")) and self.ahead().text not in (":", ",", "(", "}"):
                self.i += 1
            if self.at("get", "set") and (self.ahead().kind in ("word", "string", "number") or self.ahead().text == "["):
                accessor = self.t.text
                self.i += 1
            self.eat("*")
            plain = self.t.kind == "word"
            m = self.node("propertyassignment", start)
            m.name, kids = self.property_name()
            m.kids += kids
            if self.at("(", "<"):
                m.kind = f"{accessor}accessor" if accessor else "method"
                self.signature(m)
                m.extra["body"] = self.block("body")
                m.kids.append(m.extra["body"])
            elif self.eat(":"):
                m.extra["init"] = self.assignment()
                m.kids.append(m.extra["init"])
            elif plain:
                m.kind = "shorthand"
                if self.eat("="):
                    m.kids.append(self.assignment())
            else:
                raise ParseError(f"line {self.t.line}: unexpected {self.t.text!r} in an object")
            n.kids.append(self.done(m))
        return self.done(n)

    def element(self) -> Node:
        """A JSX element; text between tags is skipped token by token."""
        n = self.node("jsx")
        self.need("<")
        if not self.at(">"):
            tag = self.node("identifier", name=self.word().text)
            tag.pos = self.toks[self.i - 1].pos
            while self.eat("."):
                tag = Node("propertyaccess", tag.pos, self.t.line, name=self.word().text, kids=[tag])
            while self.eat("-", ":"):
                tag.name = f"{tag.name}-{self.word().text}"
            tag.extra["jsx"] = True
            n.kids.append(self.done(tag))
            while not self.at(">", "/"):
                if self.eat("{"):
                    self.eat("...")
                    n.kids.append(self.expression())
                    self.need("}")
                    continue
                self.word()
                while self.eat("-", ":"):
                    self.word()
                if self.eat("="):
                    if self.eat("{"):
                        n.kids.append(self.expression())
                        self.need("}")
                    else:
                        self.i += 1
            if self.eat("/"):
                self.need(">")
                return self.done(n)
        self.need(">")
        while not (self.at("<") and self.ahead().text == "/"):
            if self.t.kind == "end":
                raise ParseError("unclosed element")
            if self.at("<"):
                n.kids.append(self.element())
            elif self.eat("{"):
                if not self.at("}"):
                    self.eat("...")
                    n.kids.append(self.expression())
                self.need("}")
            else:
                self.i += 1
        self.i += 2
        while not self.eat(">"):
            self.i += 1
        return self.done(n)


def parse(text: str, path: str = "") -> Node:
    return Parser(text, path.endswith(("x",))).file()
