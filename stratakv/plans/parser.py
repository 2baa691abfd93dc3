"""Lexer and parser of the query language: text to plain statement objects."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from ..catalog import InvalidRequest

_TOKEN = re.compile(
    r"""\s+|--[^\n]*|//[^\n]*|/\*.*?\*/
    |(?P<body>\$\$.*?\$\$)
    |(?P<string>'(?:[^']|'')*')
    |(?P<quoted>"(?:[^"]|"")+")
    |(?P<uuid>[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})
    |(?P<blob>0[xX][0-9a-fA-F]*)
    |(?P<duration>-?(?:P(?:\d+[YMDW]|T\d)[0-9YMDWTHS]*|P\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d|(?:\d+(?:mo|ms|us|µs|ns|y|w|d|h|m|s))+)(?![A-Za-z0-9_]))
    |(?P<number>\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|\d+(?:[eE][+-]?\d+)?)
    |(?P<word>[A-Za-z_][A-Za-z0-9_]*)
    |(?P<op><=|>=|!=|[-+*/%=<>(){}\[\],.;:?])""",
    re.X | re.S,
)


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int


def lex(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise InvalidRequest(f"line {text.count(chr(10), 0, at) + 1}: no token at {text[at : at + 10]!r}")
        if m.lastgroup:
            out.append(Token(m.lastgroup, m[0], at))
        at = m.end()
    return out


# --- terms and selectors: nested tuples (tag, ...) -----------------------------------------------
#   ("lit", value) ("bind", key) ("col", name) ("call", name, args) ("cast", x, type) ("hint", type, x)
#   ("op", op, a, b) ("neg", x) ("list", xs) ("braces", xs or pairs) ("tuple", xs) ("field", x, name)
#   ("item", x, key) ("star",)


@dataclass
class Relation:
    """columns op term; kind is plain, tuple, token, item (m[k]) or index (expr(index, value))."""

    kind: str
    columns: list[str]
    op: str
    term: Any
    key: Any = None


@dataclass
class Select:
    table: str
    selectors: list[tuple[Any, str | None]]
    json: bool = False
    distinct: bool = False
    where: list[Relation] = field(default_factory=list)
    group_by: list[Any] = field(default_factory=list)
    order_by: list[tuple[str, bool, Any]] = field(default_factory=list)  # column, descending, ANN query
    per_partition: Any = None
    limit: Any = None
    allow_filtering: bool = False


@dataclass
class Insert:
    table: str
    columns: list[str]
    values: list[Any]
    json: Any = None
    json_unset: bool = False
    if_not_exists: bool = False
    ttl: Any = None
    timestamp: Any = None


@dataclass
class Update:
    table: str
    sets: list[tuple[str, Any, Any]]  # column, index or field (None: whole), term
    where: list[Relation]
    if_exists: bool = False
    conditions: list[Relation] = field(default_factory=list)
    ttl: Any = None
    timestamp: Any = None


@dataclass
class Delete:
    table: str
    targets: list[tuple[str, Any]]
    where: list[Relation]
    if_exists: bool = False
    conditions: list[Relation] = field(default_factory=list)
    timestamp: Any = None


@dataclass
class Batch:
    kind: str
    statements: list[Any]
    timestamp: Any = None


@dataclass
class Ddl:
    """A catalog statement: verb such as ``create table`` and its parts."""

    verb: str
    parts: dict[str, Any]


class Parser:
    def __init__(self, text: str):
        self.text, self.tokens, self.i, self.binds = text, lex(text), 0, 0

    # -- tokens ---------------------------------------------------------------------------------
    def peek(self, n: int = 0) -> Token:
        return self.tokens[self.i + n] if self.i + n < len(self.tokens) else Token("end", "", len(self.text))

    def error(self, what: str) -> InvalidRequest:
        t = self.peek()
        line = self.text.count("\n", 0, t.at) + 1
        return InvalidRequest(f"line {line}: {what} at {t.text or 'the end'!r}")

    def is_word(self, *words: str, n: int = 0) -> bool:
        t = self.peek(n)
        return t.kind == "word" and t.text.upper() in words

    def accept(self, *words: str) -> bool:
        """Takes a run of keywords or symbols if all of them come next."""
        for n, w in enumerate(words):
            t = self.peek(n)
            if not (t.text.upper() == w if w[0].isalpha() else t.text == w) or t.kind not in ("word", "op"):
                return False
        self.i += len(words)
        return True

    def expect(self, *words: str) -> None:
        if not self.accept(*words):
            raise self.error(f"expected {' '.join(words)}")

    def take(self, *kinds: str) -> Token:
        if self.peek().kind not in kinds:
            raise self.error(f"expected {' or '.join(kinds)}")
        self.i += 1
        return self.tokens[self.i - 1]

    def name(self) -> str:
        t = self.take("word", "quoted")
        return t.text.lower() if t.kind == "word" else t.text[1:-1].replace('""', '"')

    def dotted(self) -> str:
        out = self.name()
        while self.accept("."):
            out += "." + self.name()
        return out

    def many(self, one, sep: str = ",") -> list:
        out = [one()]
        while self.accept(sep):
            out.append(one())
        return out

    def type(self) -> str:
        out = self.dotted()
        if self.accept("<"):
            inner = self.many(lambda: self.take("number").text if self.peek().kind == "number" else self.type())
            self.expect(">")
            out += f"<{', '.join(inner)}>"
        return out

    # -- terms ----------------------------------------------------------------------------------
    def term(self):
        out = self.product()
        while self.peek().text in ("+", "-") and self.peek().kind == "op":
            op = self.take("op").text
            out = ("op", op, out, self.product())
        return out

    def product(self):
        out = self.unary()
        while self.peek().text in ("*", "/", "%") and self.peek().kind == "op":
            op = self.take("op").text
            out = ("op", op, out, self.unary())
        return out

    def unary(self):
        if self.accept("-"):
            if self.is_word("INFINITY"):
                self.i += 1
                return ("lit", float("-inf"))
            return ("neg", self.unary())
        out = self.primary()
        while True:
            if self.accept("["):
                out = ("item", out, self.term())
                self.expect("]")
            elif self.peek().text == "." and self.peek(1).kind in ("word", "quoted"):
                self.i += 1
                out = ("field", out, self.name())
            else:
                return out

    def primary(self):
        t = self.peek()
        if t.kind == "string":
            self.i += 1
            return ("lit", t.text[1:-1].replace("''", "'"))
        if t.kind == "body":
            self.i += 1
            return ("lit", t.text[2:-2])
        if t.kind == "number":
            self.i += 1
            return ("lit", int(t.text) if re.fullmatch(r"\d+", t.text) else float(t.text))
        if t.kind == "uuid":
            self.i += 1
            return ("lit", t.text.lower())
        if t.kind == "blob":
            self.i += 1
            return ("lit", bytes.fromhex(t.text[2:]))
        if t.kind == "duration":
            self.i += 1
            return ("duration", t.text)
        if self.accept("?"):
            self.binds += 1
            return ("bind", self.binds - 1)
        if self.accept(":"):
            return ("bind", self.name())
        if self.accept("["):
            xs = [] if self.peek().text == "]" else self.many(self.term)
            self.expect("]")
            return ("list", xs)
        if self.accept("{"):
            xs = []
            while not self.accept("}"):
                if xs:
                    self.expect(",")
                key = self.term()
                xs.append((key, self.term()) if self.accept(":") else key)
            return ("braces", xs)
        if self.accept("("):
            if self.is_type_hint():
                kind = self.type()
                self.expect(")")
                return ("hint", kind, self.unary())
            xs = self.many(self.term)
            self.expect(")")
            return ("tuple", xs) if len(xs) > 1 else xs[0]
        for word, value in (("NULL", None), ("TRUE", True), ("FALSE", False), ("NAN", float("nan")), ("INFINITY", float("inf"))):
            if self.is_word(word):
                self.i += 1
                return ("lit", value)
        if self.is_word("CAST") and self.peek(1).text == "(":
            self.i += 2
            x = self.term()
            self.expect("AS")
            kind = self.type()
            self.expect(")")
            return ("cast", x, kind)
        if t.kind in ("word", "quoted"):
            start = self.i
            name = self.name()
            while self.peek().text == "." and self.peek(1).kind == "word" and self.peek(2).text == "(":
                self.i += 1
                name += "." + self.name()
            if self.accept("("):
                if self.accept("*"):
                    args = [("star",)]
                else:
                    args = [] if self.peek().text == ")" else self.many(self.term)
                self.expect(")")
                return ("call", name if self.tokens[start].kind == "quoted" else name.lower(), args)
            return ("col", name)
        raise self.error("expected a term")

    def is_type_hint(self) -> bool:
        from ..catalog import NATIVE

        return self.peek().kind == "word" and self.peek().text.lower() in NATIVE and self.peek(1).text == ")" and self.peek(2).text not in (",", ")", ";", "", "=") and self.peek(2).kind != "end" and not self.is_word("AND", "FROM", "AS", "LIMIT", "ORDER", n=2)

    # -- where ------------------------------------------------------------------------------------
    def relations(self) -> list[Relation]:
        out = [self.relation()]
        while self.accept("AND"):
            out.append(self.relation())
        if self.is_word("OR"):
            raise self.error("relations are joined by AND only")
        return out

    def operator(self) -> str:
        for words, op in (
            (("CONTAINS", "KEY"), "contains key"), (("CONTAINS",), "contains"), (("LIKE",), "like"), (("IN",), "in"),
            (("IS", "NOT", "NULL"), "is not null"), (("<=",), "<="), ((">=",), ">="), (("!=",), "!="), (("=",), "="), (("<",), "<"), ((">",), ">"),
        ):
            if self.accept(*words):
                return op
        raise self.error("expected an operator")

    def relation(self) -> Relation:
        if self.is_word("TOKEN") and self.peek(1).text == "(":
            self.i += 2
            columns = self.many(self.name)
            self.expect(")")
            return Relation("token", columns, self.operator(), self.term())
        if self.is_word("EXPR") and self.peek(1).text == "(":
            self.i += 2
            index = self.name()
            self.expect(",")
            value = self.term()
            self.expect(")")
            return Relation("index", [index], "=", value)
        if self.accept("("):
            if self.peek().text == "(" or self.peek(1).text not in (",", ")"):
                inner = self.relation()
                self.expect(")")
                return inner
            columns = self.many(self.name)
            self.expect(")")
            op = self.operator()
            return Relation("tuple", columns, op, self.in_list() if op == "in" else self.term())
        name, key, kind = self.name(), None, "plain"
        if self.accept("["):
            key, kind = self.term(), "item"
            self.expect("]")
        elif self.accept("."):
            key, kind = self.name(), "field"
        op = self.operator()
        if op == "is not null":
            return Relation(kind, [name], op, None, key)
        return Relation(kind, [name], op, self.in_list() if op == "in" else self.term(), key)

    def in_list(self):
        if not self.accept("("):
            return self.term()
        xs = [] if self.peek().text == ")" else self.many(self.term)
        self.expect(")")
        return ("tuple", xs)

    # -- statements -----------------------------------------------------------------------------------
    def statement(self):
        if not self.tokens:
            raise InvalidRequest("no statement")
        for word, parse in (
            ("SELECT", self.select), ("INSERT", self.insert), ("UPDATE", self.update), ("DELETE", self.delete),
            ("BEGIN", self.batch), ("TRUNCATE", self.truncate), ("USE", self.use), ("CREATE", self.create),
            ("ALTER", self.alter), ("DROP", self.drop), ("GRANT", self.grant), ("REVOKE", self.grant), ("LIST", self.list_),
        ):
            if self.is_word(word):
                self.i += 1
                out = parse(word) if word in ("GRANT", "REVOKE") else parse()
                self.accept(";")
                if self.peek().kind != "end":
                    raise self.error("unexpected text")
                return out
        raise self.error("expected a statement")

    def select(self) -> Select:
        json, distinct = self.accept("JSON"), self.accept("DISTINCT")

        def selector():
            if self.accept("*"):
                return ("star",), None
            x = self.term()
            return x, self.name() if self.accept("AS") else None

        selectors = self.many(selector)
        self.expect("FROM")
        out = Select(self.dotted(), selectors, json, distinct)
        if self.accept("WHERE"):
            out.where = self.relations()
        if self.accept("GROUP", "BY"):
            out.group_by = self.many(self.term)
        if self.accept("ORDER", "BY"):

            def order():
                name = self.name()
                if self.accept("ANN"):
                    self.expect("OF")
                    return name, False, self.term()
                descending = self.accept("DESC")
                if not descending:
                    self.accept("ASC")
                return name, descending, None

            out.order_by = self.many(order)
        if self.accept("PER", "PARTITION", "LIMIT"):
            out.per_partition = self.term()
        if self.accept("LIMIT"):
            out.limit = self.term()
        out.allow_filtering = self.accept("ALLOW", "FILTERING")
        return out

    def using(self) -> dict:
        out = {}
        if self.accept("USING"):
            while True:
                word = self.name()
                if word not in ("ttl", "timestamp"):
                    raise self.error("expected TTL or TIMESTAMP")
                out[word] = self.term()
                if not self.accept("AND"):
                    break
        return out

    def insert(self) -> Insert:
        self.expect("INTO")
        out = Insert(self.dotted(), [], [])
        if self.accept("JSON"):
            out.json = self.term()
            if self.accept("DEFAULT", "UNSET"):
                out.json_unset = True
            else:
                self.accept("DEFAULT", "NULL")
        else:
            self.expect("(")
            out.columns = self.many(self.name)
            self.expect(")")
            self.expect("VALUES")
            self.expect("(")
            out.values = self.many(self.term)
            self.expect(")")
        out.if_not_exists = self.accept("IF", "NOT", "EXISTS")
        for k, v in self.using().items():
            setattr(out, k, v)
        return out

    def conditions(self, out) -> None:
        if self.accept("IF", "EXISTS"):
            out.if_exists = True
        elif self.accept("IF"):
            out.conditions = self.relations()

    def update(self) -> Update:
        table, using = self.dotted(), self.using()
        self.expect("SET")

        def one():
            name, key = self.name(), None
            if self.accept("["):
                key = self.term()
                self.expect("]")
            elif self.accept("."):
                key = ("lit", self.name())
            op = "+" if self.accept("+", "=") else "-" if self.accept("-", "=") else None
            if op is None:
                self.expect("=")
            x = self.term()
            return name, key, ("op", op, ("col", name), x) if op else x

        sets = self.many(one)
        self.expect("WHERE")
        out = Update(table, sets, self.relations(), ttl=using.get("ttl"), timestamp=using.get("timestamp"))
        self.conditions(out)
        return out

    def delete(self) -> Delete:
        targets = []
        if not self.is_word("FROM"):

            def one():
                name, key = self.name(), None
                if self.accept("["):
                    key = self.term()
                    self.expect("]")
                elif self.accept("."):
                    key = ("lit", self.name())
                return name, key

            targets = self.many(one)
        self.expect("FROM")
        table, using = self.dotted(), self.using()
        self.expect("WHERE")
        out = Delete(table, targets, self.relations(), timestamp=using.get("timestamp"))
        self.conditions(out)
        return out

    def batch(self) -> Batch:
        kind = "unlogged" if self.accept("UNLOGGED") else "counter" if self.accept("COUNTER") else "logged"
        self.expect("BATCH")
        using = self.using()
        out = []
        while not self.accept("APPLY", "BATCH"):
            for word, parse in (("INSERT", self.insert), ("UPDATE", self.update), ("DELETE", self.delete)):
                if self.accept(word):
                    out.append(parse())
                    break
            else:
                raise self.error("expected a modification")
            self.accept(";")
        return Batch(kind, out, using.get("timestamp"))

    def truncate(self) -> Ddl:
        self.accept("TABLE")
        return Ddl("truncate", {"name": self.dotted()})

    def use(self) -> Ddl:
        return Ddl("use", {"name": self.name()})

    def if_not_exists(self) -> bool:
        return self.accept("IF", "NOT", "EXISTS")

    def options(self) -> dict:
        out = {}
        if self.accept("WITH"):
            while True:
                if self.accept("CLUSTERING", "ORDER", "BY"):
                    self.expect("(")
                    order = self.many(lambda: (self.name(), self.accept("DESC") or (self.accept("ASC") and False)))
                    self.expect(")")
                    out["order"] = order
                elif self.accept("COMPACT", "STORAGE"):
                    out["compact"] = True
                else:
                    name = self.name()
                    self.accept("=")
                    out[name] = self.term()
                if not self.accept("AND"):
                    break
        return out

    def mask(self):
        if self.accept("MASKED", "WITH"):
            if self.accept("DEFAULT"):
                return ("mask_default", ())
            x = self.primary()
            if x[0] != "call":
                raise self.error("expected a masking function")
            return (x[1], tuple(x[2]))
        return None

    def create(self) -> Ddl:
        replace = self.accept("OR", "REPLACE")
        if self.accept("KEYSPACE"):
            return Ddl("create keyspace", {"if": self.if_not_exists(), "name": self.name(), "options": self.options()})
        if self.accept("TABLE"):
            parts = {"if": self.if_not_exists(), "name": self.dotted(), "columns": [], "key": None}
            self.expect("(")
            while not self.accept(")"):
                if self.accept("PRIMARY", "KEY"):
                    parts["key"] = self.primary_key()
                else:
                    name, kind = self.name(), self.type()
                    static, mask = self.accept("STATIC"), self.mask()
                    if self.accept("PRIMARY", "KEY"):
                        parts["key"] = ([name], [])
                    parts["columns"].append((name, kind, static, mask or self.mask()))
                self.accept(",")
            return Ddl("create table", parts | {"options": self.options()})
        if self.accept("TYPE"):
            parts = {"if": self.if_not_exists(), "name": self.dotted()}
            self.expect("(")
            fields = self.many(lambda: (self.name(), self.type()))
            self.expect(")")
            return Ddl("create type", parts | {"fields": fields})
        custom = self.accept("CUSTOM")
        if self.accept("INDEX"):
            missing = self.if_not_exists()
            name = None if self.is_word("ON") else self.name()
            self.expect("ON")
            table = self.dotted()
            self.expect("(")
            target = "values"
            if self.peek(1).text == "(":
                target = self.name()
                self.expect("(")
                column = self.name()
                self.expect(")")
            else:
                column = self.name()
            self.expect(")")
            using = self.term()[1] if self.accept("USING") else "legacy"
            return Ddl("create index", {"if": missing, "name": name, "table": table, "column": column, "target": target, "using": using, "custom": custom, "options": self.options()})
        if self.accept("MATERIALIZED", "VIEW"):
            parts = {"if": self.if_not_exists(), "name": self.dotted()}
            self.expect("AS")
            self.expect("SELECT")
            parts["select"] = self.select()
            self.expect("PRIMARY", "KEY")
            return Ddl("create view", parts | {"key": self.primary_key(), "options": self.options()})
        if self.accept("FUNCTION"):
            parts = {"if": self.if_not_exists(), "replace": replace, "name": self.dotted()}
            self.expect("(")
            parts["args"] = [] if self.peek().text == ")" else self.many(lambda: (self.name(), self.type()))
            self.expect(")")
            if self.accept("CALLED"):
                parts["null"] = False
            else:
                self.expect("RETURNS", "NULL")
                parts["null"] = True
            self.expect("ON", "NULL", "INPUT")
            self.expect("RETURNS")
            parts["returns"] = self.type()
            self.expect("LANGUAGE")
            parts["language"] = self.name()
            self.expect("AS")
            return Ddl("create function", parts | {"body": self.primary()[1]})
        if self.accept("AGGREGATE"):
            parts = {"if": self.if_not_exists(), "replace": replace, "name": self.dotted()}
            self.expect("(")
            parts["arg"] = self.type()
            self.expect(")")
            self.expect("SFUNC")
            parts["step"] = self.dotted()
            self.expect("STYPE")
            parts["state"] = self.type()
            parts["final"] = self.dotted() if self.accept("FINALFUNC") else None
            parts["initial"] = self.term() if self.accept("INITCOND") else None
            return Ddl("create aggregate", parts)
        if self.accept("TRIGGER"):
            parts = {"if": self.if_not_exists(), "name": self.name()}
            self.expect("ON")
            parts["table"] = self.dotted()
            self.expect("USING")
            return Ddl("create trigger", parts | {"using": self.term()[1]})
        if self.accept("ROLE") or self.accept("USER"):
            return Ddl("create role", {"if": self.if_not_exists(), "name": self.name(), "options": self.options()})
        raise self.error("expected what to create")

    def primary_key(self) -> tuple[list[str], list[str]]:
        self.expect("(")
        if self.accept("("):
            partition = self.many(self.name)
            self.expect(")")
        else:
            partition = [self.name()]
        clustering = self.many(self.name) if self.accept(",") else []
        self.expect(")")
        return partition, clustering

    def alter(self) -> Ddl:
        if self.accept("KEYSPACE"):
            return Ddl("alter keyspace", {"name": self.name(), "options": self.options()})
        if self.accept("MATERIALIZED", "VIEW"):
            return Ddl("alter view", {"name": self.dotted(), "options": self.options()})
        if self.accept("TYPE"):
            name = self.dotted()
            if self.accept("ADD"):
                return Ddl("alter type", {"name": name, "add": (self.name(), self.type())})
            self.expect("RENAME")
            pairs = [self.rename()]
            while self.accept("AND"):
                pairs.append(self.rename())
            return Ddl("alter type", {"name": name, "rename": pairs})
        self.expect("TABLE")
        parts = {"name": self.dotted()}
        if self.accept("ADD"):
            parts["add"] = self.many(lambda: (self.name(), self.type(), self.accept("STATIC"), self.mask()))
        elif self.accept("DROP"):
            parts["drop"] = self.many(self.name)
        elif self.accept("RENAME"):
            parts["rename"] = [self.rename()]
            while self.accept("AND"):
                parts["rename"].append(self.rename())
        elif self.accept("ALTER"):
            column = self.name()
            parts["mask"] = (column, None if self.accept("DROP", "MASKED") else self.mask())
        else:
            parts["options"] = self.options()
        return Ddl("alter table", parts)

    def rename(self) -> tuple[str, str]:
        old = self.name()
        self.expect("TO")
        return old, self.name()

    def drop(self) -> Ddl:
        for words, verb in (
            (("KEYSPACE",), "keyspace"), (("TABLE",), "table"), (("TYPE",), "type"), (("INDEX",), "index"),
            (("MATERIALIZED", "VIEW"), "view"), (("FUNCTION",), "function"), (("AGGREGATE",), "aggregate"),
            (("TRIGGER",), "trigger"), (("ROLE",), "role"),
        ):
            if self.accept(*words):
                parts = {"if": self.accept("IF", "EXISTS"), "name": self.dotted(), "signature": None}
                if self.accept("("):
                    parts["signature"] = [] if self.peek().text == ")" else self.many(self.type)
                    self.expect(")")
                if verb == "trigger":
                    self.expect("ON")
                    parts["table"] = self.dotted()
                return Ddl("drop " + verb, parts)
        raise self.error("expected what to drop")

    def grant(self, word: str) -> Ddl:
        permission = self.name()
        self.accept("PERMISSION")
        self.accept("PERMISSIONS")
        self.expect("ON")
        if self.accept("ALL", "KEYSPACES"):
            on = "*"
        else:
            self.accept("TABLE")
            on = self.dotted()
        self.expect("TO" if word == "GRANT" else "FROM")
        return Ddl(word.lower(), {"permission": permission, "on": on, "role": self.name()})

    def list_(self) -> Ddl:
        self.accept("ALL")
        self.accept("PERMISSIONS")
        return Ddl("list permissions", {"role": self.name() if self.accept("OF") else None})


def parse(text: str):
    """One statement."""
    return Parser(text).statement()
