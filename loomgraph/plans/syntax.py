"""The query language: tokens, syntax tree and parser of the supported Cypher subset."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from typing import Any


class QueryError(ValueError):
    """A query that can't be parsed or bound; code names the kind of fault."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass(frozen=True)
class Literal:
    value: Any


@dataclass(frozen=True)
class Parameter:
    name: str


@dataclass(frozen=True)
class Alias:
    name: str


@dataclass(frozen=True)
class Property:
    alias: str
    name: str


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    distinct: bool = False


@dataclass(frozen=True)
class Slice:
    of: Any
    start: int
    end: int


@dataclass(frozen=True)
class Compare:
    op: str
    left: Any
    right: Any = None


@dataclass(frozen=True)
class Logic:
    op: str
    parts: tuple


@dataclass(frozen=True)
class NodePattern:
    alias: str
    label: str | None = None
    props: tuple = ()


@dataclass(frozen=True)
class EdgePattern:
    """left and right are node aliases as written; reverse is set for <-[ ]-."""

    alias: str
    types: tuple[str, ...]
    left: str
    right: str
    reverse: bool = False
    props: tuple = ()
    named: bool = True

    @property
    def source(self) -> str:
        return self.right if self.reverse else self.left

    @property
    def target(self) -> str:
        return self.left if self.reverse else self.right


@dataclass(frozen=True)
class Clause:
    optional: bool
    nodes: tuple[NodePattern, ...]
    edges: tuple[EdgePattern, ...]
    where: Any = None


@dataclass(frozen=True)
class Item:
    value: Any
    name: str


@dataclass(frozen=True)
class Order:
    value: Any
    descending: bool


@dataclass(frozen=True)
class Query:
    clauses: tuple[Clause, ...]
    items: tuple[Item, ...]
    distinct: bool = False
    order: tuple[Order, ...] = ()
    skip: int | None = None
    limit: int | None = None

    def nodes(self) -> dict[str, NodePattern]:
        """Node patterns by alias; the label and properties of all mentions together."""
        out: dict[str, NodePattern] = {}
        for c in self.clauses:
            for n in c.nodes:
                old = out.get(n.alias)
                out[n.alias] = n if old is None else replace(old, label=old.label or n.label, props=(*old.props, *n.props))
        return out

    def edges(self) -> list[EdgePattern]:
        return [e for c in self.clauses for e in c.edges]


_TOKENS = re.compile(
    r"\s+|(?P<number>\d+(?:\.\d+)?(?!\.?\w))|(?P<whole>\d+)|(?P<text>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|\$(?P<param>\w+)"
    r"|(?P<name>[A-Za-z_]\w*)|(?P<op><=|>=|<>|\.\.|[-()\[\]{}:,.|=<>*])"
)
AGGREGATES = ("count", "collect", "max", "min", "sum", "avg")
_WORDS = {"match", "optional", "where", "return", "order", "limit", "skip", "as", "and", "or", "not"}


@dataclass
class Parser:
    text: str
    tokens: list[tuple[str, str]] = field(default_factory=list)
    at: int = 0
    made: int = 0

    def __post_init__(self):
        if not self.text or not self.text.strip():
            raise QueryError("EMPTY_QUERY", "the query is empty")
        pos = 0
        while pos < len(self.text):
            m = _TOKENS.match(self.text, pos)
            if not m:
                raise QueryError("SYNTAX", f"unexpected {self.text[pos]!r} at {pos}")
            if m.lastgroup:
                self.tokens.append(("number" if m.lastgroup == "whole" else m.lastgroup, m[m.lastgroup]))
            pos = m.end()

    def peek(self, *values: str, ahead: int = 0) -> bool:
        if self.at + ahead >= len(self.tokens):
            return False
        kind, value = self.tokens[self.at + ahead]
        return kind != "text" and value.lower() in values

    def take(self, *values: str) -> bool:
        if self.peek(*values):
            self.at += 1
            return True
        return False

    def need(self, *values: str) -> str:
        if not self.peek(*values):
            found = self.tokens[self.at][1] if self.at < len(self.tokens) else "the end"
            raise QueryError("SYNTAX", f"expected {' or '.join(values)}, found {found}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def kind(self, kind: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == kind:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def name(self) -> str:
        found = self.kind("name")
        if found is None:
            raise QueryError("SYNTAX", "expected a name")
        return found

    def query(self) -> Query:
        clauses = []
        while self.peek("match", "optional"):
            clauses.append(self.clause())
        if not clauses:
            raise QueryError("MISSING_MATCH", "the query has no MATCH")
        if not self.take("return"):
            raise QueryError("MISSING_RETURN", "the query has no RETURN")
        distinct = self.take("distinct")
        items = [self.item()]
        while self.take(","):
            items.append(self.item())
        order = []
        if self.take("order"):
            self.need("by")
            while True:
                value = self.operand()
                order.append(Order(value, self.take("desc", "descending") or (self.take("asc", "ascending") and False)))
                if not self.take(","):
                    break
        skip = int(self.kind("number")) if self.take("skip") else None
        limit = int(self.kind("number")) if self.take("limit") else None
        if self.at < len(self.tokens):
            raise QueryError("SYNTAX", f"unexpected {self.tokens[self.at][1]}")
        return Query(tuple(clauses), tuple(items), distinct, tuple(order), skip, limit)

    def clause(self) -> Clause:
        optional = self.take("optional")
        self.need("match")
        nodes, edges = [], []
        while True:
            self.path(nodes, edges)
            if not self.take(","):
                break
        return Clause(optional, tuple(nodes), tuple(edges), self.either() if self.take("where") else None)

    def path(self, nodes: list, edges: list) -> None:
        nodes.append(self.node())
        while self.peek("-", "<"):
            left, reverse = nodes[-1].alias, self.take("<")
            self.need("-")
            alias, types, props = None, [], ()
            if self.take("["):
                alias = self.kind("name")
                while self.take(":", "|"):
                    types.append(self.name())
                props = self.props()
                self.need("]")
            self.need("-")
            if not reverse:
                self.need(">")
            nodes.append(self.node())
            self.made += 1
            edges.append(
                EdgePattern(alias or f"_e{self.made}", tuple(types), left, nodes[-1].alias, reverse, props, alias is not None)
            )

    def node(self) -> NodePattern:
        self.need("(")
        alias = self.kind("name")
        label = self.name() if self.take(":") else None
        props = self.props()
        self.need(")")
        self.made += alias is None
        return NodePattern(alias or f"_n{self.made}", label, props)

    def props(self) -> tuple:
        out = []
        if self.take("{"):
            while not self.take("}"):
                key = self.name()
                self.need(":")
                out.append((key, self.operand()))
                self.take(",")
        return tuple(out)

    def item(self) -> Item:
        begin = self.at
        value = self.operand()
        words = "".join(v for _, v in self.tokens[begin : self.at])
        return Item(value, self.name() if self.take("as") else re.sub(r"\W+", "_", words).strip("_"))

    def either(self):
        parts = [self.both()]
        while self.take("or"):
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else Logic("or", tuple(parts))

    def both(self):
        parts = [self.test()]
        while self.take("and"):
            parts.append(self.test())
        return parts[0] if len(parts) == 1 else Logic("and", tuple(parts))

    def test(self):
        if self.take("not"):
            return Logic("not", (self.test(),))
        if self.peek("("):
            self.take("(")
            inner = self.either()
            self.need(")")
            return inner
        left = self.operand()
        if self.take("is"):
            negated = self.take("not")
            self.need("null")
            return Compare("is not null" if negated else "is null", left)
        for first, op in (("starts", "starts with"), ("ends", "ends with")):
            if self.take(first):
                self.need("with")
                return Compare(op, left, self.operand())
        if self.take("contains"):
            return Compare("contains", left, self.operand())
        if self.take("in"):
            return Compare("in", left, self.operand())
        return Compare(self.need("=", "<>", "<=", ">=", "<", ">"), left, self.operand())

    def operand(self):
        value = self.simple()
        while self.take("["):
            start = int(self.kind("number"))
            self.need("..")
            value = Slice(value, start, int(self.kind("number")))
            self.need("]")
        return value

    def simple(self):
        if (text := self.kind("text")) is not None:
            return Literal(re.sub(r"\\(.)", r"\1", text[1:-1]))
        if (number := self.kind("number")) is not None:
            return Literal(float(number) if "." in number else int(number))
        if (param := self.kind("param")) is not None:
            return Parameter(param)
        if self.take("*"):
            return Literal("*")
        if self.take("["):
            out = []
            while not self.take("]"):
                out.append(self.operand())
                self.take(",")
            return Literal(tuple(x.value for x in out))
        if self.peek(*_WORDS):
            raise QueryError("SYNTAX", f"unexpected {self.tokens[self.at][1]}")
        name = self.name()
        if name.lower() in ("true", "false", "null"):
            return Literal({"true": True, "false": False, "null": None}[name.lower()])
        if self.take("("):
            distinct, args = self.take("distinct"), []
            while not self.take(")"):
                args.append(self.operand())
                self.take(",")
            return Call(name.lower(), tuple(args), distinct)
        return Property(name, self.name()) if self.take(".") else Alias(name)


def parse(text: str) -> Query:
    return Parser(text).query()


def has_aggregate(value: Any) -> bool:
    if isinstance(value, Slice):
        return has_aggregate(value.of)
    return isinstance(value, Call) and value.name in AGGREGATES
