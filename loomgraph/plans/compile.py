"""Queries over a property graph as DataFrame joins and aggregations."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.normalize import ORDINAL, PropertyGraph
from loomgraph.operators.store import identified
from loomgraph.plans.syntax import (
    Alias,
    Call,
    Clause,
    Compare,
    EdgePattern,
    Literal,
    Logic,
    NodePattern,
    Parameter,
    Property,
    Query,
    QueryError,
    Slice,
    has_aggregate,
    parse,
)
from loomgraph.vocabulary import NATIVE_RELATIONS

NODE_COLUMNS = ("uid", "label", "entity_id")


def _conjuncts(test: Any) -> list[Any]:
    if test is None:
        return []
    return [x for p in test.parts for x in _conjuncts(p)] if isinstance(test, Logic) and test.op == "and" else [test]


def _aliases(value: Any) -> set[str]:
    if isinstance(value, Alias):
        return {value.name}
    if isinstance(value, Property):
        return {value.alias}
    parts = {Compare: lambda v: (v.left, v.right), Logic: lambda v: v.parts, Call: lambda v: v.args, Slice: lambda v: (v.of,)}
    return set().union(*[_aliases(p) for p in parts[type(value)](value)]) if type(value) in parts else set()


class Compiler:
    """One query on one graph. Column alias__property holds a bound property; alias__uid tells whether an alias is bound.

    Two rules run before Catalyst sees the plan: patterns start from the most selective anchor (an id, then a prefix, then
    a label), and nodes aren't joined at all where an edge carries all that is asked of its ends.
    """

    def __init__(self, graph: PropertyGraph, query: Query, params: dict[str, Any]):
        self.graph, self.query, self.params = graph, query, params
        self.nodes = query.nodes()
        self.edge_aliases = {e.alias for e in query.edges()}
        self.whole = {i.value.name for i in query.items if isinstance(i.value, Alias) and i.value.name in self.nodes}
        known = set(self.nodes) | self.edge_aliases
        used = set().union(*[_aliases(i.value) for i in query.items], *[_aliases(c.where) for c in query.clauses if c.where])
        if used - known:
            raise QueryError("UNDEFINED_ALIAS", ", ".join(sorted(used - known)))

    # values

    def constant(self, value: Any) -> Any:
        if isinstance(value, Parameter):
            if value.name not in self.params:
                raise QueryError("MISSING_REQUIRED_SLOT", value.name)
            return self.params[value.name]
        if isinstance(value, Call) and value.name == "date":
            return self.constant(value.args[0])
        if isinstance(value, Literal):
            return value.value
        raise QueryError("SYNTAX", f"not a constant: {value}")

    def value(self, value: Any, frame: DataFrame) -> Column:
        if isinstance(value, Alias):
            name = value.name
            if name in self.nodes:
                node = F.struct(F.col(f"{name}__label").alias("label"), F.col(f"{name}__entity_id").alias("entity_id"))
                return F.when(F.col(f"{name}__uid").isNotNull(), node)
            return F.col(f"{name}__uid")
        if isinstance(value, Property):
            column = f"{value.alias}__{value.name}"
            return F.col(column) if column in frame.columns else F.lit(None).cast("string")
        if isinstance(value, Slice):
            return F.slice(self.value(value.of, frame), value.start + 1, value.end - value.start)
        if isinstance(value, Call) and value.name != "date":
            return self.call(value, frame)
        return F.lit(self.constant(value))

    def call(self, call: Call, frame: DataFrame) -> Column:
        if call.name == "count" and call.args == (Literal("*"),):
            return F.count(F.lit(1))
        arg = self.value(call.args[0], frame)
        if call.name == "count":
            return F.count_distinct(arg) if call.distinct else F.count(arg)
        if call.name == "collect":
            return F.sort_array(F.collect_set(arg)) if call.distinct else F.collect_list(arg)
        plain = {"max": F.max, "min": F.min, "sum": F.sum, "avg": F.avg, "tolower": F.lower, "toupper": F.upper, "size": F.size}
        if call.name not in plain:
            raise QueryError("UNKNOWN_FUNCTION", call.name)
        return plain[call.name](arg)

    def test(self, test: Any, frame: DataFrame) -> Column:
        if isinstance(test, Logic):
            parts = [self.test(p, frame) for p in test.parts]
            return ~parts[0] if test.op == "not" else reduce((lambda a, b: a & b) if test.op == "and" else (lambda a, b: a | b), parts)
        if test.op in ("is null", "is not null"):
            alias = isinstance(test.left, Alias)
            left = F.col(f"{test.left.name}__uid") if alias else self.value(test.left, frame)
            return left.isNull() if test.op == "is null" else left.isNotNull()
        left = self.value(test.left, frame)
        if test.op == "in":
            return left.isin(*self.constant(test.right))
        right = self.value(test.right, frame)
        by_op = {
            "=": left.__eq__, "<>": left.__ne__, "<": left.__lt__, "<=": left.__le__, ">": left.__gt__, ">=": left.__ge__,
            "starts with": left.startswith, "ends with": left.endswith, "contains": left.contains,
        }
        return by_op[test.op](right)

    # patterns

    def node_tests(self, node: NodePattern, label: Column, entity_id: Column) -> list[Column]:
        out = [] if node.label is None else [label == node.label]
        for key, value in node.props:
            out.append((entity_id if key == "entity_id" else F.lit(None).cast("string")) == F.lit(self.constant(value)))
        return out

    def edge_scan(self, e: EdgePattern, nodes: dict[str, NodePattern]) -> DataFrame:
        edges = self.graph.edges
        native = [t for t in e.types if t in NATIVE_RELATIONS]
        service = [t for t in e.types if t not in NATIVE_RELATIONS]
        tests = []
        if e.types:
            tests.append(F.col("rel_type").isin(*native) | F.col("service_rel_type").isin(*service) if native and service
                         else F.col("rel_type").isin(*native) if native else F.col("service_rel_type").isin(*service))
        tests += self.node_tests(nodes[e.source], F.col("src_label"), F.col("src_entity_id"))
        tests += self.node_tests(nodes[e.target], F.col("dst_label"), F.col("dst_entity_id"))
        tests += [F.col(k) == F.lit(self.constant(v)) for k, v in e.props if k in edges.columns]
        for t in tests:
            edges = edges.where(t)
        if e.source == e.target:
            edges = edges.where("source_node_uid = target_node_uid")
        skip = {"source_node_uid", "target_node_uid", "src_label", "src_entity_id", "dst_label", "dst_entity_id", "edge_uid"}
        out = [F.col("edge_uid").alias(f"{e.alias}__uid"), *[F.col(c).alias(f"{e.alias}__{c}") for c in edges.columns if c not in skip | {ORDINAL}]]
        for node, side, key in ((e.source, "src", "source_node_uid"), (e.target, "dst", "target_node_uid"))[: 1 + (e.source != e.target)]:
            columns = (key, f"{side}_label", f"{side}_entity_id")
            out += [F.col(c).alias(f"{node}__{n}") for c, n in zip(columns, NODE_COLUMNS, strict=True)]
        return edges.select(*out)

    def node_scan(self, node: NodePattern) -> DataFrame:
        nodes = self.graph.nodes
        for t in self.node_tests(node, F.col("label"), F.col("entity_id")):
            nodes = nodes.where(t)
        keep = ("node_uid", "label", "entity_id", "raw_entity_type")
        return nodes.select(*[F.col(c).alias(f"{node.alias}__{'uid' if c == 'node_uid' else c}") for c in keep])

    def cost(self, e: EdgePattern, tests: list[Any]) -> tuple[int, int]:
        """Lower is more selective: an end with an id, an end with a prefix, then the rest."""
        ends = {e.source, e.target}
        ids = any(k == "entity_id" for n in ends for k, _ in self.nodes[n].props)
        for t in tests:
            if isinstance(t, Compare) and isinstance(t.left, Property) and t.left.alias in ends and t.left.name == "entity_id":
                if t.op == "=":
                    ids = True
                if t.op == "starts with":
                    return (0 if ids else 1, 0)
        return (0 if ids else 2, -sum(self.nodes[n].label is not None for n in ends))

    def match(self, clauses: list[Clause], nodes: dict[str, NodePattern], tests: list[Any]) -> DataFrame:
        """All edge patterns joined on their shared ends; nodes alone only where no edge names them."""
        waiting = sorted(((self.cost(e, tests), k, e) for k, e in enumerate(e for c in clauses for e in c.edges)), key=lambda x: x[:2])
        bound = {n for _, _, e in waiting for n in (e.source, e.target)}
        alone = [nodes[n] for n in dict.fromkeys(n.alias for c in clauses for n in c.nodes) if n not in bound]
        frame = None
        while waiting:
            joined = set() if frame is None else {c.split("__")[0] for c in frame.columns}
            k = next((k for k, x in enumerate(waiting) if frame is None or joined & {x[2].source, x[2].target}), 0)
            e = waiting.pop(k)[2]
            frame = self.join(frame, self.edge_scan(e, nodes), {e.source, e.target} & joined)
        for n in alone:
            frame = self.join(frame, self.node_scan(n), set())
        for c in clauses:  # an edge is used once within a clause
            for i, a in enumerate(c.edges):
                for b in c.edges[:i]:
                    frame = frame.where(F.col(f"{a.alias}__uid") != F.col(f"{b.alias}__uid"))
        return frame

    @staticmethod
    def join(left: DataFrame | None, right: DataFrame, shared: set[str]) -> DataFrame:
        if left is None:
            return right
        if not shared:
            return left.crossJoin(right)  # patterns without a common alias: the language asks for the product
        drop = [f"{n}__{c}" for n in shared for c in NODE_COLUMNS[1:]]
        return left.join(right.drop(*drop), [f"{n}__uid" for n in sorted(shared)])

    def optional(self, frame: DataFrame, clause: Clause, k: int) -> DataFrame:
        """A left join; what WHERE says belongs to its condition and never drops a row."""
        have = {c.split("__")[0] for c in frame.columns}
        own = {n.alias: n for n in clause.nodes}
        sub = self.match([clause], {n: self.nodes[n] if n not in have else own[n] for n in own}, _conjuncts(clause.where))
        shared = sorted(have & set(own))
        on = []
        for n in shared:
            on.append(F.col(f"{n}__uid") == F.col(f"_o{k}_{n}"))
            sub = sub.withColumnRenamed(f"{n}__uid", f"_o{k}_{n}").drop(*[f"{n}__{c}" for c in (*NODE_COLUMNS[1:], "raw_entity_type")])
        both = frame.select("*", *[F.lit(None).cast(t).alias(c) for c, t in sub.dtypes])
        on += [self.test(t, both) for t in _conjuncts(clause.where)]
        out = frame.join(sub, reduce(lambda a, b: a & b, on) if on else F.lit(True), "left")
        return out.drop(*[f"_o{k}_{n}" for n in shared])

    def run(self) -> DataFrame:
        plain = [c for c in self.query.clauses if not c.optional]
        tests = [t for c in plain for t in _conjuncts(c.where)]
        required = {n.alias: self.nodes[n.alias] for c in plain for n in c.nodes}
        frame = self.match(plain, required, tests)
        for t in tests:
            frame = frame.where(self.test(t, frame))
        for k, c in enumerate(c for c in self.query.clauses if c.optional):
            frame = self.optional(frame, c, k)
        return self.project(frame)

    def project(self, frame: DataFrame) -> DataFrame:
        q = self.query
        keys = [i for i in q.items if not has_aggregate(i.value)]
        names = {i.name: i for i in q.items}
        grouped = len(keys) < len(q.items)
        if grouped:
            values = [self.value(i.value, frame).alias(i.name) for i in q.items if has_aggregate(i.value)]
            extra = []
            for n, o in enumerate(q.order):
                if has_aggregate(o.value) and not any(i.value == o.value for i in q.items):
                    extra.append(self.value(o.value, frame).alias(f"_s{n}"))
            frame = frame.groupBy(*[self.value(i.value, frame).alias(i.name) for i in keys]).agg(*values, *extra)
        order = []
        for n, o in enumerate(q.order):
            same = next((i.name for i in q.items if i.value == o.value), None)
            name = o.value.name if isinstance(o.value, Alias) and o.value.name in names else same
            if grouped or q.distinct:
                c = F.col(name) if name else F.col(f"_s{n}")
            else:
                c = self.value(names[name].value if name else o.value, frame)
            order.append(c.desc_nulls_first() if o.descending else c.asc_nulls_last())
        out = [F.col(i.name) if grouped else self.value(i.value, frame).alias(i.name) for i in q.items]
        if q.distinct:
            frame = frame.select(*out).distinct()
            out = [F.col(i.name) for i in q.items]
        if order:
            frame = frame.orderBy(*order)
        if q.skip:
            frame = frame.offset(q.skip)
        if q.limit is not None:
            frame = frame.limit(q.limit)
        return frame.select(*out)


def run_query(graph: PropertyGraph, text: str | Query, params: dict[str, Any] | None = None) -> DataFrame:
    """Parse, bind and compile a query; the result is an ordinary lazy DataFrame.

    Edges are told apart by edge_uid; a graph without it is numbered and written first, once.
    """
    return Compiler(identified(graph), parse(text) if isinstance(text, str) else text, params or {}).run()
