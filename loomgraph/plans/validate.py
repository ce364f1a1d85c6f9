"""Schemas, static validation of query texts as column expressions, and checks against a template."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.plans.syntax import Compare, Logic, Property, Query, QueryError, parse
from loomgraph.vocabulary import DIRECTIONS, LABELS, NATIVE_RELATIONS, NODE_PROPERTIES, RELATION_PROPERTIES


@dataclass(frozen=True)
class Schema:
    """What queries may name. An empty set allows everything of its kind."""

    labels: frozenset = frozenset(LABELS)
    relations: frozenset = frozenset(NATIVE_RELATIONS)
    properties: frozenset = frozenset(NODE_PROPERTIES)
    by_relation: dict = field(default_factory=lambda: {k: frozenset(v) for k, v in RELATION_PROPERTIES.items()})
    by_label: dict = field(default_factory=dict)
    directions: frozenset = frozenset(DIRECTIONS)

    def allows_property(self, name: str, label: str | None = None, relation: str | None = None) -> bool:
        own = self.by_label.get(label) if label else self.by_relation.get(relation) if relation else None
        if own is not None and name in own:
            return True
        return not self.properties or name in self.properties

    def allows_direction(self, source: str, relation: str, target: str) -> bool:
        return not self.directions or f"{source}-[:{relation}]->{target}" in self.directions


def inferred(found: DataFrame) -> Schema:
    """The schema of reports.inferred_schema: a few rows for each label and relation, so it fits the driver."""
    kinds: dict[str, set] = {}
    for kind, value in found.select("kind", "value").collect():
        kinds.setdefault(kind, set()).add(value)

    def owned(kind: str) -> dict:
        out: dict[str, set] = {}
        for v in kinds.get(kind, ()):
            owner, _, name = v.partition(".")
            out.setdefault(owner, set()).add(name)
        return {k: frozenset(v) for k, v in out.items()}

    labels, relations = owned("label property"), owned("relation property")
    every = frozenset().union(*labels.values(), *relations.values())
    return Schema(
        frozenset(kinds.get("label", ())), frozenset(kinds.get("relation", ())), every, relations, labels, frozenset(kinds.get("direction", ()))
    )


# Fixed patterns of the textual checks. An edge with an alias is read as a label, and directions are seen only on edges
# without one; both are what the checks have always done.
_LABEL, _RELATION, _PROPERTY = r"(?<!\[):([A-Za-z_][A-Za-z0-9_]*)", r"\[[^\]]*:([A-Za-z_][A-Za-z0-9_]*)\]", r"\.([A-Za-z_][A-Za-z0-9_]*)"
_DIRECTION = r"\([^)]+:([A-Za-z_]\w*)\)\s*-\s*\[:([A-Za-z_]\w*)\]\s*->\s*\([^)]+:([A-Za-z_]\w*)\)"


def _names(text: Column, pattern: str) -> Column:
    return F.sort_array(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))))


def _lits(values) -> Column:
    return F.array(*[F.lit(v) for v in sorted(values)]).cast("array<string>")


def static_codes(text: Column | str, schema: Schema, edge_labels: bool = False) -> Column:
    """array<string> of the faults of a query text, for any number of queries in one job.

    edge_labels counts the types of named edges among the allowed labels.
    """
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    count = lambda c: F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))
    upper, blank = F.upper(t), F.trim(t) == ""
    labels = schema.labels | schema.relations if edge_labels else schema.labels
    relations = _names(t, _RELATION)
    allowed = _lits(schema.properties)
    if schema.by_relation:
        extra = F.create_map(*[x for k, v in sorted(schema.by_relation.items()) for x in (F.lit(k), _lits(v))])
        known = F.filter(relations, lambda r: F.map_contains_key(extra, r))
        allowed = F.concat(allowed, F.flatten(F.transform(known, lambda r: extra[r])))
    found = F.transform(F.arrays_zip(*[
        F.regexp_extract_all(t, F.lit(_DIRECTION), F.lit(i)).alias(n) for i, n in ((1, "s"), (2, "r"), (3, "d"))
    ]), lambda x: F.concat(x["s"], F.lit("-[:"), x["r"], F.lit("]->"), x["d"]))
    bad = lambda names, ok: F.size(F.array_except(names, _lits(ok))) > 0
    checks = [
        ("EMPTY_QUERY", blank), ("MISSING_MATCH", ~blank & ~upper.contains("MATCH ")), ("MISSING_RETURN", ~blank & ~upper.contains("RETURN ")),
        ("UNBALANCED_PARENTHESES", count("(") != count(")")), ("UNBALANCED_BRACKETS", count("[") != count("]")),
    ]
    if schema.labels:
        checks.append(("UNKNOWN_LABEL", bad(_names(t, _LABEL), labels)))
    if schema.relations:
        checks.append(("UNKNOWN_REL", bad(relations, schema.relations)))
    if schema.properties:
        checks.append(("ILLEGAL_PROPERTY", F.size(F.array_except(_names(t, _PROPERTY), allowed)) > 0))
    if schema.directions:
        checks.append(("DIRECTION_MISMATCH", (F.size(found) > 0) & ~F.arrays_overlap(found, _lits(schema.directions))))
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks]))


def _listed(code: str, names: Column) -> Column:
    return F.when(F.size(names) > 0, F.concat(F.lit(f"{code}:['"), F.array_join(names, "', '"), F.lit("']")))


def string_codes(text: Column | str, schema: Schema, query_type: Column | None = None, families: tuple[str, ...] | None = None) -> Column:
    """array<string> of faults in lower case, with the offending names in the code.

    families are the shapes that the question's type allows; a join_traversal without a relation is a fault unless a single
    entity will do. Without families that check is left out.
    """
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    shape = F.filter(static_codes(t, Schema(frozenset(), frozenset(), frozenset(), {}, {}, frozenset())), lambda c: c != "")
    shape = F.transform(shape, F.lower)
    relations, more = _names(t, _RELATION), []
    if schema.labels:
        more.append(_listed("disallowed_labels", F.array_except(_names(t, _LABEL), _lits(schema.labels))))
    if schema.relations:
        more.append(_listed("disallowed_relationships", F.array_except(relations, _lits(schema.relations))))
        if families is not None and "entity_filter" not in families:
            kind = F.lit("join_traversal") if query_type is None else query_type
            more.append(F.when((kind == "join_traversal") & (F.size(relations) == 0), F.lit("missing_required_relationship")))
    if schema.properties:
        more.append(_listed("disallowed_properties", F.array_except(_names(t, _PROPERTY), _lits(schema.properties))))
    if schema.directions:
        mismatch = F.array_contains(static_codes(t, Schema(frozenset(), frozenset(), frozenset(), {}, {}, schema.directions)), "DIRECTION_MISMATCH")
        more.append(F.when(mismatch, F.lit("direction_constraint_violation")))
    return F.concat(shape, F.array_compact(F.array(*more))) if more else shape


def failure_details(text: Column | str, codes: Column, schema: Schema, missing: Column | None = None, notes: Column | None = None) -> Column:
    """struct(missing_slots, offending_tokens, offending_properties, hop_count, notes) of a query that failed with codes."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    none = F.array().cast("array<string>")
    when = lambda code, names: F.when(F.array_contains(codes, code), names).otherwise(none)
    found = F.transform(F.arrays_zip(*[
        F.regexp_extract_all(t, F.lit(_DIRECTION), F.lit(i)).alias(n) for i, n in ((1, "s"), (2, "r"), (3, "d"))
    ]), lambda x: F.concat(x["s"], F.lit("-[:"), x["r"], F.lit("]->"), x["d"]))
    relations = _names(t, _RELATION)
    tokens = F.concat(
        when("UNKNOWN_LABEL", F.array_except(_names(t, _LABEL), _lits(schema.labels))),
        when("UNKNOWN_REL", F.array_except(relations, _lits(schema.relations))),
        when("NON_NATIVE_REL_TYPE", F.array_except(relations, _lits(NATIVE_RELATIONS))), when("DIRECTION_MISMATCH", found),
    )
    named = F.array_except(_names(t, _PROPERTY), _lits(schema.properties))
    illegal = F.concat(when("ILLEGAL_PROPERTY", named), when("TEMPLATE_PROPERTY_NOT_ALLOWED", named))
    unique = lambda a: F.sort_array(F.array_distinct(a))
    return F.struct(
        unique(when("MISSING_REQUIRED_SLOT", F.coalesce(missing, none) if missing is not None else none)).alias("missing_slots"),
        unique(tokens).alias("offending_tokens"), unique(illegal).alias("offending_properties"),
        F.regexp_count(t, F.lit(r"-\s*\[")).cast("int").alias("hop_count"), (F.lit("") if notes is None else notes).alias("notes"),
    )


def _tests(value) -> list:
    if isinstance(value, Logic):
        return [x for p in value.parts for x in _tests(p)]
    return [] if value is None else [value]


def services(query: Query, alias: str | None = None) -> list[str]:
    """Service relations that the query asks for, in order; of one edge, if named."""
    out = []
    for c in query.clauses:
        for t in _tests(c.where):
            if isinstance(t, Compare) and t.op in ("=", "in") and isinstance(t.left, Property) and t.left.name == "service_rel_type":
                if alias in (None, t.left.alias):
                    v = t.right.value
                    out += list(v) if isinstance(v, tuple) else [v]
    return out


def properties(query: Query) -> set[tuple[str, str]]:
    """(alias, property) pairs anywhere in a query."""
    found: set[tuple[str, str]] = set()

    def walk(v) -> None:
        if isinstance(v, Property):
            found.add((v.alias, v.name))
        for k in ("left", "right", "of"):
            if hasattr(v, k):
                walk(getattr(v, k))
        for k in ("parts", "args"):
            for p in getattr(v, k, ()):
                walk(p)

    for v in [*[i.value for i in query.items], *[o.value for o in query.order], *[c.where for c in query.clauses]]:
        walk(v)
    return found


def bound_codes(text: str, schema: Schema) -> list[str]:
    """Faults found on the syntax tree: unlike the textual checks, these see named edges and every direction."""
    try:
        q = parse(text)
    except QueryError as e:
        return [e.code]
    nodes, edges, out = q.nodes(), {e.alias: e for e in q.edges()}, []
    if schema.labels and any(n.label and n.label not in schema.labels for n in nodes.values()):
        out.append("UNKNOWN_LABEL")
    if schema.relations and any(t not in schema.relations for e in edges.values() for t in e.types):
        out.append("UNKNOWN_REL")
    for alias, name in sorted(properties(q)):
        if alias not in nodes and alias not in edges:
            out.append("UNDEFINED_ALIAS")
        elif name != "service_rel_type" and not (
            schema.allows_property(name, label=nodes[alias].label) if alias in nodes
            else any(schema.allows_property(name, relation=t) for t in edges[alias].types or (None,))
        ):
            out.append("ILLEGAL_PROPERTY")
    for e in edges.values():
        ends = nodes[e.source].label, nodes[e.target].label
        for s in services(q, e.alias):
            native = "REFERENCE" if s in ("MENTIONS", "REFERENCES", "LINKS_TO") else "EVENT_ACTION"
            if e.types and native not in e.types and s not in e.types:
                out.append("WRONG_RELATION_TYPE")
            if native == "EVENT_ACTION" and all(ends) and not schema.allows_direction(ends[0], s, ends[1]):
                out.append("DIRECTION_MISMATCH")
        if "REFERENCE" in e.types and ends[0] in ("UnknownObject", "ExternalResource"):
            out.append("DIRECTION_MISMATCH")
    return list(dict.fromkeys(out))


@dataclass(frozen=True)
class Template:
    """A query with $slots, and what a rendered query has to keep to."""

    template_id: str
    skeleton: str
    covered: tuple[str, ...] = ()
    services_allowed: tuple[str, ...] = ()
    hop_limit: int = 2
    forbid_placeholders: bool = True
    forbid_inner: tuple[str, ...] = ("UnknownObject", "ExternalResource")
    properties: tuple[str, ...] = ("entity_id", "service_rel_type", "event_time", "source_event_time", "tar_entity_match_text",
                                   "tar_entity_match_pattern_type", "url_raw", "url_domain_etld1")
    prefix_slots: tuple[str, ...] = ()


def template_codes(text: str, template: Template, slots: dict, hop_zero_is_two: bool = False) -> list[str]:
    """Faults of a rendered query against its template. hop_zero_is_two reads a limit of no hops as two."""
    try:
        q = parse(text)
    except QueryError as e:
        return [e.code]
    out, edges, nodes = [], q.edges(), q.nodes()
    if any(t not in NATIVE_RELATIONS for e in edges for t in e.types):
        out.append("NON_NATIVE_REL_TYPE")
    if template.services_allowed and not services(q):
        out.append("MISSING_SERVICE_FILTER")
    limit = 2 if hop_zero_is_two and template.hop_limit == 0 else template.hop_limit
    if len(edges) > limit:
        out.append("HOP_LIMIT_EXCEEDED")
    if template.forbid_placeholders and re.search("COUPLES_WITH|RESOLVES", text):
        out.append("PLACEHOLDER_REL_FORBIDDEN")
    for name in nodes.values():
        if name.label in template.forbid_inner and any(e.target == name.alias for e in edges) and any(e.source == name.alias for e in edges):
            out.append("FORBIDDEN_INTERMEDIATE_NODE")
    if any(p not in template.properties for _, p in properties(q)):
        out.append("TEMPLATE_PROPERTY_NOT_ALLOWED")
    for slot in template.prefix_slots:
        if not slots.get(slot):
            out.append("REPO_SCOPE_PREFIX_MISSING")
        elif f"STARTS WITH '{slots[slot]}'" not in text:
            out.append("REPO_SCOPE_CONSTRAINT_MISSING")
    return list(dict.fromkeys(out))


def describe(schema: Schema) -> dict:
    """A schema as the mapping that readers.read_schema takes; written apart from hand-kept files."""
    return {
        "allowed_node_labels": sorted(schema.labels), "allowed_relationship_types": sorted(schema.relations),
        "allowed_properties": sorted(schema.properties), "properties_by_relation": {k: sorted(v) for k, v in sorted(schema.by_relation.items())},
        "direction_constraints": sorted(schema.directions),
    }
