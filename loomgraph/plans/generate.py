"""Queries from slots: constant, template-first and constrained generators, and template rendering."""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

from loomgraph.plans.render import literal
from loomgraph.plans.validate import Schema, Template
from loomgraph.vocabulary import ABBREVIATIONS

#: Slot names of entity labels.
ENTITY_SLOTS = {
    "Repo": "repo_entity_id", "Actor": "actor_entity_id", "Issue": "issue_entity_id", "PullRequest": "pr_entity_id",
    "Commit": "commit_entity_id", "IssueComment": "issuecomment_entity_id", "PullRequestReview": "prreview_entity_id",
    "PullRequestReviewComment": "prreviewcomment_entity_id",
}
PREFIX_SLOTS = {"PullRequest": "pr_base_prefix", "Issue": "issue_base_prefix", "Commit": "commit_base_prefix"}
OPERATORS = ("=", "<>", "<", "<=", ">", ">=", "STARTS WITH", "ENDS WITH", "CONTAINS", "IN")
FREE_FORM = "MATCH (x:Entity)-[:RELATED_TO]->(y:Entity) RETURN x, y LIMIT 10"


@dataclass(frozen=True)
class Entity:
    label: str
    alias: str = ""
    value: str | None = None


@dataclass(frozen=True)
class Relation:
    kind: str
    source: str | None = None
    target: str | None = None


@dataclass(frozen=True)
class Condition:
    name: str
    operator: str = "="
    value: object = None
    of_relation: bool = False
    owner: str | None = None


@dataclass(frozen=True)
class Window:
    name: str
    start: str | None = None
    end: str | None = None
    of_relation: bool = False
    owner: str | None = None


@dataclass(frozen=True)
class Sort:
    name: str
    descending: bool = False
    limit: int = 25


@dataclass(frozen=True)
class Aggregation:
    function: str
    target: str = "*"
    alias: str = "value"


@dataclass(frozen=True)
class Slots:
    entities: tuple[Entity, ...] = ()
    relations: tuple[Relation, ...] = ()
    conditions: tuple[Condition, ...] = ()
    windows: tuple[Window, ...] = ()
    sorts: tuple[Sort, ...] = ()
    aggregations: tuple[Aggregation, ...] = ()

    @classmethod
    def parsed(cls, candidates: dict) -> Slots:
        """Slots from lists of mappings; entries without a name, and what isn't a mapping, are left out."""
        of = lambda kind, name: [x for x in candidates.get(kind) or [] if isinstance(x, dict) and x.get(name)]
        text = lambda v: None if v in (None, "") else str(v)
        owned = lambda x: {"of_relation": x.get("owner_kind", "node") != "node", "owner": text(x.get("owner_type"))}
        return cls(
            tuple(Entity(str(x["label"]), str(x.get("alias") or ""), None if x.get("value") is None else str(x["value"])) for x in of("entity_slots", "label")),
            tuple(Relation(str(x["rel_type"]), text(x.get("src_label")), text(x.get("dst_label"))) for x in of("relation_slots", "rel_type")),
            tuple(Condition(str(x["property_name"]), str(x.get("operator", "=")), x.get("value"), **owned(x)) for x in of("property_slots", "property_name")),
            tuple(Window(str(x["property_name"]), x.get("start"), x.get("end"), **owned(x)) for x in of("time_range_slots", "property_name")),
            tuple(Sort(str(x["property_name"]), str(x.get("order", "ASC")).upper() == "DESC", int(x.get("limit", 25))) for x in of("sort_slots", "property_name")),
            tuple(Aggregation(str(x["function"]).upper(), str(x.get("target", "*")), str(x.get("alias", "value"))) for x in of("aggregation_slots", "function")),
        )

    def accepted(self, schema: Schema) -> tuple[Slots, list[str]]:
        """The slots that the schema allows, and why the others were turned down. Windows belong to nodes."""
        refused: list[str] = []

        def kept(slots: tuple, why) -> tuple:
            reasons = [why(x) for x in slots]
            refused.extend(r for r in reasons if r)
            return tuple(x for x, r in zip(slots, reasons, strict=True) if not r)

        def owned(x) -> bool:
            return schema.allows_property(x.name, relation=x.owner) if x.of_relation else schema.allows_property(x.name, label=x.owner)

        def condition(c: Condition) -> str:
            return f"operator:{c.operator}" if c.operator.upper() not in OPERATORS else "" if owned(c) else f"property:{c.name}"

        listed = lambda name: not schema.properties or name in schema.properties
        out = Slots(
            kept(self.entities, lambda e: f"label:{e.label}" if schema.labels and e.label not in schema.labels else ""),
            kept(self.relations, lambda r: f"relation:{r.kind}" if schema.relations and r.kind not in schema.relations else ""),
            kept(self.conditions, condition), kept(self.windows, lambda w: f"time:{w.name}" if w.of_relation or not owned(w) else ""),
            kept(self.sorts, lambda x: "" if listed(x.name) else f"sort:{x.name}"),
            kept(self.aggregations, lambda g: "" if g.function.upper() in ("COUNT", "SUM", "AVG", "MIN", "MAX") else f"aggregation:{g.function}"),
        )
        return out, refused


def free_form() -> str:
    """A constant outside any schema: the baseline."""
    return FREE_FORM


def template_first(schema: Schema) -> str | None:
    """A scan of the first label; None without labels."""
    return f"MATCH (n:{min(schema.labels)}) RETURN n LIMIT 25" if schema.labels else None


#: Families of query shapes, in the order in which they are tried; a question's type may allow some of them only.
FAMILIES = ("join_traversal", "entity_filter")


def _traversals(slots: Slots, schema: Schema, trace: list[str]):
    """(source, relation, target) of the slots that the schema lets stand together."""
    entities = slots.entities or tuple(Entity(x) for x in sorted(schema.labels)[:2])
    relations = slots.relations or (tuple(Relation(r) for r in sorted(schema.relations)) if len(slots.entities) > 1 else ())
    for source, relation, target in itertools.product(entities, relations, entities):
        if relation.source not in (None, source.label) or relation.target not in (None, target.label) or source is target:
            trace.append(f"ends:{source.label}-{relation.kind}-{target.label}")
        elif not schema.allows_direction(source.label, relation.kind, target.label):
            trace.append(f"direction:{source.label}-[:{relation.kind}]->{target.label}")
        else:
            yield source, relation, target


def _fits(slots: Slots, schema: Schema, source: Entity, relation: Relation | None) -> bool:
    """Whether the first condition and window belong to what the shape binds."""
    for x in (*slots.conditions[:1], *slots.windows[:1]):
        if x.of_relation:
            if relation is None or not schema.allows_property(x.name, relation=x.owner or relation.kind):
                return False
        elif not schema.allows_property(x.name, label=x.owner or source.label):
            return False
    return True


def controlled(slots: Slots, schema: Schema, families: tuple[str, ...] = ()) -> tuple[str | None, list[str]]:
    """The first candidate of an allowed family that fits the schema; None to abstain, with the reasons.

    A traversal is tried before a single entity. Without families both are allowed.
    """
    slots, trace = slots.accepted(schema)
    for family in [f for f in FAMILIES if not families or f in families]:
        if family == "join_traversal":
            for source, relation, target in _traversals(slots, schema, trace):
                if _fits(slots, schema, source, relation):
                    return _rendered(slots, source, relation, target), trace
                trace.append(f"property:{source.label}-{relation.kind}")
        else:
            for entity in slots.entities or tuple(Entity(x) for x in sorted(schema.labels)[:1]):
                if _fits(slots, schema, entity, None):
                    return _rendered(slots, entity, None, None), trace
                trace.append(f"property:{entity.label}")
    return None, [*trace, "no shape fits"]


def _rendered(slots: Slots, source: Entity, relation: Relation | None, target: Entity | None) -> str:
    a, b = ("a", "b") if relation else ("n", None)
    tests = [f"{x}.entity_id = {literal(e.value)}" for x, e in ((a, source), (b, target)) if e is not None and e.value is not None]
    tests += [f"{a}.{c.name} {c.operator} {literal(c.value)}" for c in slots.conditions if c.value is not None]
    for w in slots.windows[:1]:
        tests += [f"{a}.{w.name} >= {literal(w.start)}"] * (w.start is not None) + [f"{a}.{w.name} <= {literal(w.end)}"] * (w.end is not None)
    pattern = f"({a}:{source.label})" + (f"-[:{relation.kind}]->({b}:{target.label})" if relation else "")
    out = a if b is None else f"{a}, {b}"
    for g in slots.aggregations[:1]:
        out = f"{g.function}({'*' if g.target == '*' else f'{a}.{g.target}'}) AS {g.alias}"
    sort = slots.sorts[0] if slots.sorts else None
    order = "" if sort is None else f" ORDER BY {a}.{sort.name} {'DESC' if sort.descending else 'ASC'}"
    where = f" WHERE {' AND '.join(tests)}" if tests else ""
    return f"MATCH {pattern}{where} RETURN {out}{order} LIMIT {sort.limit if sort else 25}"


def slot_values(candidates: dict, text: str, services: list[str], derive_year: bool = False) -> dict[str, str]:
    """Values of template slots from a query's candidates; derive_year lets a year in the text replace both time bounds."""
    out: dict[str, str] = {}
    entities = [e for e in candidates.get("entity_slots") or [] if isinstance(e, dict)]
    for e in entities:
        label, value = str(e.get("entity_label") or "").strip(), e.get("entity_id")
        if value:
            out.setdefault("source_entity_id", str(value))
            if label in ENTITY_SLOTS:
                out[ENTITY_SLOTS[label]] = str(value)
    number = re.fullmatch(r"R_(\d+)", out.get("repo_entity_id", ""))
    if number:
        labels = {str(e.get("entity_label") or "").strip() for e in entities}
        out |= {slot: f"{ABBREVIATIONS[x]}_{number[1]}" for x, slot in PREFIX_SLOTS.items() if x in labels}
    for t in (candidates.get("time_range_slots") or [])[:1]:
        out |= {k: str(t[v]) for k, v in (("time_start", "start"), ("time_end", "end")) if t.get(v)}
    year = re.search(r"(20\d\d|2100)", text or "") if derive_year else None
    if year:
        out |= {"time_start": f"{int(year[1]):04d}-01-01T00:00:00Z", "time_end": f"{int(year[1]) + 1:04d}-01-01T00:00:00Z"}
    if services:
        out |= {"ref_semantic": services[0], "ea_action_verb": services[0]}
    return out


def fill(template: Template, values: dict[str, str]) -> tuple[str, list[str]]:
    """The skeleton with its slots filled, and the names of those without a value."""
    missing = sorted({n for n in re.findall(r"\$(\w+)", template.skeleton) if n not in values})
    text = re.sub(r"\$(\w+)", lambda m: literal(values[m[1]]) if m[1] in values else m[0], template.skeleton)
    return " ".join(text.split()), missing
