"""Classification rules as pure Column expressions; the first condition that holds decides."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.functions.clean import col, first_url, is_missing, is_placeholder, safe_text, verb_from_label
from loomgraph.vocabulary import (
    AMBIGUOUS_PATTERNS,
    DEFAULT_LABELS,
    EXTERNAL_TYPES,
    INTERNAL_PATTERNS,
    KEYWORD_FALLBACK,
    KEYWORD_RELATIONS,
    NATIVE_TYPES,
    REFERENCED_PATTERNS,
    TRIGGER_VERBS,
    VERBS,
)


def lookup(mapping: dict[str, str], key: Column) -> Column:
    """A literal map as an expression; null for keys that it lacks."""
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.try_element_at(table, key)


def node_label(raw_type: Column | str, labels: dict[str, str] = DEFAULT_LABELS) -> Column:
    return F.coalesce(lookup(labels, F.lower(F.trim(col(raw_type)))), F.lit("Object"))


def native_relation(raw: Column | str) -> Column:
    """REFERENCE for exactly Reference; anything else, null included, is an action."""
    return F.when(F.trim(col(raw)) == "Reference", "REFERENCE").otherwise("EVENT_ACTION")


def _external(pattern: Column, text: Column) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    return (pattern == "GitHub_Service_External_Links") | (
        (t.contains("http://") | t.contains("https://")) & ~t.contains("github")
    )


def reference_service(pattern: Column | str, text: Column | str) -> Column:
    p = F.trim(F.coalesce(col(pattern), F.lit("")))
    return (
        F.when(_external(p, col(text)), "LINKS_TO").when(p.isin("Repo", "Actor"), "MENTIONS")
        .when(p.isin(*REFERENCED_PATTERNS), "REFERENCES").when(p == "GitHub_Other_Service", "LINKS_TO").otherwise("REFERENCES")
    )


def action_verb(label: Column | str, trigger: Column | str) -> Column:
    """The verb in the label; only where it has none, the trigger's."""
    named = verb_from_label(F.coalesce(col(label), F.lit("")))
    return F.when(named != "", named).otherwise(F.coalesce(lookup(TRIGGER_VERBS, F.trim(col(trigger))), F.lit("")))


def action_service(verb: Column | str) -> Column:
    """The service relation of a known verb; empty for others, which don't fall back to the trigger."""
    snake = lambda v: re.sub("([a-z0-9])([A-Z])", r"\1_\2", v).upper()
    return F.coalesce(lookup({v: snake(v) for v in VERBS}, col(verb)), F.lit(""))


def keyword_relation(text: Column | str, rules=KEYWORD_RELATIONS, fallback: str = KEYWORD_FALLBACK) -> Column:
    """The older vocabulary: the first rule of which a keyword occurs in the text. rules are (keywords, name) in order."""
    t, out = F.lower(F.coalesce(col(text), F.lit(""))), F.lit(fallback)
    for keys, name in reversed(rules):
        hit = t.contains(keys[0])
        for k in keys[1:]:
            hit = hit | t.contains(k)
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def node_type(raw: Column | str, source: Column | str) -> Column:
    """struct(normalized_type, action, reason, priority, notes) for a raw type seen in a column."""
    t, fine = safe_text(raw), col(source) == "tar_entity_type_fine_grained"
    hint = F.concat(F.lit("external_type_hint="), t)

    def to(kind, action: str, reason: str, priority: int, notes=None) -> Column:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return F.struct(
            kind.alias("normalized_type"), F.lit(action).alias("action"), F.lit(reason).alias("reason"),
            F.lit(priority).alias("priority"), (F.lit("") if notes is None else notes).alias("notes"),
        )

    return (
        F.when(t == "", to("UnknownObject", "unknown", "missing_or_empty_type", 1000))
        .when(t.isin(*NATIVE_TYPES), to(t, "map", "native_gh_core_type", 10))
        .when(fine & t.isin(*EXTERNAL_TYPES[2:]), to("UnknownObject", "unknown", "ambiguous_github_internal_path", 20, hint))
        .when(t.isin(*EXTERNAL_TYPES), to("ExternalResource", "external", "link_or_service_pattern", 20, hint))
        .when(fine & t.isin(*AMBIGUOUS_PATTERNS), to("UnknownObject", "unknown", "ambiguous_fine_grained_type", 30, hint))
        .when(t == "Object", to("UnknownObject", "unknown", "generic_object_type", 40))
        .otherwise(to("UnknownObject", "unknown", "unrecognized_raw_type", 50, hint))
    )


def row_type(raw: Column | str, pattern: Column | str, text: Column | str) -> Column:
    """The type of a row's entity: native types stay, links and other services are external, all else is unknown."""
    t, p = safe_text(raw), F.trim(F.coalesce(col(pattern), F.lit("")))
    outside = _external(p, col(text)) | p.isin(*EXTERNAL_TYPES)
    return F.when(t.isin(*NATIVE_TYPES), t).when(outside, "ExternalResource").otherwise("UnknownObject")


def pilot_failure(text: Column | str, reason: Column | str, codes: Column) -> Column:
    """What a generated query failed at: nothing generated, by the reason given; text that doesn't parse; or the schema."""
    broken = ("EMPTY_QUERY", "MISSING_MATCH", "MISSING_RETURN", "UNBALANCED_PARENTHESES", "UNBALANCED_BRACKETS")
    why = F.coalesce(col(reason), F.lit(""))
    empty = F.when(why.contains("template"), "missing_template").when(why.contains("slot"), "missing_slot").otherwise("abstain_or_empty")
    return (
        F.when(F.trim(F.coalesce(col(text), F.lit(""))) == "", empty).when(F.size(codes) == 0, F.lit(None))
        .when(F.arrays_overlap(codes, F.array(*[F.lit(c) for c in broken])), "parse_error").otherwise("schema_mismatch")
    )


def _three(names: tuple[str, str, str], *values: str) -> Column:
    return F.struct(*[F.lit(v).alias(n) for n, v in zip(names, values, strict=True)])


def target_kind(pattern: Column | str, text: Column | str) -> Column:
    """struct(kind, confidence, rule) of what a reference points at."""
    p = F.trim(F.coalesce(col(pattern), F.lit("")))
    names = ("kind", "confidence", "rule")
    return (
        F.when(_external(p, col(text)), _three(names, "EXTERNAL", "high", "rule_a1"))
        .when(p == "GitHub_Other_Service", _three(names, "GH_SEMI", "med", "rule_a2"))
        .when(p.isin("Repo", "Actor", "Issue_PR", "SHA"), _three(names, "GH_INTERNAL", "high", "rule_a3"))
        .when(p.isin(*INTERNAL_PATTERNS), _three(names, "GH_INTERNAL", "med", "rule_a3"))
        .otherwise(_three(names, "GH_SEMI", "low", "rule_a4_unknown_pattern"))
    )


def service_hint(pattern: Column | str, text: Column | str) -> Column:
    """struct(hint, confidence, rule) of the service relation of a reference."""
    p = F.trim(F.coalesce(col(pattern), F.lit("")))
    names = ("hint", "confidence", "rule")
    return (
        F.when(_external(p, col(text)), _three(names, "LINKS_TO", "high", "rule_b1"))
        .when(p.isin("Repo", "Actor"), _three(names, "MENTIONS", "high", "rule_b2"))
        .when(p.isin(*REFERENCED_PATTERNS), _three(names, "REFERENCES", "med", "rule_b3"))
        .when(p == "GitHub_Other_Service", _three(names, "LINKS_TO", "med", "rule_b35"))
        .otherwise(_three(names, "REFERENCES", "low", "rule_b4"))
    )


def confident_hint(hint: Column, pattern: Column | str, has_object_id: Column, fine_type: Column | str) -> Column:
    """The hint after its overrides: object ids raise it, ambiguous patterns set it by the fine type."""
    p = F.trim(F.coalesce(col(pattern), F.lit("")))
    named = p.isin("Repo", "Actor") & has_object_id
    kind = F.when(named, F.lit("MENTIONS")).otherwise(hint["hint"])
    level = F.when(p.isin(*AMBIGUOUS_PATTERNS), F.when(col(fine_type).isin(*NATIVE_TYPES), "high").otherwise("med")).when(
        named | (has_object_id & (hint["hint"] == "REFERENCES")), "high"
    ).otherwise(hint["confidence"])
    return F.struct(kind.alias("hint"), level.alias("confidence"), hint["rule"].alias("rule"))


def evidence_fields(*columns: str) -> Column:
    """Names of the columns that aren't missing, in order."""
    return F.array_compact(F.array(*[F.when(~is_missing(c), F.lit(c)) for c in columns]))


def broken_id(entity_id: Column | str) -> Column:
    """Ids that ended up blank or with None for a number."""
    t = safe_text(entity_id)
    return (t == "") | t.endswith("_None")


def resolved_id(entity_id: Column, side: str, policy: str, ordinal: Column, *context: Column) -> Column:
    """struct(entity_id, label) under a placeholder policy; entity_id null where the record is to be skipped.

    label is set where the policy names one. policy: skip, unknown or external_if_url.
    """
    if policy not in ("skip", "unknown", "external_if_url"):
        raise ValueError(f"unknown placeholder policy {policy}")
    text = F.lit(None).cast("string")
    pair = lambda i, label: F.struct(i.alias("entity_id"), label.alias("label"))
    kept = pair(entity_id, text)
    unknown = pair(F.concat(F.lit(f"unknown:{side}:"), ordinal.cast("string")), F.lit("UnknownObject"))
    if policy == "skip":
        other = pair(text, text)
    elif policy == "unknown":
        other = unknown
    else:
        url = first_url(*context, trimmed=True)
        other = F.when(url.isNotNull(), pair(url, F.lit("ExternalResource"))).otherwise(unknown)
    return F.when(is_placeholder(entity_id), other).otherwise(kept)


def failure_category(codes: Column, pending: Column, mode: str) -> Column:
    """What a query failed at, from its error codes; null if it didn't fail."""
    has = lambda *names: F.arrays_overlap(codes, F.array(*[F.lit(n) for n in names]))
    return (
        F.when(pending, "injection_pending_skipped").when(F.size(codes) == 0, F.lit(None))
        .when(has("MISSING_REQUIRED_SLOT"), "missing_required_slot")
        .when(has("REPO_SCOPE_PREFIX_MISSING", "REPO_SCOPE_CONSTRAINT_MISSING"), "repo_scope_missing_prefix")
        .when(has("MISSING_SERVICE_FILTER"), "missing_service_filter").when(has("HOP_LIMIT_EXCEEDED"), "hop_limit_exceeded")
        .when(has("PLACEHOLDER_REL_FORBIDDEN"), "forbidden_placeholder")
        .when(has("FORBIDDEN_INTERMEDIATE_NODE"), "forbidden_intermediate_node")
        .when(has("TEMPLATE_PROPERTY_NOT_ALLOWED"), "property_not_whitelisted")
        .when(
            has("UNKNOWN_LABEL", "UNKNOWN_REL", "ILLEGAL_PROPERTY", "DIRECTION_MISMATCH", "EMPTY_QUERY", "MISSING_MATCH",
                "MISSING_RETURN", "UNBALANCED_PARENTHESES", "UNBALANCED_BRACKETS"),
            "schema_static_invalid",
        )
        .otherwise("other_controlled_reject" if mode == "controlled" else "schema_static_invalid")
    )


def query_level(explicit: Column | str, query_type: Column | str) -> Column:
    """An explicit level, else the one that the type starts with, else comprehensive."""
    t = F.lower(col(query_type))
    return F.coalesce(
        F.nullif(F.trim(col(explicit)), F.lit("")), F.when(t.rlike("^l[1-4]_"), F.upper(F.substring(t, 1, 2))), F.lit("comprehensive")
    )
