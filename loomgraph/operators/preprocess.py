"""Repair of reference rows: aggregation of entities, fine-grained types, ids rebuilt from their parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.clean import (
    commit_sha,
    first_nonempty,
    id_type,
    int_like,
    is_missing,
    issue_number,
    safe_text,
    with_object_map,
)
from loomgraph.functions.rules import broken_id
from loomgraph.vocabulary import ABBREVIATIONS

ADDED = ("src_entity_id_agg", "src_entity_type_agg", "tar_entity_id_agg", "tar_entity_type_agg", "tar_entity_type_fine_grained")
INPUT = (
    "src_entity_id", "src_entity_type", "tar_entity_id", "tar_entity_type", "relation_type", "relation_label_id",
    "relation_label_repr", "event_id", "event_type", "event_trigger", "event_time", "tar_entity_match_text",
    "tar_entity_match_pattern_type", "tar_entity_objnt_prop_dict",
)
#: Property names that hold each part of an id, in order of preference.
PART_NAMES = {
    "repo_id": ("repo_id",),
    "actor_id": ("actor_id",),
    "issue_number": ("issue_number", "number"),
    "comment_id": (
        "comment_id", "issue_comment_id", "pull_review_comment_id", "review_comment_id", "commit_comment_id", "id",
    ),
    "review_id": ("review_id", "pull_review_id", "pull_request_review_id"),
    "commit_sha": ("commit_sha", "sha"),
    "branch_name": ("branch_name",),
    "tag_name": ("tag_name",),
    "release_id": ("release_id", "id"),
    "push_id": ("push_id",),
}
#: For each type: the parts that its id needs, and the id with a mark for each part.
FORMATS = {
    "Actor": (("actor_id",), "A_{actor_id}"),
    "Repo": (("repo_id",), "R_{repo_id}"),
    "Issue": (("repo_id", "issue_number"), "I_{repo_id}#{issue_number}"),
    "PullRequest": (("repo_id", "issue_number"), "PR_{repo_id}#{issue_number}"),
    "IssueComment": (("repo_id", "issue_number", "comment_id"), "IC_{repo_id}#{issue_number}#{comment_id}"),
    "PullRequestReview": (("repo_id", "issue_number", "review_id"), "PRR_{repo_id}#{issue_number}#prr-{review_id}"),
    "PullRequestReviewComment": (("repo_id", "issue_number", "comment_id"), "PRRC_{repo_id}#{issue_number}#r{comment_id}"),
    "Commit": (("repo_id", "commit_sha"), "C_{repo_id}@{commit_sha}"),
    "CommitComment": (("repo_id", "commit_sha", "comment_id"), "CC_{repo_id}@{commit_sha}#r{comment_id}"),
    "Branch": (("repo_id", "branch_name"), "B_{repo_id}:{branch_name}"),
    "Tag": (("repo_id", "tag_name"), "T_{repo_id}-{tag_name}"),
    "Release": (("repo_id", "release_id"), "RE_{repo_id}-{release_id}"),
    "Push": (("repo_id", "push_id"), "P_{repo_id}.{push_id}"),
}


def id_parts(
    props: Column, text: Column, row: dict[str, Column], aggregated_repo: Column | None = None, kind: Column | None = None
) -> dict[str, Column]:
    """Each part from the object's properties, then the row, then the match text; the repository last from its aggregate.

    A part is made only for rows whose type needs it, as `kind` says.
    """
    out = {}
    for part, names in PART_NAMES.items():
        sources = [F.try_element_at(props, F.lit(n)) for n in names]
        sources += [row[part]] if part in row else []
        if part == "issue_number":
            sources.append(issue_number(text))
        if part == "commit_sha":
            sources.append(commit_sha(text))
        if part == "repo_id" and aggregated_repo is not None:
            sources.append(F.regexp_extract(F.coalesce(aggregated_repo, F.lit("")), r"^R_(\d+)$", 1))
        there = F.coalesce(*[F.when(~is_missing(s.cast("string")), s.cast("string")) for s in sources], F.lit(""))
        value = F.lower(there) if part == "commit_sha" else int_like(there)
        users = [k for k, (needed, _) in FORMATS.items() if part in needed]
        out[part] = value if kind is None else F.when(kind.isin(*users), value).otherwise(F.lit(""))
    return out


def rebuilt_id(kind: Column, parts: dict[str, Column]) -> tuple[Column, Column, Column]:
    """entity_id, missing and supported: the id of its type, the sorted names of parts that it lacks, a known type."""
    ids, missing = F.lit(None).cast("string"), F.array().cast("array<string>")
    for name, (needed, form) in FORMATS.items():
        pieces = []
        for chunk in form.split("{"):
            field, mark, rest = chunk.partition("}")
            pieces += [parts[field], F.lit(rest)] if mark else [F.lit(chunk)]
        gaps = [parts[n] == "" for n in sorted(needed)]
        whole = ~reduce(lambda x, y: x | y, gaps)
        ids = F.when((kind == name) & whole, F.concat(*pieces)).otherwise(ids)
        lacking = F.array_compact(F.array(*[F.when(g, F.lit(n)) for g, n in zip(gaps, sorted(needed), strict=True)]))
        missing = F.when((kind == name) & ~whole, lacking).otherwise(missing)
    return ids, missing, F.coalesce(kind.isin(*FORMATS), F.lit(False))


def rebuild(rows: DataFrame, kind: Column, aggregated_repo: Column | None = None) -> DataFrame:
    """rows with entity_id, missing and supported.

    Properties and parts are columns of a projection each, so that later expressions read them and don't parse again.
    """
    have = set(rows.columns)
    c = lambda n: F.col(n).cast("string") if n in have else F.lit(None).cast("string")
    staged = rows if "__props" in have else with_object_map(rows, c("tar_entity_objnt_prop_dict"), "__props")
    staged = staged.select("*", safe_text(kind).alias("__kind"))
    given = {n: c(n) for n in PART_NAMES if n in have}
    parts = id_parts(F.col("__props"), c("tar_entity_match_text"), given, aggregated_repo, F.col("__kind"))
    staged = staged.select("*", *[v.alias(f"__part_{n}") for n, v in parts.items()])
    made = rebuilt_id(F.col("__kind"), {n: F.col(f"__part_{n}") for n in parts})
    out = [v.alias(n) for v, n in zip(made, ("entity_id", "missing", "supported"), strict=True)]
    return staged.select(*rows.columns, *out)


def repair(kind: Column, entity_id: Column, made: Column, missing: Column, supported: Column) -> Column:
    """struct(entity_id, status) after an attempt to repair a broken id."""
    fine = safe_text(kind)
    state = lambda i, s: F.struct(i.alias("entity_id"), s.alias("status"))
    return (
        F.when(fine == "", state(entity_id, F.lit("skipped_no_fine_grained")))
        .when(~broken_id(entity_id), state(entity_id, F.lit("skipped_not_needed")))
        .when(~supported, state(entity_id, F.concat(F.lit("failed_unsupported_type:"), fine)))
        .when(F.size(missing) > 0, state(entity_id, F.concat(F.lit("failed_missing_fields:"), F.array_join(missing, ","))))
        .otherwise(state(made, F.lit("repaired")))
    )


def aggregated(source_id: Column, source_type: Column, target_id: Column, props: Column, repo: Column) -> Column:
    """struct of the five-column aggregation: an actor stays itself, else its repository; a target by its properties.

    A property repo_id that is present but null leaves the target an Object.
    """
    actor = F.trim(source_type) == "Actor"
    has = lambda k: F.coalesce(F.map_contains_key(props, k), F.lit(False))
    value = lambda k: F.try_element_at(props, F.lit(k))
    repo_value, actor_value = value("repo_id"), value("actor_id")
    as_id = lambda letter, v: F.concat(F.lit(letter), int_like(v))
    kind = F.when(has("repo_id"), F.when(is_missing(repo_value), "Object").otherwise("Repo")).when(
        has("actor_id") & ~is_missing(actor_value), "Actor"
    ).otherwise("Object")
    return F.struct(
        F.when(actor, source_id).otherwise(F.concat(F.lit("R_"), repo)).alias("src_entity_id_agg"),
        F.when(actor, F.lit("Actor")).otherwise(F.lit("Repo")).alias("src_entity_type_agg"),
        F.when(kind == "Repo", as_id("R_", repo_value)).when(kind == "Actor", as_id("A_", actor_value)).otherwise(target_id).alias("tar_entity_id_agg"),
        kind.alias("tar_entity_type_agg"),
    )


def aggregated_by_prefix(target_id: Column, props: Column, target_type: Column) -> Column:
    """The target type where no parser applies: by the id's prefix, then the properties, then the type given."""
    by_id = id_type(target_id, {"Repo": "R", "Actor": "A"})
    has = lambda k: ~is_missing(F.try_element_at(props, F.lit(k)))
    return F.coalesce(by_id, F.when(has("repo_id"), "Repo").when(has("actor_id"), "Actor"), safe_text(target_type))


def fine_grained(pattern: Column, text: Column, entity_id: Column, source_type: Column) -> Column:
    """The type of a reference's target without remote lookups.

    Issue or pull request is told by the path of the matched URL, then by the id's prefix, then by the source's type.
    """
    p, t = safe_text(pattern), F.lower(F.coalesce(text, F.lit("")))
    number = F.when(t.contains("/pull/"), "PullRequest").when(t.contains("/issues/"), "Issue")
    number = F.coalesce(number, id_type(entity_id, {"Issue": "I", "PullRequest": "PR"}))
    number = F.coalesce(number, F.when(safe_text(source_type).startswith("PullRequest"), "PullRequest").otherwise("Issue"))
    return (
        F.when(p == "Issue_PR", number).when(p == "SHA", "Commit")
        .when(p == "Branch_Tag_GHDir", F.coalesce(id_type(entity_id, {"Branch": "B", "Tag": "T"}), F.lit("Branch_Tag_GHDir")))
        .otherwise(F.coalesce(id_type(entity_id, ABBREVIATIONS), F.nullif(p, F.lit(""))))
    )


def preprocess(rows: DataFrame, mode: str = "full") -> DataFrame:
    """rows with the added columns and tar_entity_id_repair_status; only Reference rows change.

    One projection, no split and write-back: rows of other relations pass the same expressions as nulls. Missing input
    columns are taken as null. Mode fast_exid leaves the aggregates that are there and repairs ids only.
    """
    if mode not in ("full", "fast_exid"):
        raise ValueError(f"unknown mode {mode}")
    have = set(rows.columns)
    c = lambda n: F.col(n).cast("string") if n in have else F.lit(None).cast("string")
    is_ref = F.coalesce(F.trim(c("relation_type")) == "Reference", F.lit(False))
    staged = with_object_map(rows, F.when(is_ref, c("tar_entity_objnt_prop_dict")), "__props")
    if mode == "full":
        repo = first_nonempty(
            F.regexp_extract(F.coalesce(c("src_entity_id"), F.lit("")), r"^[A-Z]+_(\d+)", 1), F.when(~is_missing(c("repo_id")), c("repo_id"))
        )
        agg = aggregated(c("src_entity_id"), c("src_entity_type"), c("tar_entity_id"), F.col("__props"), repo)
        agg = [agg[n] for n in ADDED[:4]]
        fine = fine_grained(c("tar_entity_match_pattern_type"), c("tar_entity_match_text"), c("tar_entity_id"), c("src_entity_type"))
    else:
        agg, fine = [c(n) for n in ADDED[:4]], safe_text(c(ADDED[4]))
    named = [F.when(is_ref, v).otherwise(c(n)).alias(f"__{n}") for n, v in zip(ADDED, [*agg, fine], strict=True)]
    staged = staged.select("*", *named)
    made = rebuild(staged, F.when(is_ref, F.col(f"__{ADDED[4]}")), F.col(f"__{ADDED[0]}"))
    fix = repair(F.col(f"__{ADDED[4]}"), c("tar_entity_id"), F.col("entity_id"), F.col("missing"), F.col("supported"))
    made = made.select("*", F.when(is_ref, fix).alias("__fix"))
    keep = [n for n in rows.columns if n not in (*ADDED, "tar_entity_id")]
    return made.select(
        *keep, F.when(is_ref, F.col("__fix.entity_id")).otherwise(c("tar_entity_id")).alias("tar_entity_id"),
        *[F.col(f"__{n}").alias(n) for n in ADDED], F.col("__fix.status").alias("tar_entity_id_repair_status"),
    )
