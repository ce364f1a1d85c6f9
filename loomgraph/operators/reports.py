"""Counting, ranking and sampling operators behind the mapping and repair reports. All results are DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.clean import is_missing, safe_text
from loomgraph.functions.rules import confident_hint, node_type, service_hint, target_kind
from loomgraph.operators.normalize import PropertyGraph



def _n() -> Column:
    return F.count(F.lit(1)).alias("n")


def value_counts(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(_n())


def top_counts(rows: DataFrame, key: str, k: int) -> DataFrame:
    """The k largest counts; ties by key."""
    return value_counts(rows, key).orderBy(F.desc("n"), key).limit(k)


def tail(rows: DataFrame, key: str, k: int) -> DataFrame:
    """How many rows and keys lie beyond the k largest counts, from the totals and the top k."""
    counts = value_counts(rows, key)
    top = counts.orderBy(F.desc("n"), key).limit(k).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("top_n"), F.count(F.lit(1)).alias("top_keys"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("keys"))
    return total.crossJoin(top).select((F.col("n") - F.col("top_n")).alias("tail_n"), (F.col("keys") - F.col("top_keys")).alias("tail_keys"))


def rare(rows: DataFrame, key: str, k: int) -> DataFrame:
    """Counts with a mark on the k smallest; ties by key."""
    counts = value_counts(rows, key)
    least = counts.orderBy("n", key).limit(k).select(F.col(key).alias("__k"))
    return counts.join(F.broadcast(least), F.col(key).eqNullSafe(F.col("__k")), "left").select(
        key, "n", F.col("__k").isNotNull().alias("rare")
    )  # at most k rows are broadcast


def ratios(rows: DataFrame, key: str) -> DataFrame:
    counts = value_counts(rows, key)
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(total).select(key, "n", F.round(F.col("n") / F.col("total"), 6).alias("ratio"))


def coverage(rows: DataFrame, key: str) -> DataFrame:
    """Counts in key order with their place and the share that they and all before them cover. Keys are a fixed vocabulary."""
    order = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    counts = value_counts(rows, key)
    return counts.select(
        key, "n", F.row_number().over(Window.orderBy(key)).alias("k"),
        F.round(F.sum("n").over(order) / F.sum("n").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), 6).alias("coverage"),
    )


def delta(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Counts before and after over the union of keys."""
    a = value_counts(before, key).select(F.col(key).alias("a_key"), F.col("n").alias("a_n"))
    b = value_counts(after, key).select(F.col(key).alias("b_key"), F.col("n").alias("b_n"))
    x, y = F.coalesce("a_n", F.lit(0)), F.coalesce("b_n", F.lit(0))
    return a.join(b, F.col("a_key").eqNullSafe(F.col("b_key")), "full_outer").select(
        F.coalesce("a_key", "b_key").alias(key), x.alias("before"), y.alias("after"), (y - x).alias("delta")
    )


def first_per_group(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], k: int) -> DataFrame:
    """The first k rows of each group; Spark keeps k a task and group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r")


def keep_last(rows: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """One row for each key: the last by order. A partial aggregate, not a window."""
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__last"))
    return last.select(*keys, *[F.col(f"__last.{c}").alias(c) for c in rest])


def collapse(rows: DataFrame, keys: tuple[str, ...], lists: dict[str, str]) -> DataFrame:
    """Groups with the sorted distinct non-empty values of some columns joined by |, and their size."""
    joined = [F.array_join(F.sort_array(F.collect_set(F.nullif(safe_text(c), F.lit("")))), "|").alias(n) for n, c in lists.items()]
    return rows.groupBy(*keys).agg(*joined, _n())


def node_mapping(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The mapping of each distinct raw type of the columns, by column."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("raw_type_source"), safe_text(c).alias("raw_type")) for c in columns]))
    kinds = rows.select(pairs.alias("p")).select("p.*").distinct()
    return kinds.select("raw_type_source", "raw_type", node_type("raw_type", "raw_type_source").alias("m")).select(
        "raw_type_source", "raw_type", "m.*"
    )


def relation_mapping(rows: DataFrame) -> DataFrame:
    """Each reference row with its target kind, and its service hint after the overrides by object id and fine type."""
    p, t = "tar_entity_match_pattern_type", "tar_entity_match_text"
    c = lambda n: F.col(n) if n in rows.columns else F.lit(None).cast("string")
    refs = rows.where(F.trim("relation_type") == "Reference")
    has_id = F.coalesce(c("tar_entity_objnt_prop_dict").rlike("['\"](repo|actor)_id['\"]\\s*:\\s*[^N\\s]"), F.lit(False))
    hint = confident_hint(service_hint(p, t), p, has_id, F.coalesce(c("tar_entity_type_fine_grained"), F.lit("")))
    return refs.select("*", target_kind(p, t).alias("kind"), hint.alias("hint"))


def hint_counts(rows: DataFrame) -> DataFrame:
    p, t = "tar_entity_match_pattern_type", "tar_entity_match_text"
    refs = rows.where(F.trim("relation_type") == "Reference").select(target_kind(p, t).alias("k"), service_hint(p, t).alias("h"))
    return refs.groupBy(
        F.col("k.kind").alias("kind"), F.col("k.rule").alias("kind_rule"), F.col("h.hint").alias("hint"), F.col("h.confidence").alias("confidence")
    ).agg(_n())


def missing_fields(repaired: DataFrame, k: int = 20) -> DataFrame:
    """How often each part of an id was missing, most often first."""
    status = F.col("tar_entity_id_repair_status")
    none = F.array().cast("array<string>")
    names = F.when(status.startswith("failed_missing_fields:"), F.split(F.substring_index(status, ":", -1), ",")).otherwise(none)
    # statuses are counted first; only their few distinct values are taken apart
    counts = repaired.groupBy("tar_entity_id_repair_status").agg(_n())
    each = counts.select(F.explode(names).alias("field"), "n")
    return each.groupBy("field").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "field").limit(k)


def repair_priority(repaired: DataFrame, k: int = 30) -> DataFrame:
    """Fine types by how much a repair would bring: much missing and much recoverable first, hard kinds one step down."""
    status, kind = F.col("tar_entity_id_repair_status"), F.col("tar_entity_type_fine_grained")
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    g = repaired.where(safe_text(kind) != "").groupBy(kind.alias("kind")).agg(
        F.count(F.lit(1)).alias("total"), share(status.startswith("failed_missing")).alias("m"), share(status == "repaired").alias("r")
    )
    hard = reduce(lambda a, b: a | b, [F.lower("kind").contains(w) for w in ("sha", "branch_tag_ghdir", "external", "other_service")])
    level = F.when(F.col("m") > 0.5, F.when(F.col("r") >= 0.5, 0).otherwise(1)).otherwise(2)
    level = F.when(hard, F.least(level + 1, F.lit(2))).otherwise(level)
    return g.withColumn("rank", level).orderBy("rank", F.desc("total"), "kind").limit(k).select(
        "kind", "total", F.round("m", 6).alias("missing_ratio"), F.round("r", 6).alias("recoverable_ratio"),
        F.element_at(F.array(F.lit("HIGH"), F.lit("MEDIUM"), F.lit("LOW")), F.col("rank") + 1).alias("priority"),
    )


def endpoint_labels(graph: PropertyGraph) -> DataFrame:
    """Edges whose ends are both nodes, with the nodes' labels."""
    n = graph.nodes
    s = n.select(F.col("node_uid").alias("source_node_uid"), F.col("label").alias("source_label"))
    t = n.select(F.col("node_uid").alias("target_node_uid"), F.col("label").alias("target_label"))
    return graph.edges.join(s, "source_node_uid").join(t, "target_node_uid")


def inferred_schema(graph: PropertyGraph) -> DataFrame:
    """(kind, value, owner): labels, relations, directions, and the properties that occur at each label and relation."""
    e = graph.edges
    out = [
        e.select(F.explode(F.array("src_label", "dst_label")).alias("value")).select(F.lit("label").alias("kind"), "value"),
        e.select(F.lit("relation").alias("kind"), F.col("rel_type").alias("value")),
        e.select(F.lit("direction").alias("kind"), F.concat("src_label", F.lit("-[:"), "rel_type", F.lit("]->"), "dst_label").alias("value")),
    ]
    ends = ("source_node_uid", "target_node_uid", "src_label", "src_entity_id", "dst_label", "dst_entity_id")
    names = [c for c in e.columns if c not in ("_ord", "edge_uid", "aux", "rel_type", *ends)]
    there = F.concat(F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in names])), F.map_keys("aux"))
    out.append(e.select(F.explode(there).alias("p"), "rel_type").select(
        F.lit("relation property").alias("kind"), F.concat("rel_type", F.lit("."), "p").alias("value")))
    out.append(graph.nodes.select(F.explode(F.array(F.lit("entity_id"), F.lit("raw_entity_type"))).alias("p"), "label").select(
        F.lit("label property").alias("kind"), F.concat("label", F.lit("."), "p").alias("value")))
    return reduce(lambda a, b: a.unionByName(b), out).distinct()


def field_dictionary(rows: DataFrame) -> DataFrame:
    """For each column: rows, missing, distinct values, an example, whether it holds objects, and a hint how to parse it.

    One aggregate over all columns, then a row for each.
    """
    cells = []
    for c in rows.columns:
        t = F.trim(F.col(c).cast("string"))
        there = ~is_missing(F.col(c).cast("string"))
        share = lambda cond, there=there: F.coalesce(F.avg(F.when(there, F.when(cond, 1.0).otherwise(0.0))), F.lit(0.0))
        hint = (
            F.when(share(t.rlike(r"^-?\d+$")) > 0.8, "int").when(share(t.try_cast("double").isNotNull()) > 0.8, "float")
            .when(share(t.rlike(r"^\d{4}[-/]\d{2}[-/]\d{2}")) > 0.5, "datetime").when(share(t.rlike(r"^[\[{]")) > 0.5, "json_like").otherwise("string")
        )
        cells.append(
            F.struct(
                F.lit(c).alias("field"), F.count(F.lit(1)).alias("rows"), F.count_if(~there).alias("missing"),
                F.count_distinct(F.col(c)).alias("distinct_values"), F.min(F.when(there, t)).alias("example"),
                F.coalesce(F.bool_or(t.rlike(r"^[\[{].*[\]}]$")), F.lit(False)).alias("is_object"), hint.alias("parse_hint"),
            ).alias(f"f{len(cells)}")
        )
    one = rows.agg(*cells)
    return one.select(F.explode(F.array(*[F.col(f"f{i}") for i in range(len(cells))])).alias("f")).select("f.*")


def stratified_sample(rows: DataFrame, stratum: Column, n: int, seed: int = 42) -> DataFrame:
    """Half of n rows from the stratum and the rest from outside it, chosen and ordered by hash: the same rows each time."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in rows.columns]))
    marked = rows.withColumn("__k", key)
    inside = marked.where(stratum).orderBy("__k", *rows.columns).limit(n // 2)
    outside = marked.where(~F.coalesce(stratum, F.lit(False))).orderBy("__k", *rows.columns).limit(n - n // 2)
    return inside.unionByName(outside).orderBy("__k").drop("__k")


def metric_means(rows: DataFrame) -> DataFrame:
    """Means by generator: validity over examples, repair success over attempts, zero without any."""
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    tried = F.sum(F.when(F.col("attempted"), 1).otherwise(0))
    return rows.groupBy("generator").agg(
        F.count(F.lit(1)).alias("examples"), F.round(F.avg(one(F.col("valid"))), 6).alias("valid_rate"),
        F.round(F.coalesce(F.sum(one(F.col("attempted") & F.col("repaired"))) / F.nullif(tried, F.lit(0)), F.lit(0.0)), 6).alias("repair_rate"),
    )


def blank_ratio(rows: DataFrame, column: str) -> DataFrame:
    return rows.agg(F.avg(F.when(safe_text(column) == "", 1.0).otherwise(0.0)).alias("blank_ratio"))


def sentinels(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The spellings of missing values that occur in the columns, over all rows."""
    cells = rows.select(F.explode(F.array(*[F.col(c).cast("string") for c in columns])).alias("v"))
    return cells.where(is_missing("v") & F.col("v").isNotNull()).select(F.trim("v").alias("sentinel")).distinct()
