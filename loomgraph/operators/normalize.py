"""Noisy event and reference rows to a property graph: two DataFrames and a count of skipped rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.clean import first_present, first_url, is_placeholder, normal_time, raw_time, url_host, url_parts
from loomgraph.functions.rules import action_service, action_verb, native_relation, node_label, reference_service, resolved_id
from loomgraph.vocabulary import DEFAULT_LABELS

#: Accepted column names of each field, in order of preference. Aggregated names come first unless told otherwise.
ALIASES = {
    "source_entity_id": ("src_entity_id_agg", "source_entity_id", "src_entity_id", "source_id", "src_id", "source"),
    "source_entity_type": ("src_entity_type_agg", "source_entity_type", "src_entity_type", "source_type", "src_type"),
    "target_entity_id": ("tar_entity_id_agg", "target_entity_id", "tar_entity_id", "target_id", "dst_id", "target"),
    "target_entity_type": (
        "tar_entity_type_fine_grained", "tar_entity_type_agg", "target_entity_type", "tar_entity_type", "target_type", "dst_type",
    ),
    "relation_type": ("relation_type", "edge_type", "relation", "relation_label_id"),
    "relation_label_repr": ("relation_label_repr", "relation_label"),
    "event_type": ("event_type",),
    "event_trigger": ("event_trigger", "trigger"),
    "event_time": ("event_time", "timestamp", "time"),
    "source_event_id": ("source_event_id", "event_id"),
}
_AGGREGATED = ("src_entity_id_agg", "src_entity_type_agg", "tar_entity_id_agg", "tar_entity_type_agg", "tar_entity_type_fine_grained")
#: Evidence columns that stay columns of their own; every other unused one goes into the map aux.
EVIDENCE = (
    "match_text", "match_pattern", "object_properties", "multiplicity", "weight", "tar_entity_match_text",
    "tar_entity_match_pattern_type", "tar_entity_objnt_prop_dict",
)
ORDINAL = "_ord"


@dataclass
class PropertyGraph:
    """nodes(node_uid, label, entity_id, raw_entity_type) and edges, a bag; skipped counts rows without an end."""

    nodes: DataFrame
    edges: DataFrame
    records: DataFrame | None = None
    #: The same graph with numbered edges, once a query has asked for it.
    numbered: PropertyGraph | None = field(default=None, repr=False, compare=False)

    def summary(self) -> DataFrame:
        """node_count, edge_count and skipped_records, one row."""
        n = self.nodes.agg(F.count(F.lit(1)).alias("node_count"))
        e = self.edges.agg(F.count(F.lit(1)).alias("edge_count"))
        s = self.records.agg(F.coalesce(F.sum(F.when(F.col("skipped"), self.rows_of_record())), F.lit(0)).cast("long").alias("skipped_records"))
        return n.crossJoin(e).crossJoin(s)  # three single rows

    def rows_of_record(self) -> Column:
        """How many rows a row of records stands for: one, or the count of a stored graph."""
        return F.col("n") if "n" in self.records.columns else F.lit(1)

    def inject_edges(self, more: DataFrame) -> PropertyGraph:
        """The graph with edges of relations that no record makes, such as RESOLVES; missing columns become null."""
        if "edge_uid" in self.edges.columns and "edge_uid" not in more.columns:
            more = more.withColumn("edge_uid", -1 - F.monotonically_increasing_id())
        return PropertyGraph(self.nodes, self.edges.unionByName(more, allowMissingColumns=True), self.records)


def with_ordinal(rows: DataFrame, *order: Column | str) -> DataFrame:
    """rows with their 0-based place in the given order, as unknown ids and edge numbers need it.

    Rows are range-partitioned, numbered in each partition and written; then the counts of the partitions before are added,
    one small row each. No task gets all rows, and no row leaves the JVM.
    """
    from loomgraph.operators.store import scratch_path

    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, "ordered")
    numbered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(ORDINAL, F.monotonically_increasing_id())
    numbered.write.mode("overwrite").parquet(path)
    held = spark.read.schema(numbered.schema).parquet(path)
    part, place = F.shiftright(ORDINAL, 33), F.col(ORDINAL).bitwiseAND(F.lit(2**33 - 1))
    counts = held.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("__part", F.coalesce(before, F.lit(0)).alias("__start"))  # one row for each partition
    out = held.join(F.broadcast(starts), part == F.col("__part"))
    return out.select(*rows.columns, (F.col("__start") + place).alias(ORDINAL))


def parse_records(rows: DataFrame, prefer_aggregated: bool = True) -> DataFrame:
    """The ten fields of a record from whichever alias columns exist, the evidence columns, and aux for the rest."""
    have = set(rows.columns)
    out = []
    for field, names in ALIASES.items():
        names = [n for n in names if n in have and (prefer_aggregated or n not in _AGGREGATED)]
        out.append((first_present(*names) if names else F.lit(None).cast("string")).alias(field))
    used = {n for names in ALIASES.values() for n in names} | set(_AGGREGATED) | {ORDINAL}
    out += [(F.col(n).cast("string") if n in have else F.lit(None).cast("string")).alias(n) for n in EVIDENCE]
    rest = [n for n in rows.columns if n not in used and n not in EVIDENCE]
    pairs = [x for n in rest for x in (F.lit(f"aux_{n}"), F.col(n).cast("string"))]
    aux = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()) if pairs else F.create_map()
    ordinal = F.col(ORDINAL) if ORDINAL in have else F.lit(None).cast("long")
    return rows.select(ordinal.alias(ORDINAL), *out, aux.cast("map<string,string>").alias("aux"))


def edge_stage() -> dict[str, Column]:
    """What several edge properties are made of, as columns of a projection of their own."""
    native = native_relation("relation_type")
    action = native == "EVENT_ACTION"
    return {
        "__native": native, "__verb": F.when(action, action_verb("relation_label_repr", "event_trigger")).otherwise(F.lit("")),
        "__url": F.when(~action, first_url("tar_entity_match_text", trimmed=True)),
    }


def edge_expressions() -> list[Column]:
    """Edge properties of a parsed record with the columns of edge_stage()."""
    native, verb = F.col("__native"), F.col("__verb")
    action = native == "EVENT_ACTION"
    service = F.when(action, action_service(verb)).otherwise(
        reference_service("tar_entity_match_pattern_type", "tar_entity_match_text")
    )
    url = url_parts("__url", "__host")
    return [
        native.alias("rel_type"), native.alias("native_rel_type"), service.alias("service_rel_type"),
        verb.alias("eventaction_verb_label"), F.col("relation_label_repr").alias("raw_relation_label_repr"),
        F.col("relation_type").alias("raw_relation_type"), F.col("event_type").alias("raw_event_type"),
        F.col("event_trigger").alias("raw_event_trigger"), F.col("source_event_id"), raw_time("event_time").alias("event_time"),
        normal_time("event_time").alias("source_event_time"),
        *[F.when(~action, url[n]).alias(n) for n in ("url_raw", "url_host", "url_domain_etld1", "url_is_github")],
    ]


def normalize(
    rows: DataFrame, labels: dict[str, str] = DEFAULT_LABELS, policy: str = "skip", prefer_aggregated: bool = True
) -> PropertyGraph:
    """Rows to a graph. Policy `unknown` needs the column _ord, the place of each row in its input.

    Both ends of an edge stand on the edge itself, so patterns rarely join nodes. A node that several rows name takes the
    raw type of the last, a source before the target of its row; without _ord the order is that of the type.
    """
    parsed = parse_records(rows, prefer_aggregated)
    context = (F.col("relation_label_repr"), F.col("event_trigger"), F.col("tar_entity_match_text"), F.to_json("aux"))
    ordinal = F.coalesce(F.col(ORDINAL), F.lit(0))
    if policy == "skip":
        # it gives no labels, so plain columns do; structs would be copied from projection to projection
        known = lambda c: F.when(~is_placeholder(c), F.col(c))
        none = F.lit(None).cast("string")
        ends = parsed.withColumns({"s_id": known("source_entity_id"), "t_id": known("target_entity_id"), "s_given": none, "t_given": none})
    else:
        ends = parsed.select(
            "*",
            resolved_id(F.col("source_entity_id"), "source", policy, ordinal, *context).alias("s"),
            resolved_id(F.col("target_entity_id"), "target", policy, ordinal, *context).alias("t"),
        ).select("*", *[F.col(f"{e}.{f}").alias(f"{e}_{n}") for e in "st" for f, n in (("entity_id", "id"), ("label", "given"))]).drop("s", "t")
    records = ends.select((F.col("s_id").isNull() | F.col("t_id").isNull()).alias("skipped"))
    kept = ends.where(F.col("s_id").isNotNull() & F.col("t_id").isNotNull())
    uid = lambda label, i: F.concat(label, F.lit(":"), F.col(i))
    s_label, t_label = F.col("__s_label"), F.col("__t_label")
    staged = kept.withColumns(
        {
            "__s_label": F.coalesce("s_given", node_label("source_entity_type", labels)),
            "__t_label": F.coalesce("t_given", node_label("target_entity_type", labels)), **edge_stage(),
        }
    )
    edges = staged.withColumn("__host", url_host("__url")).select(
        F.col(ORDINAL), uid(s_label, "s_id").alias("source_node_uid"), uid(t_label, "t_id").alias("target_node_uid"),
        s_label.alias("src_label"), F.col("s_id").alias("src_entity_id"), t_label.alias("dst_label"), F.col("t_id").alias("dst_entity_id"),
        *edge_expressions(), *EVIDENCE, "aux",
    )
    side = lambda end, raw, k: F.struct(
        F.col(f"{end}_id").alias("entity_id"), F.col(f"{end}_given").alias("given"), F.col(raw).alias("raw_entity_type"), (2 * ordinal + k).alias("at")
    )
    seen = kept.select(F.explode(F.array(side("s", "source_entity_type", 0), side("t", "target_entity_type", 1))).alias("n")).select("n.*")
    # The last place of each raw type is a number, which a hash aggregate can hold; text in max_by takes a sort, so it gets
    # only one row for each node and raw type, dealt by node so that it is sorted once.
    typed = seen.groupBy("entity_id", "given", "raw_entity_type").agg(F.max("at").alias("at"))
    typed = typed.withColumn("label", F.coalesce("given", node_label("raw_entity_type", labels))).repartition("entity_id", "label")
    last = F.max_by("raw_entity_type", F.struct("at", F.coalesce("raw_entity_type", F.lit(""))))
    nodes = typed.groupBy("entity_id", "label").agg(last.alias("raw_entity_type")).select(
        uid(F.col("label"), "entity_id").alias("node_uid"), "label", "entity_id", "raw_entity_type"
    )
    return PropertyGraph(nodes, edges, records)
