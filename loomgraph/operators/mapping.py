"""Mapping tables between raw relations and the two tracks, service verbs, and how far they cover the edges."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.clean import safe_text
from loomgraph.functions.rules import evidence_fields, row_type
from loomgraph.operators.reports import relation_mapping
from loomgraph.vocabulary import VERBS

#: Columns of a mapping table, in order.
COLUMNS = (
    "raw_relation_type", "raw_event_type", "raw_label_repr", "source_norm_type", "target_norm_type", "normalized_rel", "dir", "confidence",
    "service_hint", "target_kind", "service_confidence", "action", "notes",
)
EVIDENCE = (
    "tar_entity_match_pattern_type", "tar_entity_match_text", "event_time", "tar_entity_objnt_prop_dict", "tar_entity_type_fine_grained",
    "tar_entity_type",
)


def _text(rows: DataFrame, name: str) -> Column:
    return safe_text(name) if name in rows.columns else F.lit("")


def _typed(rows: DataFrame, raw: str, alias: str) -> Column:
    return row_type(_text(rows, raw), _text(rows, "tar_entity_match_pattern_type"), _text(rows, "tar_entity_match_text")).alias(alias)


def _distinct(c: Column) -> Column:
    return F.array_join(F.sort_array(F.collect_set(F.nullif(c, F.lit("")))), "|")


def _table(rows: DataFrame) -> DataFrame:
    return rows.select(*COLUMNS)


def actions(rows: DataFrame) -> DataFrame:
    """Event actions by their raw event type, label and the normalised types of their ends, with counts."""
    events = rows.where(F.trim("relation_type") == "EventAction").select(
        _text(rows, "event_type").alias("raw_event_type"), _text(rows, "relation_label_repr").alias("raw_label_repr"),
        _typed(rows, "src_entity_type", "source_norm_type"), _typed(rows, "tar_entity_type", "target_norm_type"),
    )
    return events.groupBy(*events.columns).agg(F.count(F.lit(1)).alias("n"))


def references(rows: DataFrame) -> DataFrame:
    """References by the normalised types of their ends, target kind and service hint, with counts and the evidence used."""
    have = [c for c in EVIDENCE if c in rows.columns]
    mapped = relation_mapping(rows)
    cells = mapped.select(
        _typed(rows, "src_entity_type", "source_norm_type"), _typed(rows, "tar_entity_type", "target_norm_type"),
        F.col("hint.hint").alias("service_hint"), F.col("kind.kind").alias("target_kind"), F.col("hint.confidence").alias("service_confidence"),
        F.concat_ws("|", evidence_fields(*have)).alias("evidence"),
    )
    keys = [c for c in cells.columns if c != "evidence"]
    return cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), _distinct(F.col("evidence")).alias("evidence"))


def _action_row(notes: Column, **over: Column) -> list[Column]:
    fixed = {
        "raw_relation_type": "EventAction", "normalized_rel": "EVENT_ACTION", "dir": "S2T", "confidence": "high", "service_hint": "",
        "target_kind": "", "service_confidence": "", "action": "map",
    }
    return [over.get(c, notes if c == "notes" else F.lit(fixed.get(c, "*"))).alias(c) for c in COLUMNS]


def _reference_row(notes: Column) -> list[Column]:
    own = ("source_norm_type", "target_norm_type", "service_hint", "target_kind", "service_confidence")
    fixed = {"raw_relation_type": "Reference", "normalized_rel": "REFERENCE", "dir": "S2T", "action": "map"}
    pick = {c: F.col(c) for c in own} | {"confidence": F.col("service_confidence"), "notes": notes}
    return [pick.get(c, F.lit(fixed.get(c, ""))).alias(c) for c in COLUMNS]


def native_mapping(rows: DataFrame) -> DataFrame:
    """One row for each pair of end types of event actions, with all raw events and labels it stands for; references as they are."""
    grouped = actions(rows).groupBy("source_norm_type", "target_norm_type").agg(
        _distinct(F.col("raw_event_type")).alias("raw_event_type"), _distinct(F.col("raw_label_repr")).alias("raw_label_repr"), F.sum("n").alias("n")
    )
    count = F.to_json(F.struct(F.col("n").alias("rows")))
    own = {c: F.col(c) for c in ("raw_event_type", "raw_label_repr", "source_norm_type", "target_norm_type")}
    return _table(grouped.select(*_action_row(count, **own))).unionByName(_table(references(rows).select(*_reference_row(count))))


def minimal_mapping(rows: DataFrame) -> DataFrame:
    """One row for all event actions, and one for each kind, hint and confidence of references, whatever their ends."""
    spark = rows.sparkSession
    note = F.lit(json.dumps({"native_layer": True}))
    one = spark.range(1).select(*_action_row(note))
    kinds = references(rows).groupBy("service_hint", "target_kind", "service_confidence").agg(F.sum("n").alias("n"))
    kinds = kinds.withColumns({"source_norm_type": F.lit("*"), "target_norm_type": F.lit("*")})
    return _table(one).unionByName(_table(kinds.select(*_reference_row(F.to_json(F.struct(F.col("n").alias("rows")))))))


def service_verbs(spark: SparkSession) -> DataFrame:
    """(verb, service_rel_type, place): the known verbs in order with their relations."""
    snake = lambda v: re.sub("([a-z0-9])([A-Z])", r"\1_\2", v).upper()
    return spark.createDataFrame([(v, snake(v), k) for k, v in enumerate(VERBS)], "verb string, service_rel_type string, place int")


def verb_frequency(edges: DataFrame) -> DataFrame:
    """Verbs of event actions with their count and share; the blank verb is one of them."""
    counts = edges.where("rel_type = 'EVENT_ACTION'").groupBy(F.col("eventaction_verb_label").alias("verb")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(total).select("verb", "n", F.round(F.col("n") / F.col("total"), 4).alias("ratio"))  # one row


def verb_pairs(edges: DataFrame) -> DataFrame:
    """How often each verb joins which labels."""
    actions_ = edges.where("rel_type = 'EVENT_ACTION'")
    return actions_.groupBy(F.col("eventaction_verb_label").alias("verb"), "src_label", "dst_label").agg(F.count(F.lit(1)).alias("n"))


def write_tables(rows: DataFrame, path: str) -> None:
    """The native and the minimal mapping and the verbs, each as a folder of CSV files."""
    tables = {"relation_mapping_native": native_mapping(rows), "relation_mapping_minimal": minimal_mapping(rows), "service_verbs": service_verbs(rows.sparkSession)}
    for name, table in tables.items():
        table.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/{name}")
