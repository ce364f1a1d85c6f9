"""Round trips at size: one writing of the graph, aggregates by hash, and quick paths equal to the general ones."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from loomgraph.functions import clean
from loomgraph.operators.normalize import normalize
from loomgraph.sources import sinks
from loomgraph.vocabulary import NATIVE_LABELS

DATA = "/root/testdata/sf0.001"


def records(spark):
    columns = "source_id string, source_type string, target_id string, target_type string, relation_type string, relation_label string, time string, extra string"
    return spark.createDataFrame([
        ("I_1", "Issue", "A_1", "Actor", "EventAction", "Issue_OpenedBy_Actor", "2024-01-02 03:04:05", None),
        ("I_1", "issue", "A_1", "user", "EventAction", "Issue_ClosedBy_Actor", "2024-01-02", 'say "x"'),
        ("A_1", "actor", "unKnown", "Actor", "EventAction", "", "", None),
    ], columns)


def round_trip(spark, tmp_path, name):
    at = tmp_path / name  # a path of its own, for which the session holds no graph
    at.symlink_to(DATA)
    got = sorted(map(tuple, __spark_entry__.queries()[name](spark, str(at)).collect()))
    with duckdb.connect() as con:
        for t in ("customer", "orders", "lineitem", "pages"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
        assert got == sorted(con.execute(__spark_entry__.oracle_sql()[name]).fetchall())
    assert (str(at), "skip") not in getattr(spark, "_loomgraph_graphs", {})  # the graph is not stored on the way to a sink


def test_csv_round_trip_writes_the_graph_once(spark, tmp_path):
    round_trip(spark, tmp_path, "csv_round_trip")


def test_nodes_are_aggregated_by_hash_before_any_sort(spark):
    nodes = normalize(records(spark), NATIVE_LABELS).nodes
    plan = nodes._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") >= 2 and plan.index("HashAggregate") > plan.index("SortAggregate")
    # an Actor is last named by the type that comes last, the issue's two types by their order; the third row is skipped
    assert sorted(map(tuple, nodes.collect())) == [("Actor:A_1", "Actor", "A_1", "user"), ("Issue:I_1", "Issue", "I_1", "issue")]


def test_properties_of_edges_with_and_without_a_rest(spark):
    edges = normalize(records(spark), NATIVE_LABELS).edges
    rows = edges.select(F.from_json(sinks.edge_properties(edges), "map<string,string>").alias("p"), sinks.edge_properties(edges).alias("t")).collect()
    assert len(rows) == 2 and all("null" not in r.t for r in rows)
    by_verb = {r.p["eventaction_verb_label"]: r.p for r in rows}
    assert by_verb["ClosedBy"]["aux_extra"] == 'say "x"' and "aux_extra" not in by_verb["OpenedBy"]
    assert by_verb["OpenedBy"]["source_event_time"] == "2024-01-02T03:04:05Z"


@pytest.mark.parametrize("zone", ["UTC", "Europe/Berlin"])
def test_plain_times_and_labels(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        texts = ["2024-02-29 23:59:59", "2023-02-29 00:00:00", "2024-01-01 24:00:00", " 2024-01-01 00:00:00 "]
        got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(clean.normal_time("t")).collect()]
        assert got[:4] == ["2024-02-29T23:59:59Z", None, None, "2024-01-01T00:00:00Z"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    labels = spark.createDataFrame([("A_b_C",), ("_A_b",), ("A__b",), ("A_b_",), ("é_ü_ö",), ("A_b_c_D",)], "t string")
    assert [r[0] for r in labels.select(clean.verb_from_label("t")).collect()] == ["b", "", "", "", "ü", "b_c"]
    words = spark.createDataFrame([("unKnown",), ("UNKNOWN",), ("unknowns",), ("N/A",)], "t string")
    assert [r[0] for r in words.select(clean.is_placeholder("t")).collect()] == [True, True, False, True]


def test_script_round_trip_scans_the_edges_once(spark, tmp_path):
    round_trip(spark, tmp_path, "script_round_trip")
    graph = normalize(records(spark), NATIVE_LABELS)
    sinks.write(graph, str(tmp_path / "out"), "cypher", compression="gzip")
    assert graph.numbered is None  # numbered in the scan that writes, not stored before it
    lines = [r[0] for r in spark.read.text(str(tmp_path / "out" / "part=1")).collect()]
    assert len(lines) == 2 and len({line.split("edge_uid: '")[1].split("'")[0] for line in lines}) == 2
    assert all("null" not in line and "aux" not in line for line in lines)
