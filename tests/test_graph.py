import json

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import preprocess, reports, resolve
from loomgraph.operators.normalize import normalize, with_ordinal
from loomgraph.plans.compile import run_query
from loomgraph.plans.syntax import QueryError
from loomgraph.sources import readers, sinks
from loomgraph.vocabulary import DEFAULT_LABELS, NATIVE_LABELS

COLUMNS = (
    "source_entity_id string, source_entity_type string, target_entity_id string, target_entity_type string, relation_type string, relation_label_repr string, "
    "event_time string, tar_entity_match_pattern_type string, tar_entity_match_text string, extra string"
)


def row(s, st, t, tt, rel="EventAction", label="", time="2023-03-02 21:57:09", pattern=None, text=None, extra=None):
    return (s, st, t, tt, rel, label, time, pattern, text, extra)


@pytest.fixture(scope="module")
def small(spark):
    rows = [
        row("I_1", "Issue", "A_1", "Actor", label="Issue_OpenedBy_Actor"), row("PR_1", "PullRequest", "A_2", "Actor", label="PullRequest_OpenedBy_Actor"),
        row("PR_1", "PullRequest", "http://x.org/1", "ExternalResource", "Reference", pattern="GitHub_Service_External_Links", text="http://x.org/1"),
        row("PR_1", "PullRequest", "http://y.org/1", "ExternalResource", "Reference", time="2024-01-01", pattern="GitHub_Service_External_Links", text="http://y.org/1"),
        row("PR_1", "PullRequest", "A_1", "Actor", "Reference", pattern="Actor"), row("PR_2", "PullRequest", "nan", "", "Reference", pattern="SHA", extra="e"),
        row("PR_1", "PullRequest", "A_1", "Actor", "Reference", pattern="Actor"),
    ]
    return normalize(spark.createDataFrame(rows, COLUMNS), NATIVE_LABELS)


def test_dual_times_and_labels(spark):
    g = normalize(spark.createDataFrame([row("A_1", "Actor", "I_1", "Issue", "Reference"), row("a", "PullRequest", "b", None)], COLUMNS), DEFAULT_LABELS)
    e = g.edges.where("src_entity_id = 'A_1'").first()
    assert (e.event_time, e.source_event_time) == ("2023-03-02 21:57:09", "2023-03-02T21:57:09Z")
    assert {r.label for r in g.nodes.collect()} == {"Actor", "Issue", "Object"}


def test_placeholder_policies(spark, small):
    assert small.summary().first().asDict() == {"node_count": 6, "edge_count": 6, "skipped_records": 1}
    rows = [row("I_1", "Issue", "unknown", "Actor"), row("I_2", "Issue", None, "Actor", text="http://z.org/q"), row("I_3", "Issue", "A_9", "Actor")]
    df = spark.createDataFrame(rows, COLUMNS)
    numbered = with_ordinal(df, "source_entity_id")
    got = {r.src_entity_id: (r.dst_label, r.dst_entity_id) for r in normalize(numbered, NATIVE_LABELS, "unknown").edges.collect()}
    assert got["I_1"] == ("UnknownObject", "unknown:target:0") and got["I_2"] == ("UnknownObject", "unknown:target:1") and got["I_3"] == ("Actor", "A_9")
    got = {r.src_entity_id: r.dst_entity_id for r in normalize(numbered, NATIVE_LABELS, "external_if_url").edges.collect()}
    assert got["I_2"] == "http://z.org/q"
    with pytest.raises(ValueError):
        normalize(df, NATIVE_LABELS, "guess")


def test_last_write_wins_for_nodes(spark):
    df = with_ordinal(spark.createDataFrame([row("1", "user", "2", "issue"), row("1", "developer", "1", None)], COLUMNS), "source_entity_type")
    raw = {r.node_uid: r.raw_entity_type for r in normalize(df, DEFAULT_LABELS).nodes.collect()}
    assert raw["Actor:1"] == "user" and raw["Object:1"] is None


def test_optional_where_is_part_of_the_join(small):
    text = (
        "MATCH (pr:PullRequest)-[rl:REFERENCE]->(e:ExternalResource) OPTIONAL MATCH (pr)-[ra:REFERENCE]->(a:Actor) WHERE rl.source_event_time < '2024-01-01T00:00:00Z' "
        "AND (ra IS NULL OR ra.service_rel_type IN ['MENTIONS']) RETURN e.entity_id AS e, collect(DISTINCT a.entity_id) AS actors, count(ra) AS n ORDER BY e"
    )
    assert [tuple(r) for r in run_query(small, text).collect()] == [("http://x.org/1", ["A_1"], 2), ("http://y.org/1", [], 0)]


def test_bags_uniqueness_and_null_order(small):
    assert run_query(small, "MATCH (p:PullRequest)-[r:MENTIONS]->(a:Actor) RETURN a.entity_id").count() == 2
    assert run_query(small, "MATCH (p:PullRequest)-[r:MENTIONS]->(a:Actor) RETURN DISTINCT a.entity_id").count() == 1
    two = "MATCH (x:ExternalResource)<-[a:LINKS_TO]-(p:PullRequest)-[b:LINKS_TO]->(y:ExternalResource) RETURN x.entity_id AS x, y.entity_id AS y"
    assert run_query(small, two).count() == 2
    apart = "MATCH (p:PullRequest)-[a:LINKS_TO]->(x:ExternalResource) MATCH (p)-[b:LINKS_TO]->(y:ExternalResource) RETURN x.entity_id AS x, y.entity_id AS y"
    assert run_query(small, apart).count() == 4
    order = "MATCH (p:PullRequest)-[r]->(x) RETURN x.entity_id AS x, r.url_domain_etld1 AS d ORDER BY d {}"
    assert run_query(small, order.format("DESC")).first().d is None and run_query(small, order.format("ASC")).first().d == "x.org"


def test_parameters_prefixes_and_errors(small):
    assert run_query(small, "MATCH (p:PullRequest) WHERE p.entity_id STARTS WITH 'PR_' RETURN p", {}).count() == 1
    assert run_query(small, "MATCH (a:Actor {entity_id: $a}) RETURN a.entity_id", {"a": "A_1"}).count() == 1
    assert run_query(small, "MATCH (a:Actor)-[r:REFERENCE]->(a) RETURN a.entity_id").count() == 0
    for bad in ("", "RETURN 1", "MATCH (a:Actor)", "MATCH (a:Actor) RETURN b.entity_id", "MATCH (a:Actor RETURN a", "MATCH (a {entity_id: $x}) RETURN a"):
        with pytest.raises(QueryError):
            run_query(small, bad)


def test_plan_reads_few_columns_and_no_nodes(small, capsys):
    plan = run_query(small, "MATCH (i:Issue)-[r:OPENED_BY]->(a:Actor) RETURN a.entity_id LIMIT 5")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_injected_edges_answer_pending_queries(spark, small):
    more = spark.createDataFrame([("PullRequest:PR_1", "Issue:I_1", "PullRequest", "PR_1", "Issue", "I_1", "RESOLVES")],
                                 "source_node_uid string, target_node_uid string, src_label string, src_entity_id string, dst_label string, dst_entity_id string, rel_type string")
    more = more.withColumn("service_rel_type", F.col("rel_type"))
    text = "MATCH (p:PullRequest)-[r:RESOLVES]->(i:Issue) RETURN p.entity_id AS p, r.source_event_time AS t ORDER BY t"
    assert run_query(small, text).count() == 0 and run_query(small.inject_edges(more), text).count() == 1


@pytest.mark.parametrize("fine,entity,props,number,want", [
    ("PullRequestReviewComment", "PRRC_None", "{'repo_id': 4711, 'repo_name': 'own/er', 'issue_number': 12, 'pull_review_comment_id': '998877'}", "", ("PRRC_4711#12#r998877", "repaired")),
    ("", "X_None", "{}", "", ("X_None", "skipped_no_fine_grained")), ("Issue", "I_1#2", "{}", "", ("I_1#2", "skipped_not_needed")),
    ("Gollum", "", "{}", "", ("", "failed_unsupported_type:Gollum")), ("Issue", "", "{'repo_id': 1}", "", ("", "failed_missing_fields:issue_number")),
    ("Issue", "", "{'repo_id': 1.0}", "see #12", ("I_1#12", "repaired")), ("Commit", "", "{'repo_id': 1}", "at ABCDEF1234", ("C_1@abcdef1234", "repaired")),
])
def test_id_repair(spark, fine, entity, props, number, want):
    df = spark.createDataFrame([("Reference", fine, entity, props, number), ("EventAction", fine, "keep", props, number)],
                               "relation_type string, tar_entity_type_fine_grained string, tar_entity_id string, tar_entity_objnt_prop_dict string, tar_entity_match_text string")
    got = {r.relation_type: r for r in preprocess.preprocess(df, "fast_exid").collect()}
    assert (got["Reference"].tar_entity_id, got["Reference"].tar_entity_id_repair_status) == want
    assert got["EventAction"].tar_entity_id == "keep" and got["EventAction"].tar_entity_id_repair_status is None


def test_full_preprocess_adds_columns(spark):
    df = spark.createDataFrame([("Reference", "IC_7#1#2", "IssueComment", "I_9#1", "Issue_PR", "https://github.com/a/b/pull/1", "{'repo_id': 9}")],
                               "relation_type string, src_entity_id string, src_entity_type string, tar_entity_id string, tar_entity_match_pattern_type string, tar_entity_match_text string, tar_entity_objnt_prop_dict string")
    r = preprocess.preprocess(df).first()
    assert (r.src_entity_id_agg, r.src_entity_type_agg, r.tar_entity_id_agg, r.tar_entity_type_agg, r.tar_entity_type_fine_grained) == ("R_7", "Repo", "R_9", "Repo", "PullRequest")


def test_scope_prefixes(spark):
    p = spark.range(1).select(resolve.scope_prefixes(F.lit("R_156018"), ("PullRequest", "Issue", "Commit", "Odd")).alias("p")).first().p
    assert p == {"PullRequest": "PR_156018", "Issue": "I_156018", "Commit": "C_156018"}
    assert spark.range(1).select(resolve.scope_prefixes(F.lit("x"), ("Issue",)).alias("p")).first().p is None


def test_extract_and_resolve(spark):
    repos = spark.createDataFrame([("7", "own/er")], "repo_id string, repo_full_name string")
    actors = spark.createDataFrame([("3", "Kim")], "actor_id string, actor_login string")
    texts = spark.createDataFrame([(1, "@kim and https://github.com/Own/Er/issues/2 and R_5"), (2, "nobody")], "k int, t string")
    got = {r.k: r.entity_ids for r in resolve.extract_and_resolve(texts, "t", "k", repos, actors).collect()}
    assert got == {1: ["A_3", "R_7", "R_5"]}


def test_reports(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4), ("c", 5), ("c", 6)], "k string, v int")
    assert [tuple(r) for r in reports.top_counts(df, "k", 2).collect()] == [("c", 3), ("a", 2)]
    assert tuple(reports.tail(df, "k", 1).first()) == (3, 2) and reports.keep_last(df, ("k",), "v").count() == 3
    assert reports.stratified_sample(df, F.col("k") == "c", 4).count() == 4
    assert reports.coverage(df, "k").orderBy("k").collect()[-1].coverage == 1.0


def test_sinks_and_readers(spark, small, tmp_path):
    for fmt in ("csv", "jsonl", "cypher", "parquet"):
        sinks.write(small, str(tmp_path / fmt), fmt)
    sinks.write(small, str(tmp_path / "g.json"), "json")
    doc = json.loads((tmp_path / "g.json").read_text())
    assert doc["summary"] == {"node_count": 6, "edge_count": 6, "skipped_records": 1} and len(doc["nodes"]) == 6 and len(doc["edges"]) == 6
    assert readers.read_csv(spark, str(tmp_path / "csv" / "edges")).count() == 6 and spark.read.text(str(tmp_path / "cypher")).count() == 12
    assert spark.read.parquet(str(tmp_path / "parquet" / "edges")).where("rel_type = 'REFERENCE'").count() == 4
    assert sinks.write(small, None, "memory") is small
    (tmp_path / "r.json").write_text(json.dumps({"records": [{"a": "1"}, {"a": "2"}]}))
    assert readers.read_records(spark, str(tmp_path / "r.json"), "json").count() == 2
    with pytest.raises(ValueError):
        readers.read_records(spark, "x", "pickle")
    with pytest.raises(ValueError):
        readers.read_records(spark, "x", "xml")


def test_text_sinks_compress_and_nodes_come_first(spark, small, tmp_path):
    import gzip

    for fmt in ("csv", "cypher"):
        sinks.write(small, str(tmp_path / fmt), fmt, compression="gzip")
        sinks.write(small, str(tmp_path / fmt), fmt, compression="gzip")
        assert all(p.suffix == ".gz" for p in (tmp_path / fmt).rglob("part-*"))
    assert readers.read_csv(spark, str(tmp_path / "csv" / "edges")).count() == 6
    lines = [x for p in sorted((tmp_path / "cypher").rglob("part-*")) for x in gzip.open(p, "rt").read().splitlines()]
    assert [x.split(" ")[0] for x in lines] == ["MERGE"] * 6 + ["MATCH"] * 6


def test_records_go_once_the_graph_is_stored(spark):
    from pathlib import Path

    from loomgraph.session import shared_folder
    from loomgraph.sources.graph_view import graph

    folder = Path(shared_folder(spark).removeprefix("file:")) / "loomgraph"
    assert graph(spark, "/root/testdata/sf0.001").edges.count() > 0
    assert not list(folder.glob("records-*/*.parquet"))


def test_stream(spark, tmp_path):
    from loomgraph.streaming.ingest import edge_stream, write_edges

    spark.createDataFrame([row("I_1", "Issue", "A_1", "Actor", label="Issue_OpenedBy_Actor")] * 2, COLUMNS).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(COLUMNS).parquet(str(tmp_path / "in"))
    write_edges(stream, str(tmp_path / "out"), str(tmp_path / "cp"), NATIVE_LABELS).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).where("service_rel_type = 'OPENED_BY'").count() == 2
    with pytest.raises(ValueError):
        edge_stream(stream, NATIVE_LABELS, "unknown")


def test_equal_parallel_edges_stay_two(spark):
    rows = [row("I_1", "Issue", "A_1", "Actor", label="Issue_OpenedBy_Actor")] * 2 + [row("I_2", "Issue", "A_1", "Actor", label="Issue_OpenedBy_Actor")]
    g = normalize(spark.createDataFrame(rows, COLUMNS), NATIVE_LABELS)
    assert run_query(g, "MATCH (i:Issue)-[x:OPENED_BY]->(a:Actor), (i)-[y:OPENED_BY]->(a) RETURN i.entity_id").count() == 2
    assert sinks.script(g).where("value LIKE 'MATCH%'").select("value").distinct().count() == 3


def test_ordinals_are_places_in_any_partitioning(spark):
    values = [f"v{(k * 37) % 200:03d}" for k in range(200)]
    got = with_ordinal(spark.createDataFrame([(v,) for v in values], "v string").repartition(7), "v").collect()
    assert sorted((r._ord, r.v) for r in got) == list(enumerate(sorted(values)))
    assert with_ordinal(spark.createDataFrame([], "v string"), "v").count() == 0


def test_store_reads_back_what_it_wrote(spark, small, tmp_path):
    from loomgraph.operators import store

    store.save(small, str(tmp_path / "g"))
    back = store.load(spark, str(tmp_path / "g"))
    assert back.summary().first() == small.summary().first() and back.edges.select("edge_uid").distinct().count() == 6
    plan = run_query(back, "MATCH (p:PullRequest)-[r:LINKS_TO]->(x) WHERE r.source_event_time > '2023' RETURN x.entity_id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "gettimestamp" not in plan.lower() and plan.count("FileScan") == 1


def test_index_rebuild_takes_the_place_of_the_old_one_only_when_whole(spark, tmp_path):
    path = str(tmp_path / "index")
    pairs = lambda *rows: spark.createDataFrame(rows, "repo_id string, repo_full_name string, place long")
    old = pairs(("1", "a/b", 0), ("2", "c/d", 0))
    first = resolve.rebuild_index(old, pairs(("2", "new/x", 1), ("2", "new/a", 2)), path, "repo_id", "repo_full_name", "place")
    assert {tuple(r) for r in first.collect()} == {("1", "a/b"), ("2", "new/a")}
    with pytest.raises(ValueError):
        resolve.rebuild_index(old.where("false"), pairs((" ", "x", 1)), path, "repo_id", "repo_full_name")
    assert spark.read.parquet(path).count() == 2 and not (tmp_path / "index.old").exists()


def test_mapping_tables(spark, tmp_path):
    from loomgraph.operators import mapping

    rows = spark.createDataFrame([row("I_1", "Issue", "A_1", "Actor", label="Issue_OpenedBy_Actor"), row("I_1", "Issue", "x", "", "Reference", pattern="SHA")], COLUMNS)
    rows = rows.withColumnsRenamed({"source_entity_type": "src_entity_type", "target_entity_type": "tar_entity_type"})
    mapping.write_tables(rows, str(tmp_path))
    native = readers.read_csv(spark, str(tmp_path / "relation_mapping_native"))
    assert tuple(native.columns) == mapping.COLUMNS and native.count() == 2
    assert readers.read_csv(spark, str(tmp_path / "service_verbs")).where("verb = 'OpenedBy'").first().service_rel_type == "OPENED_BY"
