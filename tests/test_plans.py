import pytest

from loomgraph.plans import evaluate, generate
from loomgraph.plans.render import render
from loomgraph.plans.repair import Intent, repair, simple_repair
from loomgraph.plans.syntax import parse
from loomgraph.plans.validate import Schema, Template, bound_codes, static_codes, template_codes
from loomgraph.queries import TEXTS
from loomgraph.sources import readers

S = Schema()
PR = "MATCH (pr:PullRequest {entity_id: 'PR_1#2'})-[rel:REFERENCE]->(e:ExternalResource) WHERE rel.service_rel_type = 'LINKS_TO' RETURN rel.url_domain_etld1, e.entity_id LIMIT 10"


@pytest.mark.parametrize("name", sorted(TEXTS))
def test_rendered_queries_parse_to_the_same_tree(name):
    q = parse(TEXTS[name])
    assert parse(render(q)).clauses == q.clauses and parse(render(q)).order == q.order


def test_static_codes(spark):
    texts = [PR, "", "RETURN 1", "MATCH (a:Actor RETURN a", generate.FREE_FORM, "MATCH (a:Actor) RETURN a.nope", "MATCH (a:Actor)-[:REFERENCE]->(i:Issue) RETURN a"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.select(static_codes("t", S, True), "i").orderBy("i").collect()]
    assert got[0] == ["ILLEGAL_PROPERTY"] and got[1] == ["EMPTY_QUERY"] and got[2] == ["MISSING_MATCH"] and got[3] == ["UNBALANCED_PARENTHESES"]
    assert got[4] == ["UNKNOWN_LABEL", "UNKNOWN_REL", "DIRECTION_MISMATCH"] and got[5] == ["ILLEGAL_PROPERTY"] and got[6] == ["DIRECTION_MISMATCH"]
    wider = Schema(properties=S.properties | {"service_rel_type"})
    assert df.where("i = 0").select(static_codes("t", wider, True)).first()[0] == []


def test_bound_codes_see_named_edges():
    assert bound_codes(PR, S) == []
    assert bound_codes(PR.replace("REFERENCE", "EVENT_ACTION"), S) == ["ILLEGAL_PROPERTY", "WRONG_RELATION_TYPE"]
    assert bound_codes("MATCH (a:Actor)-[r:EVENT_ACTION]->(i:Issue) WHERE r.service_rel_type = 'OPENED_BY' RETURN i", S) == ["DIRECTION_MISMATCH"]


@pytest.mark.parametrize("bad,kind,intent,edit", [
    (PR.replace("rel:REFERENCE", "rel:EVENT_ACTION"), "WRONG_RELATION_TYPE", Intent(), "replace_relation_type"),
    (PR.replace("RETURN rel.url", "RETURN e.url"), "ILLEGAL_PROPERTY", Intent(), "repair_relation_scoped_property"),
    (PR.replace(" WHERE rel.service_rel_type = 'LINKS_TO'", ""), "MISSING_SERVICE_FILTER", Intent(("LINKS_TO",)), "restore_property_filters"),
])
def test_repairs_without_the_answer(bad, kind, intent, edit):
    r = repair(bad, [kind], S, intent)
    assert r.valid and edit in r.edits
    q, gold = parse(r.text), parse(PR)
    assert q.clauses == gold.clauses and [i.value for i in q.items] == [i.value for i in gold.items]


def test_more_repairs():
    scope = repair("MATCH (pr:PullRequest) WHERE pr.entity_id STARTS WITH 'I_156018' RETURN pr.entity_id", ["HEURISTIC_WRONG_ENTITY_SCOPE"], S, Intent())
    assert "STARTS WITH 'PR_156018'" in scope.text
    time = repair(PR, ["HEURISTIC_TIME_RANGE_ERROR"], S, Intent(start="2023-01-01T00:00:00Z", end="2024-01-01T00:00:00Z"))
    assert "rel.source_event_time >= '2023-01-01T00:00:00Z' AND rel.source_event_time < '2024-01-01T00:00:00Z'" in time.text
    flip = repair("MATCH (a:Actor)-[r:EVENT_ACTION]->(i:Issue) WHERE r.service_rel_type = 'OPENED_BY' RETURN i", ["DIRECTION_MISMATCH"], S, Intent())
    assert "(a:Actor)<-[r:EVENT_ACTION]-(i:Issue)" in flip.text and flip.edits == ("flip_relation_direction",)
    count = repair(PR, ["HEURISTIC_AGGREGATION_ERROR"], S, Intent(count_by="url_domain_etld1"))
    assert "count(*) AS c" in count.text and "ORDER BY c DESC" in count.text
    branch = repair("MATCH (s)-[m:REFERENCE]->(a:Actor) WHERE m.service_rel_type = 'MENTIONS' RETURN s.entity_id", ["MISSING_PATTERN"], S, Intent(("MENTIONS", "LINKS_TO")))
    assert "OPTIONAL MATCH (s)-[r1:REFERENCE]->(x1:ExternalResource)" in branch.text
    lost = repair("nothing that parses", ["SYNTAX"], S, Intent())
    assert lost.valid and simple_repair("MATCH (x:Entity)-[:RELATED_TO]->(y:Entity) RETURN x", S) == "MATCH (x:Actor)-[:EVENT_ACTION]->(y:Actor) RETURN x"


def test_generators():
    assert generate.template_first(S) == "MATCH (n:Actor) RETURN n LIMIT 25" and generate.template_first(Schema(labels=frozenset())) is None
    open_world = Schema(directions=frozenset(), properties=frozenset())
    slots = generate.Slots((generate.Entity("Issue", value="I_1"), generate.Entity("Actor")), (generate.Relation("EVENT_ACTION", "Issue"),),
                           windows=(generate.Window("source_event_time", "2023"),), sorts=(generate.Sort("entity_id", True, 5),))
    text, _ = generate.controlled(slots, open_world)
    assert text == "MATCH (a:Issue)-[:EVENT_ACTION]->(b:Actor) WHERE a.entity_id = 'I_1' AND a.source_event_time >= '2023' RETURN a, b ORDER BY a.entity_id DESC LIMIT 5"
    text, why = generate.controlled(generate.Slots((generate.Entity("Odd"),)), S)
    assert text == "MATCH (n:Actor) RETURN n LIMIT 25" and why == ["label:Odd"]


def test_templates(spark):
    t = Template("t", "MATCH (p:PullRequest) WHERE p.entity_id STARTS WITH $pr_base_prefix RETURN p.entity_id LIMIT 5", ("q1", "q2"), hop_limit=0, prefix_slots=("pr_base_prefix",))
    slots = {"entity_slots": [{"entity_label": "Repo", "entity_id": "R_15"}, {"entity_label": "PullRequest"}]}
    queries = [
        {"id": "q1", "gold_cypher": "x", "nl_query": "in 2023", "extracted_slot_candidates": slots}, {"id": "q2", "gold_cypher": "x", "nl_query": ""},
        {"id": "q3", "gold_cypher": None, "nl_query": ""},
    ]
    runs = evaluate.run_templates(spark, queries, {"t": t}, {"q1": "t", "q2": "t"}, S)
    got = {r["mode"]: (r.success, r.fail, r["skip"]) for r in evaluate.summary(runs).collect()}
    assert got == {"template_first": (1, 1, 1), "controlled": (1, 1, 1)}
    assert {r.category for r in runs.where("status <> 'success'").collect()} == {"missing_required_slot", "injection_pending_skipped"}
    assert "HOP_LIMIT_EXCEEDED" in template_codes(PR, t, {}) and "REPO_SCOPE_PREFIX_MISSING" in template_codes(PR, t, {})
    year = generate.slot_values({}, "links of 2023", ["LINKS_TO"], True)
    assert year["time_start"] == "2023-01-01T00:00:00Z" and year["ref_semantic"] == "LINKS_TO"


def test_corpus_reading():
    names, aliases = readers.taxonomy({"query_types": [{"label": "kind_a", "aliases": ["one", "Two"]}]})
    lines = ['﻿{"id": "1", "nl_query": "n", "query_type": "two", "gold_cypher": null}', "", "{bad", '{"id": "2"}']
    c = readers.read_queries(lines, aliases)
    assert names == {"kind_a"} and c.by_type == {"kind_a": 1} and [e["line"] for e in c.errors] == [3, 4]
    assert readers.read_queries(lines, aliases, null_gold_counts=False).queries == []
    templates, of, pending = readers.read_templates({"templates": [{"template_id": "a", "cypher_skeleton": "s", "covered_queries": ["q"]}, {"template_id": "b", "cypher_skeleton": "s", "covered_queries": ["q"]}]})
    assert of == {"q": "b"} and len(templates) == 2 and pending == []


def test_compare_and_repair_reports(spark):
    examples = [{"id": "1", "gold_cypher": PR}]
    makers = {"gold": lambda e: e["gold_cypher"], "free": lambda e: generate.free_form(), "first": lambda e: generate.template_first(S)}
    got = {r.generator: (r.valid, r.exact) for r in evaluate.compare(spark, examples, makers, S).collect()}
    assert got == {"gold": (True, True), "free": (True, False), "first": (True, False)}
    cases = [{"case_id": "c", "failure_type": "WRONG_RELATION_TYPE", "generated_cypher": generate.FREE_FORM, "gold_cypher": PR}]
    runs = evaluate.run_repairs(spark, cases, S, lambda c: Intent(), use_gold=True)
    assert evaluate.repair_report(runs).first().valid == 1 and evaluate.edit_report(runs).count() >= 1


def test_matrix_traces_and_schema_text(spark, tmp_path):
    t = Template("t", "MATCH (p:PullRequest)-[r:REFERENCE]->(x:Commit) WHERE r.service_rel_type = 'REFERENCES' RETURN p.entity_id LIMIT 5", ("q1",))
    queries = [{"id": "q1", "gold_cypher": t.skeleton, "nl_query": ""}]
    runs = evaluate.run_templates(spark, queries, {"t": t}, {"q1": "t"}, S)
    texts = spark.createDataFrame([("q1", "l3_x", None, t.skeleton)], "query_id string, query_type string, level string, text string")
    matrix = evaluate.level_matrix(runs, texts)
    row = matrix.first()
    assert (row.level, row.relations, row.controlled) == ("L3", "REFERENCE", "fail" if "fail" in {r.status for r in runs.collect()} else "success")
    assert evaluate.level_summary(runs, matrix).count() == 2 and evaluate.markdown(matrix).startswith("| query_id")
    evaluate.write_traces(runs, str(tmp_path / "t"))
    assert spark.read.json(str(tmp_path / "t")).count() == 2
    from loomgraph.plans.validate import describe

    assert readers.read_schema(describe(S)) == S


def test_slots_are_parsed_and_filtered():
    raw = {
        "entity_slots": [{"label": "Issue", "value": 5}, {"label": "Odd"}, "junk"], "relation_slots": [{"rel_type": "EVENT_ACTION", "dst_label": "Actor"}],
        "property_slots": [{"property_name": "entity_id", "value": "x"}, {"property_name": "nope"}],
        "time_range_slots": [{"property_name": "source_event_time", "owner_kind": "relation"}], "sort_slots": [{"property_name": "nope"}],
        "aggregation_slots": [{"function": "median"}, {"function": "count"}],
    }
    kept, refused = generate.Slots.parsed(raw).accepted(S)
    assert [e.label for e in kept.entities] == ["Issue"] and kept.entities[0].value == "5" and [g.function for g in kept.aggregations] == ["COUNT"]
    assert refused == ["label:Odd", "property:nope", "time:source_event_time", "sort:nope", "aggregation:MEDIAN"]


def test_families_limit_shapes_and_lead_to_abstention():
    one = generate.Slots((generate.Entity("Issue"),))
    assert generate.controlled(one, S, ("entity_filter",))[0].startswith("MATCH (n:Issue)")
    text, why = generate.controlled(one, S, ("join_traversal",))
    assert text is None and why[-1] == "no shape fits"


def test_nearest_property_and_typed_faults():
    from loomgraph.plans import repair

    r = repair.repair("MATCH (a:Actor) RETURN a.entity_idd", ["ILLEGAL_PROPERTY"], S, repair.Intent())
    assert r.text.startswith("MATCH (a:Actor) RETURN a.entity_id AS") and r.valid and "replace_property_nearest" in r.edits
    assert [(f.kind, f.place) for f in repair.faults(["UNKNOWN_REL", "odd"])] == [("UNKNOWN_REL", "relation pattern"), ("OTHER", "query")]
    assert len(repair.OPERATORS) == 12


def test_joined_corpus_names_lost_queries(spark):
    cases, queries = spark.createDataFrame([("a", 1), ("b", 2)], "query_id string, n int"), spark.createDataFrame([("a", "t")], "query_id string, kind string")
    assert evaluate.joined_corpus(cases.where("n = 1"), queries).count() == 1
    with pytest.raises(KeyError, match="b"):
        evaluate.joined_corpus(cases, queries)


def test_configuration_readers():
    from loomgraph.sources import readers

    pack = readers.pack_config([{"raw_node_type": "Thing", "normalized_label": "Issue"}], [{"priority": "2", "contains_any": "b", "maps_to": "B"}, {"priority": "1", "contains_any": "a|c", "maps_to": "A"}])
    assert readers.label_config(pack)["thing"] == "Issue" and readers.relation_rules(pack) == ((("a", "c"), "A"), (("b",), "B"))
    doc = {"nodes": [{"node_uid": "1", "label": "Issue", "entity_id": "i"}, {"node_uid": "2", "label": "Actor"}], "edges": [{"source_node_uid": "1", "target_node_uid": "2", "rel_type": "R", "properties": {"t": 1}}]}
    schema = readers.graph_schema(doc)
    assert schema.directions == {"Issue-[:R]->Actor"} and schema.by_relation == {"R": frozenset({"t"})} and "entity_id" in schema.properties
    assert readers.read_examples({"examples": [{"id": 1, "question": "q"}]})[0]["nl_query"] == "q"
    with pytest.raises(ValueError):
        readers.read_examples([{"id": 1}])
