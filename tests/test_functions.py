from pyspark.sql import functions as F

from loomgraph.functions import clean, rules
from loomgraph.functions.mentions import mentions


def values(spark, expression, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.select(expression.alias("v"), "i").orderBy("i").collect()]


def test_times(spark):
    got = values(
        spark, clean.normal_time("t"), "2023-03-02 21:57:09", "2024/09/01", "1725237840", "1725237840123", "20230302", "2023-03-02T21:57:09+02:00",
        "2023-03-02T00:00:00.5Z", " ", None, "soon", "2023-03-02T21:57:09Z",
    )
    assert got == [
        "2023-03-02T21:57:09Z", "2024-09-01T00:00:00Z", "2024-09-02T00:44:00Z", "2024-09-02T00:44:00.123000Z", "1970-08-23T03:31:42Z",
        "2023-03-02T19:57:09Z", "2023-03-02T00:00:00.500000Z", None, None, None, "2023-03-02T21:57:09Z",
    ]


def test_missing_and_placeholders_differ(spark):
    texts = ("unknown", "nan", "", None, " NULL ", "n/a", "x")
    assert values(spark, clean.is_missing("t"), *texts) == [False, True, True, True, True, False, False]
    assert values(spark, clean.is_placeholder("t"), *texts) == [True, True, True, True, True, True, False]


def test_verbs(spark):
    assert values(spark, clean.upper_snake("t"), "OpenedBy", "PulledRepoFrom", "a b") == ["OPENED_BY", "PULLED_REPO_FROM", "A_B"]
    assert values(spark, clean.verb_from_label("t"), "Issue_OpenedBy_Actor", "a_b", None, "A__B__C_D") == ["OpenedBy", "", "", "B_C"]


def test_action_service_does_not_fall_back_for_unknown_verbs(spark):
    df = spark.createDataFrame(
        [("Issue_FooedBy_Actor", "IssuesEvent::action=opened"), ("", "IssuesEvent::action=opened"), ("x", "none")], "l string, t string"
    )
    verb = rules.action_verb("l", "t")
    assert [tuple(r) for r in df.select(verb, rules.action_service(verb)).collect()] == [("FooedBy", ""), ("OpenedBy", "OPENED_BY"), ("", "")]


def test_urls(spark):
    got = values(spark, clean.url_info("t"), "see (https://GitHub.com/a/b), now", "http://localhost/x", "http://a.b.c.org:80/?q", "none", None)
    assert [tuple(g) for g in got] == [
        ("https://GitHub.com/a/b", "github.com", "github.com", True), ("http://localhost/x", "localhost", "localhost", False),
        ("http://a.b.c.org:80/?q", "a.b.c.org", "c.org", False), (None, None, None, False), (None, None, None, False),
    ]


def test_objects_written_as_python(spark):
    texts = ("{'repo_id': 7, 'n': None, 'ok': True}", '{"a": "None of it"}', "[1]", "nothing", None)
    got = values(spark, clean.object_map("t"), *texts)
    assert got[0]["repo_id"] == "7" and got[0]["n"] is None and got[1] == {"a": "None of it"} and got[3] == got[4] == {}
    assert values(spark, clean.object_map("t"), "{'a': (1, 2)}")[0]["a"] == "[1,2]"


def test_year_and_key_value(spark):
    assert values(spark, clean.year_range("t"), "links in 2023?")[0].time_end == "2024-01-01T00:00:00Z"
    got = values(spark, clean.key_value("t"), "repo=a:b", "Repo_ID: 7", "plain")
    assert (got[0].key, got[0].value, got[1].key, got[1].value, got[2]) == ("repo", "a:b", "repo_id", "7", None)


def test_reference_services(spark):
    rows = [("GitHub_Service_External_Links", ""), ("Actor", ""), ("Actor", "http://x.org"), ("SHA", "http://github.com"), ("GitHub_Other_Service", ""), ("?", None)]
    df = spark.createDataFrame(rows, "p string, t string")
    assert [r[0] for r in df.select(rules.reference_service("p", "t")).collect()] == ["LINKS_TO", "MENTIONS", "LINKS_TO", "REFERENCES", "LINKS_TO", "REFERENCES"]
    assert values(spark, rules.native_relation("t"), "Reference", "reference", None) == ["REFERENCE", "EVENT_ACTION", "EVENT_ACTION"]
    assert values(spark, rules.keyword_relation("t"), "Opened it", "cite @x", "zzz") == ["OPENED_BY", "MENTIONS", "REFERS_TO"]


def test_node_types(spark):
    got = [tuple(v) for v in values(spark, rules.node_type("t", F.lit("tar_entity_type_fine_grained")), "Issue", "", "GitHub_Files_FileChanges", "SHA", "Object", "odd")]
    assert [g[2] for g in got] == [
        "native_gh_core_type", "missing_or_empty_type", "ambiguous_github_internal_path", "ambiguous_fine_grained_type", "generic_object_type", "unrecognized_raw_type",
    ]


def test_mentions(spark):
    def kinds(text):
        return [(m.hint_type, m.normalized_text) for m in values(spark, mentions("t"), text)[0]]

    assert kinds("R_156018 xR_1 A_7045099") == [("repo_canonical_id", "R_156018"), ("actor_canonical_id", "A_7045099")]
    assert kinds("@user and @ app[bot]") == [("actor_handle", "user"), ("actor_handle", "app[bot]")]
    assert kinds("https://github.com/owner/repo/issues/1") == [("repo_url", "owner/repo")]
    assert ("repo_full_name", "example.com/a") in kinds("https://example.com/a b")
    assert values(spark, F.size(mentions("t")), "@a @b", None) == [2, 0]


def test_mention_spans_count_code_points(spark):
    text = "é😀 @kim, R_5 x/y"
    found = {(m.hint_type, m.start, m.end): m.raw_text for m in values(spark, mentions("t"), text)[0]}
    assert found == {("actor_handle", 3, 7): "@kim", ("repo_canonical_id", 9, 12): "R_5", ("repo_full_name", 13, 16): "x/y"}
    assert all(text[a:z] == raw for (_, a, z), raw in found.items())


def test_deep_reading(spark):
    clean.ship_package()
    text = """{"a": "12", "b": ["1.5", "{'c': ('7', None)}"], "d": "nan", "e": true}"""
    assert values(spark, clean.deep_json("t"), text, "x", None) == ['{"a":12,"b":[1.5,{"c":[7,null]}],"d":"nan","e":true}', '"x"', None]


def test_object_map_reads_what_json_cannot(spark):
    texts = ["{'repo_id': 7, 'tags': ('a','b')}", "{'s': {1}}", "{'w': 'it\\'s'}", "{'a': None, 'b': True}", "{'None': 'x: None'}", "(1, 2)", "junk", None]
    want = [{"repo_id": "7", "tags": '["a","b"]'}, {"s": "[1]"}, {"w": "it's"}, {"a": None, "b": "true"}, {"None": "x: None"}, {}, {}, {}]
    assert values(spark, clean.object_map("t"), *texts) == want
