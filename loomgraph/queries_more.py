"""More registered queries: cleaning, rules, mappings, checks and round trips, each with its SQL counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph import oracle
from loomgraph.functions import clean, rules
from loomgraph.functions.mentions import mentions
from loomgraph.operators import mapping, reports, resolve, store
from loomgraph.operators import preprocess as pre
from loomgraph.operators.normalize import normalize
from loomgraph.plans import evaluate, validate
from loomgraph.plans.compile import run_query
from loomgraph.queries import _FIX, _broken, cypher, register
from loomgraph.sources import readers, sinks
from loomgraph.sources.graph_view import graph, passing_graph, raw_records, read
from loomgraph.vocabulary import ABBREVIATIONS, NATIVE_LABELS


def _customers(spark, sf_dir, *columns) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey", *columns)


def _key():
    return F.col("c_custkey").cast("string")


# cleaning


@register(
    """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'b' || c_custkey WHEN 1 THEN c_name ELSE '' END AS first_value,
      'it\\''s \\\\ ' || c_custkey AS escaped, 'match (n) return ' || c_custkey AS query_text,
      CASE WHEN c_custkey % 2 = 0 THEN CAST(2000 + c_custkey % 100 AS VARCHAR) || '-01-01T00:00:00Z' END AS time_start,
      CASE WHEN c_custkey % 2 = 0 THEN CAST(2001 + c_custkey % 100 AS VARCHAR) || '-01-01T00:00:00Z' END AS time_end,
      CASE c_custkey % 4 WHEN 0 THEN 'L1' WHEN 1 THEN 'L4' WHEN 2 THEN 'given' ELSE 'comprehensive' END AS level,
      CASE c_custkey % 3 WHEN 0 THEN 'PullRequestReviewComment' WHEN 1 THEN 'Repo' END AS kind,
      CASE WHEN c_custkey % 2 = 1 THEN CAST(c_custkey AS VARCHAR) ELSE '' END AS number, md5(CAST(c_custkey AS VARCHAR)) AS sha FROM customer"""
)
def scalar_cleaning(spark, sf_dir):
    k = F.col("c_custkey")
    rows = _customers(spark, sf_dir, "c_name")
    year = F.when(k % 2 == 0, F.concat(F.lit("links in "), (2000 + k % 100).cast("string"), F.lit(" or 1999"))).otherwise("some day")
    first = clean.first_nonempty(F.when(k % 3 == 0, " ").when(k % 3 == 1, F.col("c_name")), F.when(k % 3 == 0, F.concat(F.lit("b"), _key())))
    kind = F.when(k % 3 == 0, F.concat(F.lit("PRRC_"), _key())).when(k % 3 == 1, F.concat(F.lit("R_"), _key())).otherwise(F.concat(F.lit("Z_"), _key()))
    level = rules.query_level(F.when(k % 4 == 2, "given").otherwise(""), F.when(k % 4 == 0, "l1_x").when(k % 4 == 1, "L4_y").otherwise("other"))
    span = clean.year_range(year)
    text = F.concat(F.when(k % 2 == 1, F.concat(F.lit("see #"), _key())).otherwise("see"), F.lit(" at "), F.upper(F.md5(_key())))
    return rows.select(
        "c_custkey", first.alias("first_value"), clean.escape_literal(F.concat(F.lit("it's \\ "), _key())).alias("escaped"),
        clean.normal_query(F.concat(F.lit("  MATCH  (n)\n RETURN "), _key())).alias("query_text"), span["time_start"].alias("time_start"),
        span["time_end"].alias("time_end"), level.alias("level"), clean.id_type(kind, ABBREVIATIONS).alias("kind"),
        clean.issue_number(text).alias("number"), F.substring(clean.commit_sha(F.concat(text, F.lit(" "))), 1, 40).alias("sha"),
    )


@register(
    """SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS id, 'true' AS flag, '[1,2]' AS pair, CASE WHEN c_custkey % 2 = 0 THEN 'it''s' ELSE 'x' END AS word,
      c_custkey % 3 <> 2 AS readable FROM customer WHERE c_custkey % 3 <> 2
    UNION ALL SELECT c_custkey, NULL, NULL, NULL, NULL, false FROM customer WHERE c_custkey % 3 = 2"""
)
def object_text(spark, sf_dir):
    k = F.col("c_custkey")
    word = F.when(k % 2 == 0, "'it\\'s'").otherwise("'x'")
    python = F.concat(F.lit("{'id': "), _key(), F.lit(", 'flag': True, 'pair': (1, 2), 'gone': None, 'word': "), word, F.lit("}"))
    as_json = F.concat(F.lit('{"id": '), _key(), F.lit(', "flag": true, "pair": [1,2], "word": "'), F.when(k % 2 == 0, "it's").otherwise("x"), F.lit('"}'))
    text = F.when(k % 3 == 0, python).when(k % 3 == 1, as_json).otherwise("{broken")
    rows = clean.with_object_map(_customers(spark, sf_dir), text, "m")
    get = lambda n: F.try_element_at("m", F.lit(n))
    return rows.select("c_custkey", get("id").alias("id"), get("flag").alias("flag"), get("pair").alias("pair"), get("word").alias("word"), (F.size("m") > 0).alias("readable"))


@register(
    """SELECT c_custkey, '{"a":' || c_custkey || ',"b":[1.5,{"c":7,"d":"x"}],"e":"' || c_name || '"}' AS deep FROM customer"""
)
def deep_normalize(spark, sf_dir):
    clean.ship_package()
    text = F.concat(F.lit("""{"a": \""""), _key(), F.lit("""\", "b": ["1.5", "{'c': '7', 'd': 'x'}"], "e": \""""), F.col("c_name"), F.lit('"}'))
    return _customers(spark, sf_dir, "c_name").select("c_custkey", clean.deep_json(text).alias("deep"))


def _tagged(spark, sf_dir) -> DataFrame:
    """Customers as records with columns that no field takes."""
    return read(spark, sf_dir, "customer").select(
        F.concat(F.lit("I_"), _key()).alias("source_entity_id"), F.lit("issue").alias("source_entity_type"), F.lit("A_1").alias("target_entity_id"),
        F.lit("user").alias("target_entity_type"), F.lit("EventAction").alias("relation_type"), F.lit("Issue_OpenedBy_Actor").alias("relation_label"),
        F.col("c_mktsegment").alias("segment"), F.when(F.col("c_custkey") % 2 == 0, _key()).alias("even"), F.lit("3").alias("weight"),
    )


@register(
    """SELECT 'I_' || c_custkey AS src, c_mktsegment AS segment, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS VARCHAR) END AS even,
      CAST(1 + (c_custkey + 1) % 2 AS BIGINT) AS n_aux, '3' AS weight, 'OPENED_BY' AS service, c_mktsegment AS in_json FROM customer"""
)
def aux_collect(spark, sf_dir):
    edges = normalize(_tagged(spark, sf_dir)).edges
    props = sinks.edge_properties(edges)
    return edges.select(
        F.col("src_entity_id").alias("src"), F.try_element_at("aux", F.lit("aux_segment")).alias("segment"), F.try_element_at("aux", F.lit("aux_even")).alias("even"),
        F.size("aux").cast("long").alias("n_aux"), "weight", F.get_json_object(props, "$.service_rel_type").alias("service"),
        F.get_json_object(props, "$.aux_segment").alias("in_json"),
    )


@register(
    """WITH t AS (SELECT s_suppkey AS k, 'see R_' || s_suppkey || ' or @sup' || s_suppkey || ', https://github.com/own/er' || s_suppkey || '/issues/1 and a.b/c' AS x,
        length(CAST(s_suppkey AS VARCHAR)) AS w FROM supplier)
    SELECT k, 'R_' || k AS name, 'repo_canonical_id' AS kind, 4 AS at, 6 + w AS stop FROM t
    UNION ALL SELECT k, 'sup' || k, 'actor_handle', 10 + w, 14 + 2 * w FROM t
    UNION ALL SELECT k, 'own/er' || k, 'repo_url', 16 + 2 * w, 41 + 3 * w FROM t
    UNION ALL SELECT k, 'a.b/c', 'repo_full_name', length(x) - 5, length(x) FROM t"""
)
def mention_spans(spark, sf_dir):
    k = F.col("s_suppkey").cast("string")
    text = F.concat(F.lit("see R_"), k, F.lit(" or @sup"), k, F.lit(", https://github.com/own/er"), k, F.lit("/issues/1 and a.b/c"))
    found = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.explode(mentions(text)).alias("m"))
    return found.select("k", F.col("m.normalized_text").alias("name"), F.col("m.hint_type").alias("kind"), F.col("m.start").alias("at"), F.col("m.end").alias("stop"))


@register(
    """SELECT s_suppkey AS k, 'A_' || s_suppkey || '|R_' || s_suppkey || '|R_9' || s_suppkey AS ids FROM supplier"""
)
def extract_and_resolve(spark, sf_dir):
    s = read(spark, sf_dir, "supplier")
    k = F.col("s_suppkey").cast("string")
    repos = s.select(k.alias("repo_id"), F.concat(F.lit("own/er"), k).alias("repo_full_name"))
    actors = s.select(k.alias("actor_id"), F.concat(F.lit("Sup"), k).alias("actor_login"))
    text = F.concat(F.lit("@sup"), k, F.lit(" at https://github.com/Own/Er"), k, F.lit(" and R_9"), k, F.lit(" no/where"))
    out = resolve.extract_and_resolve(s.select(F.col("s_suppkey").alias("k"), text.alias("t")), "t", "k", repos, actors)
    return out.select("k", F.array_join("entity_ids", "|").alias("ids"))


@register(
    """SELECT s_nationkey AS nation, max(s_suppkey) AS last_id, CAST(s_nationkey AS VARCHAR) || '/new' || max(s_suppkey) AS name FROM supplier GROUP BY 1"""
)
def ordered_index(spark, sf_dir):
    """Of equal names the last id by order wins, in a lookup as in an upsert, though text order would say otherwise."""
    s = read(spark, sf_dir, "supplier")
    text = lambda c: F.col(c).cast("string")
    index = s.select(text("s_suppkey").alias("id"), text("s_nationkey").alias("name"), F.col("s_suppkey").alias("place"))
    asked = s.select(F.col("s_nationkey").alias("nation"), F.concat(F.lit("@"), text("s_nationkey")).alias("q")).distinct()
    found = resolve.lookup(asked, "q", index, "id", "name", "place").select("nation", F.col("id").cast("long").alias("last_id"))
    old = s.select(text("s_nationkey").alias("key"), F.lit("zzz").alias("value")).distinct()
    new = s.select(text("s_nationkey").alias("key"), F.concat(text("s_nationkey"), F.lit("/new"), text("s_suppkey")).alias("value"), F.col("s_suppkey").alias("place"))
    kept = resolve.upsert(old, new, "key", "value", "place").select(F.col("key").alias("__k"), F.col("value").alias("name"))
    return found.join(kept, F.col("nation").cast("string") == F.col("__k")).drop("__k")


# rules and mappings


@register(
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'OPENED_BY' WHEN 1 THEN 'COMMENTED_ON' WHEN 2 THEN 'RESOLVES' WHEN 3 THEN 'BELONGS_TO' WHEN 4 THEN 'MENTIONS'
      ELSE 'REFERS_TO' END AS relation, CASE WHEN p_partkey % 6 = 2 THEN 'MENDS' ELSE 'OTHER' END AS overridden FROM part"""
)
def keyword_relation(spark, sf_dir):
    k = F.col("p_partkey") % 6
    text = F.when(k == 0, "was Opened, then closed").when(k == 1, "a Comment").when(k == 2, "fixes it").when(k == 3, "of repo x").when(k == 4, "cites").otherwise("none")
    own = readers.relation_rules({"relation_rules": [{"contains_any": ["fix"], "maps_to": "MENDS"}]})
    return read(spark, sf_dir, "part").select(
        "p_partkey", rules.keyword_relation(text, readers.relation_rules()).alias("relation"), rules.keyword_relation(text, own, "OTHER").alias("overridden")
    )


@register(
    f"""WITH {oracle.RAW} SELECT tar_entity_type AS raw, pattern, CASE WHEN tar_entity_type IN ('', 'ExternalResource') THEN
        CASE WHEN pattern IN ('GitHub_Service_External_Links', 'GitHub_Other_Service') THEN 'ExternalResource' ELSE 'UnknownObject' END
      ELSE tar_entity_type END AS normal, CASE WHEN pattern = '' THEN '' WHEN match_text <> '' THEN 'tar_entity_match_pattern_type|tar_entity_match_text'
      ELSE 'tar_entity_match_pattern_type' END AS evidence, count(*) AS n FROM raw GROUP BY ALL"""
)
def row_types(spark, sf_dir):
    p, t = "tar_entity_match_pattern_type", "tar_entity_match_text"
    out = raw_records(spark, sf_dir).select(
        F.col("tar_entity_type").alias("raw"), F.col(p).alias("pattern"), rules.row_type("tar_entity_type", p, t).alias("normal"),
        F.array_join(rules.evidence_fields(p, t), "|").alias("evidence"),
    )
    return reports.value_counts(out, "raw", "pattern", "normal", "evidence")


@register(
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'missing_template' WHEN 1 THEN 'missing_slot' WHEN 2 THEN 'abstain_or_empty' WHEN 3 THEN 'parse_error'
      ELSE CASE WHEN event_id % 2 = 0 THEN 'schema_mismatch' END END AS category FROM events"""
)
def pilot_failures(spark, sf_dir):
    k = F.col("event_id") % 5
    text = F.when(k < 3, " ").otherwise("MATCH (n) RETURN n")
    reason = F.when(k == 0, "no template").when(k == 1, "no slot")
    codes = F.when(k == 3, F.array(F.lit("UNKNOWN_LABEL"), F.lit("MISSING_RETURN"))).when(F.col("event_id") % 2 == 0, F.array(F.lit("UNKNOWN_REL"))).otherwise(
        F.array().cast("array<string>"))
    return read(spark, sf_dir, "events").select("event_id", rules.pilot_failure(text, reason, codes).alias("category"))


@register(
    """WITH r AS (SELECT l_linenumber % 4 AS k, l_returnflag AS f FROM lineitem)
    SELECT CASE k WHEN 0 THEN 'MENTIONS' WHEN 3 THEN 'LINKS_TO' ELSE 'REFERENCES' END AS hint,
      CASE k WHEN 0 THEN 'high' WHEN 1 THEN CASE f WHEN 'R' THEN 'high' ELSE 'med' END WHEN 2 THEN CASE f WHEN 'N' THEN 'high' ELSE 'med' END ELSE 'high' END AS confidence,
      CASE k WHEN 3 THEN 'EXTERNAL' ELSE 'GH_INTERNAL' END AS kind, count(*) AS n FROM r GROUP BY ALL"""
)
def relation_mapping(spark, sf_dir):
    k, flag = F.col("l_linenumber") % 4, F.col("l_returnflag")
    patterns = F.when(k == 0, "Actor").when(k == 1, "SHA").when(k == 2, "Release").otherwise("GitHub_Service_External_Links")
    rows = read(spark, sf_dir, "lineitem").select(
        F.lit("Reference").alias("relation_type"), patterns.alias("tar_entity_match_pattern_type"), F.lit("").alias("tar_entity_match_text"),
        F.when((k == 1) & (flag == "R"), "Commit").otherwise("odd").alias("tar_entity_type_fine_grained"),
        F.when((k == 2) & (flag == "N"), "{'repo_id': 7}").otherwise("{'repo_id': None}").alias("tar_entity_objnt_prop_dict"),
    )
    out = reports.relation_mapping(rows).select("hint.hint", "hint.confidence", "kind.kind")
    return reports.value_counts(out, "hint", "confidence", "kind")


_NORMAL = """CASE WHEN tar_entity_type IN ('', 'ExternalResource') THEN CASE WHEN pattern LIKE 'GitHub_%' THEN 'ExternalResource' ELSE 'UnknownObject' END
      ELSE tar_entity_type END"""


@register(
    f"""WITH {oracle.RAW}, a AS (SELECT src_entity_type AS s, {_NORMAL} AS t, relation_type AS r, relation_label_repr AS l,
        CASE pattern WHEN 'GitHub_Service_External_Links' THEN 'LINKS_TO' WHEN 'Actor' THEN 'MENTIONS' WHEN 'SHA' THEN 'REFERENCES' ELSE 'LINKS_TO' END AS hint,
        CASE pattern WHEN 'GitHub_Service_External_Links' THEN 'EXTERNAL' WHEN 'GitHub_Other_Service' THEN 'GH_SEMI' ELSE 'GH_INTERNAL' END AS kind,
        CASE pattern WHEN 'GitHub_Service_External_Links' THEN 'high' WHEN 'Actor' THEN 'high' ELSE 'med' END AS c FROM raw)
    SELECT 'EVENT_ACTION' AS normalized_rel, s AS source_norm_type, t AS target_norm_type, string_agg(DISTINCT l, '|' ORDER BY l) AS raw_label_repr, '' AS service_hint,
      '' AS target_kind, 'high' AS confidence, '{{"rows":' || count(*) || '}}' AS notes FROM a WHERE r = 'EventAction' GROUP BY s, t
    UNION ALL SELECT 'REFERENCE', s, t, '', hint, kind, c, '{{"rows":' || count(*) || '}}' FROM a WHERE r = 'Reference' GROUP BY s, t, hint, kind, c"""
)
def relation_mapping_native(spark, sf_dir):
    return mapping.native_mapping(raw_records(spark, sf_dir)).select(
        "normalized_rel", "source_norm_type", "target_norm_type", "raw_label_repr", "service_hint", "target_kind", "confidence", "notes"
    )


@register(
    f"""WITH {oracle.RAW} SELECT 'EventAction' AS raw_relation_type, 'EVENT_ACTION' AS normalized_rel, '' AS service_hint, '' AS target_kind, 'high' AS confidence
    UNION ALL SELECT DISTINCT 'Reference', 'REFERENCE', CASE pattern WHEN 'Actor' THEN 'MENTIONS' WHEN 'SHA' THEN 'REFERENCES' ELSE 'LINKS_TO' END,
      CASE pattern WHEN 'GitHub_Service_External_Links' THEN 'EXTERNAL' WHEN 'GitHub_Other_Service' THEN 'GH_SEMI' ELSE 'GH_INTERNAL' END,
      CASE pattern WHEN 'GitHub_Service_External_Links' THEN 'high' WHEN 'Actor' THEN 'high' ELSE 'med' END FROM raw WHERE relation_type = 'Reference'"""
)
def relation_mapping_minimal(spark, sf_dir):
    return mapping.minimal_mapping(raw_records(spark, sf_dir)).select("raw_relation_type", "normalized_rel", "service_hint", "target_kind", "confidence")


@register(
    oracle.edges() + """, c AS (SELECT verb, s_label AS src_label, t_label AS dst_label, count(*) AS n FROM e WHERE rel = 'EVENT_ACTION' GROUP BY 1, 2, 3)
      SELECT *, round(sum(n) OVER (PARTITION BY verb) / sum(n) OVER (), 4) AS ratio FROM c"""
)
def verb_coverage(spark, sf_dir):
    edges = graph(spark, sf_dir).edges
    return mapping.verb_pairs(edges).join(mapping.verb_frequency(edges).select("verb", "ratio"), "verb")


@register(
    oracle.edges() + """, p(prop) AS (VALUES ('native_rel_type'), ('service_rel_type'), ('eventaction_verb_label'), ('raw_relation_type'), ('event_time'),
      ('source_event_time'), ('tar_entity_match_text'), ('tar_entity_match_pattern_type'))
    SELECT 'label property' AS kind, l || '.' || q AS value FROM (SELECT s_label AS l FROM e UNION SELECT t_label FROM e), (VALUES ('entity_id'), ('raw_entity_type')) v(q)
    UNION ALL SELECT DISTINCT 'relation property', rel || '.' || prop FROM (SELECT DISTINCT rel FROM e), p
    UNION ALL SELECT 'relation property', 'EVENT_ACTION.raw_relation_label_repr'
    UNION ALL SELECT 'relation property', 'REFERENCE.' || u FROM (VALUES ('url_raw'), ('url_host'), ('url_domain_etld1'), ('url_is_github')) w(u)"""
)
def schema_properties(spark, sf_dir):
    return reports.inferred_schema(graph(spark, sf_dir)).where("kind LIKE '%property'")


@register(
    """SELECT 'k' AS field, count(*) AS rows, 0::BIGINT AS missing, count(DISTINCT event_id) AS distinct_values, min(CAST(event_id AS VARCHAR)) AS example, false AS is_object, 'int' AS parse_hint FROM events
    UNION ALL SELECT 'at', count(*), 0, count(DISTINCT strftime(ts, '%Y-%m-%d %H:%M')), min(strftime(ts, '%Y-%m-%d %H:%M')), false, 'datetime' FROM events
    UNION ALL SELECT 'props', count(*), 0, count(DISTINCT props), min(props), true, 'json_like' FROM events
    UNION ALL SELECT 'half', count(*), 0, count(DISTINCT user_id), min(CAST(user_id AS VARCHAR) || '.5'), false, 'float' FROM events
    UNION ALL SELECT 'word', count(*), count(*) FILTER (WHERE event_id % 4 = 0), count(DISTINCT event_type) + 1, min(event_type), false, 'string' FROM events"""
)
def field_dictionary_full(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("k"), F.date_format("ts", "yyyy-MM-dd HH:mm").alias("at"), "props",
        F.concat(F.col("user_id").cast("string"), F.lit(".5")).alias("half"), F.when(F.col("event_id") % 4 == 0, "nan").otherwise(F.col("event_type")).alias("word"),
    )
    return reports.field_dictionary(rows)


# ids


@register(
    """SELECT l_orderkey, l_linenumber, CASE l_linenumber % 5 WHEN 0 THEN 'PullRequest' WHEN 1 THEN 'Issue' WHEN 2 THEN 'Commit' WHEN 3 THEN 'Branch' ELSE 'Release' END AS kind FROM lineitem"""
)
def fine_grained_type(spark, sf_dir):
    k = F.col("l_linenumber") % 5
    pattern = F.when(k < 2, "Issue_PR").when(k == 2, "SHA").when(k == 3, "Branch_Tag_GHDir").otherwise("Other")
    text = F.when(k == 0, "https://github.com/a/b/pull/1").otherwise("see it")
    entity = F.when(k == 1, "I_1#2").when(k == 3, "B_1:main").when(k == 4, "RE_1-2").otherwise("x")
    kind = pre.fine_grained(pattern, text, entity, F.lit("IssueComment"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", kind.alias("kind"))


@register(
    """SELECT l_orderkey, l_linenumber, 'R_' || l_suppkey AS src_agg, 'Repo' AS src_type, 'R_' || l_suppkey AS tar_agg, 'Repo' AS tar_type,
      CASE WHEN l_returnflag = 'A' THEN 'Issue' END AS fine FROM lineitem"""
)
def preprocess_full(spark, sf_dir):
    rows = _broken(spark, sf_dir).drop("tar_entity_type_fine_grained")
    made = pre.preprocess(rows, "full")
    return made.select(
        "l_orderkey", "l_linenumber", F.col("src_entity_id_agg").alias("src_agg"), F.col("src_entity_type_agg").alias("src_type"),
        F.col("tar_entity_id_agg").alias("tar_agg"), F.col("tar_entity_type_agg").alias("tar_type"), F.col("tar_entity_type_fine_grained").alias("fine"),
    )


_KINDS = {
    "Actor": "'A_' || s", "Repo": "'R_' || s", "Issue": "'I_' || s || '#' || o", "PullRequest": "'PR_' || s || '#' || o",
    "IssueComment": "'IC_' || s || '#' || o || '#' || p", "PullRequestReview": "'PRR_' || s || '#' || o || '#prr-' || p",
    "PullRequestReviewComment": "'PRRC_' || s || '#' || o || '#r' || p", "Commit": "'C_' || s || '@' || md5(p)",
    "CommitComment": "'CC_' || s || '@' || md5(p) || '#r' || p", "Branch": "'B_' || s || ':b' || p", "Tag": "'T_' || s || '-t' || p",
    "Release": "'RE_' || s || '-' || p", "Push": "'P_' || s || '.' || p",
}


@register(
    "WITH l AS (SELECT CAST(l_suppkey AS VARCHAR) AS s, CAST(l_orderkey AS VARCHAR) AS o, CAST(l_partkey AS VARCHAR) AS p, l_orderkey, l_partkey, l_linenumber, l_orderkey % 13 AS k FROM lineitem) "
    + "SELECT l_orderkey, l_partkey, l_linenumber, CASE k " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_KINDS)) + " END AS kind, CASE k "
    + " ".join(f"WHEN {i} THEN {form}" for i, form in enumerate(_KINDS.values())) + " END AS entity_id FROM l"
)
def exid_all_kinds(spark, sf_dir):
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (F.col("l_orderkey") % 13 + 1).cast("int"))
    text = lambda c: F.col(c).cast("string")
    part = text("l_partkey")
    props = F.concat(
        F.lit("{'repo_id': "), text("l_suppkey"), F.lit(", 'actor_id': '"), text("l_suppkey"), F.lit("', 'number': "), text("l_orderkey"), F.lit(".0, 'comment_id': "), part,
        F.lit(", 'review_id': "), part, F.lit(", 'sha': '"), F.md5(part), F.lit("', 'branch_name': 'b"), part, F.lit("', 'tag_name': 't"), part, F.lit("', 'release_id': "), part,
        F.lit(", 'push_id': "), part, F.lit("}"),
    )
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", kind.alias("kind"), props.alias("tar_entity_objnt_prop_dict"))
    return pre.rebuild(rows, F.col("kind")).select("l_orderkey", "l_partkey", "l_linenumber", "kind", "entity_id")


# the query language

cypher(
    "cypher_time_bounds",
    "MATCH (p:PullRequest)-[l:LINKS_TO]->(x:ExternalResource) RETURN x.entity_id AS url, min(l.source_event_time) AS first, max(l.source_event_time) AS last, "
    "count(l) AS n, count(DISTINCT p.entity_id) AS sources",
    """ SELECT t_id AS url, min(t) AS first, max(t) AS last, count(*) AS n, count(DISTINCT s_id) AS sources FROM e WHERE s_label = 'PullRequest' AND svc = 'LINKS_TO' GROUP BY 1""",
)


@register(
    f"""WITH {oracle.RAW} SELECT src_entity_id AS issue, tar_entity_id AS actor, 2::BIGINT AS n FROM raw WHERE relation_label_repr = 'Issue_OpenedBy_Actor'"""
)
def cypher_parallel_edges(spark, sf_dir):
    """Two equal edges are two: each may stand for either name in a pattern."""
    rows = raw_records(spark, sf_dir).where("relation_label_repr = 'Issue_OpenedBy_Actor'")
    doubled = normalize(rows.unionByName(rows), NATIVE_LABELS, prefer_aggregated=False)
    return run_query(doubled, "MATCH (i:Issue)-[x:OPENED_BY]->(a:Actor)<-[y:OPENED_BY]-(i) RETURN i.entity_id AS issue, a.entity_id AS actor, count(*) AS n")


# checks of query texts

_TEXTS = (
    "MATCH (a:Actor) RETURN a", "MATCH (a:Nope) RETURN a", "MATCH (a:Actor)-[:NOPE]->(b:Issue) RETURN a.nope", "", "MATCH (a:Actor RETURN a",
    "MATCH (a:Issue)-[:REFERENCE]->(b:Issue) RETURN b",
)
_SCHEMA = validate.Schema(
    frozenset(("Actor", "Issue")), frozenset(("EVENT_ACTION",)), frozenset(("entity_id",)), {}, {}, frozenset(("Issue-[:EVENT_ACTION]->Actor",))
)


@register(
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'UNKNOWN_LABEL' WHEN 2 THEN 'UNKNOWN_REL,ILLEGAL_PROPERTY,DIRECTION_MISMATCH'
        WHEN 3 THEN 'EMPTY_QUERY' WHEN 4 THEN 'UNBALANCED_PARENTHESES' ELSE 'UNKNOWN_REL,DIRECTION_MISMATCH' END AS codes,
      CASE event_id % 6 WHEN 0 THEN 'missing_required_relationship' WHEN 1 THEN 'disallowed_labels:[''Nope'']|missing_required_relationship'
        WHEN 2 THEN 'disallowed_relationships:[''NOPE'']|disallowed_properties:[''nope'']|direction_constraint_violation'
        WHEN 3 THEN 'empty_query|missing_required_relationship' WHEN 4 THEN 'unbalanced_parentheses|missing_required_relationship'
        ELSE 'disallowed_relationships:[''REFERENCE'']|direction_constraint_violation' END AS strings,
      CASE event_id % 6 WHEN 1 THEN 'Nope' WHEN 2 THEN 'Actor-[:NOPE]->Issue,NOPE' WHEN 5 THEN 'Issue-[:REFERENCE]->Issue,REFERENCE' ELSE '' END AS tokens,
      CASE event_id % 6 WHEN 2 THEN 'nope' ELSE '' END AS properties, CASE WHEN event_id % 6 IN (2, 5) THEN 1 ELSE 0 END AS hops FROM events"""
)
def text_checks(spark, sf_dir):
    text = F.element_at(F.array(*[F.lit(t) for t in _TEXTS]), (F.col("event_id") % 6 + 1).cast("int"))
    rows = evaluate.validate_batch(read(spark, sf_dir, "events").select("event_id", text.alias("text")), "text", _SCHEMA)
    detail = validate.failure_details("text", F.col("codes"), _SCHEMA)
    strings = validate.string_codes("text", _SCHEMA, F.lit("join_traversal"), ())
    return rows.select("event_id", "codes", strings.alias("s"), detail.alias("d")).select(
        "event_id", F.array_join("codes", ",").alias("codes"), F.array_join("s", "|").alias("strings"), F.array_join("d.offending_tokens", ",").alias("tokens"),
        F.array_join("d.offending_properties", ",").alias("properties"), F.col("d.hop_count").alias("hops"),
    )


@register("SELECT event_id, event_type, user_id, 'q' || (event_id % 3) AS query_id, 'type' || (event_id % 3) AS query_type FROM events")
def corpus_join(spark, sf_dir):
    cases = read(spark, sf_dir, "events").select("event_id", "event_type", "user_id", F.concat(F.lit("q"), (F.col("event_id") % 3).cast("string")).alias("query_id"))
    queries = spark.range(3).select(F.concat(F.lit("q"), F.col("id").cast("string")).alias("query_id"), F.concat(F.lit("type"), F.col("id").cast("string")).alias("query_type"))
    return evaluate.joined_corpus(cases, queries)


# round trips through sinks and readers


@register(oracle.edges() + " SELECT rel AS rel_type, svc AS service_rel_type, count(*) AS n, count(DISTINCT s_uid) AS sources FROM e GROUP BY ALL")
def csv_round_trip(spark, sf_dir):
    path = store.scratch_path(spark, "csv")
    with passing_graph(spark, sf_dir) as made:
        sinks.write(made, path, "csv", compression="gzip")
    back = readers.read_records(spark, f"{path}/edges", "csv")
    return back.groupBy("rel_type", "service_rel_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source_node_uid").alias("sources"))


@register(
    oracle.edges() + """ SELECT 'edge' AS type, rel AS kind, count(*) AS n FROM e GROUP BY ALL
    UNION ALL SELECT 'node', label, count(*) FROM (SELECT s_label AS label, s_id AS id FROM e UNION SELECT t_label, t_id FROM e) GROUP BY 2"""
)
def jsonl_round_trip(spark, sf_dir):
    path = store.scratch_path(spark, "jsonl")
    sinks.write(graph(spark, sf_dir), path, "jsonl")
    back = readers.read_records(spark, path, "jsonl")
    return back.groupBy("type", F.coalesce("label", "rel_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@register(
    oracle.edges() + """ SELECT 'MATCH' AS statement, rel AS kind, count(*) AS n FROM e GROUP BY ALL
    UNION ALL SELECT 'MERGE', label, count(*) FROM (SELECT s_label AS label, s_id AS id FROM e UNION SELECT t_label, t_id FROM e) GROUP BY 2"""
)
def script_round_trip(spark, sf_dir):
    path = store.scratch_path(spark, "script")
    with passing_graph(spark, sf_dir) as made:
        sinks.write(made, path, "cypher", compression="gzip")
    statement = F.substring_index("value", " ", 1)
    # texts of statements hold no bare quote, so what follows the ends' ids is the relation; plain searches cost less than patterns
    bond = "' }) MERGE (s)-[r:"
    at = F.locate(bond, F.col("value"))
    label = F.substring(F.substring_index("value", " ", 2), len("MERGE (n:") + 1, 200)
    relation = F.when(at > 0, F.substring_index(F.substring(F.col("value"), at + len(bond), F.lit(200)), " ", 1)).otherwise("")
    kind = F.when(F.col("value").startswith("MERGE (n:"), label).otherwise(relation)
    return spark.read.text(path).groupBy(statement.alias("statement"), kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@register(
    oracle.edges("true") + """ SELECT (SELECT count(*) FROM (SELECT s_uid FROM e WHERE t_id <> '' UNION SELECT t_uid FROM e WHERE t_id <> '')) AS node_count,
      count(*) FILTER (WHERE t_id <> '') AS edge_count, count(*) FILTER (WHERE t_id = '') AS skipped_records FROM e"""
)
def parquet_round_trip(spark, sf_dir):
    path = store.scratch_path(spark, "parquet")
    sinks.write(graph(spark, sf_dir), path, "parquet")
    return store.load(spark, path).summary()
