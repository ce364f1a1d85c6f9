"""Registered queries of the graph engine with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import oracle
from loomgraph.functions import clean
from loomgraph.functions.mentions import mentions
from loomgraph.operators import preprocess as pre
from loomgraph.operators import reports, resolve
from loomgraph.plans import evaluate
from loomgraph.plans.compile import run_query
from loomgraph.plans.generate import FREE_FORM
from loomgraph.plans.repair import Intent
from loomgraph.plans.validate import Schema, Template
from loomgraph.session import spread
from loomgraph.sources.graph_view import graph, raw_records, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Texts of the registered queries of the language.
TEXTS: dict[str, str] = {}


def register(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def cypher(name: str, text: str, sql: str, arrays: tuple[str, ...] = (), params: dict | None = None) -> None:
    """Register a query of the language; its arrays come back as sorted texts joined by |."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = run_query(graph(spark, sf_dir), text, params)
        for a in arrays:
            out = out.withColumn(a, F.array_join(F.sort_array(F.col(a).cast("array<string>")), "|"))
        return out

    QUERIES[name] = run
    TEXTS[name] = text
    SQL[name] = oracle.edges() + sql


# the graph and its distributions


@register(
    oracle.edges()
    + """ SELECT label || ':' || id AS node_uid, label, id AS entity_id, label AS raw_entity_type FROM (
      SELECT s_label AS label, s_id AS id FROM e UNION SELECT t_label, t_id FROM e)"""
)
def normalize_nodes(spark, sf_dir):
    return graph(spark, sf_dir).nodes


@register(
    oracle.edges()
    + """ SELECT s_uid AS source_node_uid, t_uid AS target_node_uid, rel AS rel_type, svc AS service_rel_type,
      verb AS eventaction_verb_label, event_time, t AS source_event_time, domain AS url_domain_etld1 FROM e"""
)
def normalize_edges(spark, sf_dir):
    return graph(spark, sf_dir).edges.select(
        "source_node_uid", "target_node_uid", "rel_type", "service_rel_type", "eventaction_verb_label", "event_time",
        "source_event_time", "url_domain_etld1",
    )


@register(oracle.edges() + " SELECT rel AS rel_type, svc AS service_rel_type, count(*) AS n FROM e GROUP BY ALL")
def edge_service_distribution(spark, sf_dir):
    return reports.value_counts(graph(spark, sf_dir).edges, "rel_type", "service_rel_type")


@register(
    oracle.edges("true")
    + """ SELECT (SELECT count(*) FROM (SELECT s_uid FROM e WHERE t_id <> '' UNION SELECT t_uid FROM e WHERE t_id <> '')) AS node_count,
      count(*) FILTER (WHERE t_id <> '') AS edge_count, count(*) FILTER (WHERE t_id = '') AS skipped_records FROM e"""
)
def placeholder_skip(spark, sf_dir):
    return graph(spark, sf_dir).summary()


_ORDER = "src_entity_id, src_entity_type, tar_entity_id, tar_entity_type, relation_type, relation_label_repr, event_time, pattern, match_text"


@register(
    f"""WITH {oracle.RAW}, n AS (SELECT *, row_number() OVER (ORDER BY {_ORDER}) - 1 AS o FROM raw)
    SELECT src_entity_type || ':' || src_entity_id AS source_node_uid, 'UnknownObject:unknown:target:' || o AS target_node_uid
    FROM n WHERE tar_entity_id = ''"""
)
def placeholder_unknown(spark, sf_dir):
    edges = graph(spark, sf_dir, "unknown").edges
    return edges.where("dst_label = 'UnknownObject'").select("source_node_uid", "target_node_uid")


@register(
    f"""WITH {oracle.RAW}, n AS (SELECT *, row_number() OVER (ORDER BY {_ORDER}) - 1 AS o FROM raw)
    SELECT CASE WHEN tar_entity_id = '' AND src_entity_type = 'IssueComment' THEN 'UnknownObject' ELSE tar_entity_type END AS label,
           count(*) AS n, count(DISTINCT CASE WHEN tar_entity_id = '' THEN 'unknown:target:' || o ELSE tar_entity_id END) AS ids
    FROM n GROUP BY 1"""
)
def placeholder_external_if_url(spark, sf_dir):
    edges = graph(spark, sf_dir, "external_if_url").edges
    return edges.groupBy(F.col("dst_label").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("dst_entity_id").alias("ids"))


@register(
    oracle.edges() + """, n AS (SELECT s_uid AS uid FROM e UNION SELECT t_uid FROM e)
    SELECT rel AS rel_type, s_label AS source_label, t_label AS target_label, count(*) AS n
    FROM e JOIN n a ON a.uid = s_uid JOIN n b ON b.uid = t_uid GROUP BY ALL"""
)
def edge_endpoint_join(spark, sf_dir):
    return reports.endpoint_labels(graph(spark, sf_dir)).groupBy("rel_type", "source_label", "target_label").agg(F.count(F.lit(1)).alias("n"))


@register(
    oracle.edges() + """ SELECT 'label' AS kind, l AS value FROM (SELECT s_label AS l FROM e UNION SELECT t_label FROM e)
    UNION ALL SELECT DISTINCT 'relation', rel FROM e
    UNION ALL SELECT DISTINCT 'direction', s_label || '-[:' || rel || ']->' || t_label FROM e"""
)
def schema_inference(spark, sf_dir):
    return reports.inferred_schema(graph(spark, sf_dir)).where("kind IN ('label', 'relation', 'direction')")


# mapping rules


@register(
    f"""WITH {oracle.RAW}, u AS (SELECT 'src_entity_type' AS source, src_entity_type AS raw_type FROM raw
      UNION SELECT 'tar_entity_type', tar_entity_type FROM raw)
    SELECT source AS raw_type_source, raw_type,
      CASE WHEN raw_type IN ('', 'ExternalResource') THEN 'UnknownObject' ELSE raw_type END AS normalized_type,
      CASE WHEN raw_type IN ('', 'ExternalResource') THEN 'unknown' ELSE 'map' END AS action,
      CASE raw_type WHEN '' THEN 'missing_or_empty_type' WHEN 'ExternalResource' THEN 'unrecognized_raw_type'
           ELSE 'native_gh_core_type' END AS reason,
      CASE raw_type WHEN '' THEN 1000 WHEN 'ExternalResource' THEN 50 ELSE 10 END AS priority,
      CASE raw_type WHEN 'ExternalResource' THEN 'external_type_hint=ExternalResource' ELSE '' END AS notes FROM u"""
)
def node_type_mapping(spark, sf_dir):
    return reports.node_mapping(raw_records(spark, sf_dir), ("src_entity_type", "tar_entity_type"))


@register(
    f"""WITH {oracle.RAW}
    SELECT CASE pattern WHEN 'GitHub_Service_External_Links' THEN 'EXTERNAL' WHEN 'GitHub_Other_Service' THEN 'GH_SEMI'
                ELSE 'GH_INTERNAL' END AS kind,
           CASE pattern WHEN 'GitHub_Service_External_Links' THEN 'rule_a1' WHEN 'GitHub_Other_Service' THEN 'rule_a2' ELSE 'rule_a3' END AS kind_rule,
           CASE pattern WHEN 'GitHub_Service_External_Links' THEN 'LINKS_TO' WHEN 'Actor' THEN 'MENTIONS' WHEN 'SHA' THEN 'REFERENCES'
                ELSE 'LINKS_TO' END AS hint,
           CASE pattern WHEN 'GitHub_Service_External_Links' THEN 'high' WHEN 'Actor' THEN 'high' ELSE 'med' END AS confidence,
           count(*) AS n
    FROM raw WHERE relation_type = 'Reference' GROUP BY ALL"""
)
def target_kind_service_hint(spark, sf_dir):
    return reports.hint_counts(raw_records(spark, sf_dir))


@register(
    f"""SELECT page_id, url AS url_raw, {oracle.HOST.format('url')} AS url_host,
      regexp_extract({oracle.HOST.format('url')}, '([^.]+\\.[^.]+)$', 1) AS url_domain_etld1, false AS url_is_github FROM pages"""
)
def url_info_pages(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", clean.url_info("url").alias("u")).select("page_id", "u.*")


@register(
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS as_text, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS as_epoch,
      strftime(ts, '%Y-%m-%d') || 'T00:00:00Z' AS as_date, NULL AS as_junk FROM events"""
)
def time_normalize(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select(
        "event_id", clean.normal_time(F.date_format("ts", "yyyy/MM/dd HH:mm:ss")).alias("as_text"),
        clean.normal_time(F.unix_seconds(F.col("ts").cast("timestamp")).cast("string")).alias("as_epoch"),
        clean.normal_time(F.date_format("ts", "yyyy-MM-dd")).alias("as_date"),
        clean.normal_time(F.concat(F.lit("x"), "event_type")).alias("as_junk"),
    )


@register(
    f"""WITH {oracle.RAW} SELECT relation_label_repr AS label, split_part(relation_label_repr, '_', 2) AS verb,
      upper(regexp_replace(split_part(relation_label_repr, '_', 2), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) AS service, count(*) AS n
      FROM raw GROUP BY ALL"""
)
def verb_from_label(spark, sf_dir):
    verb = clean.verb_from_label("relation_label_repr")
    out = raw_records(spark, sf_dir).select(F.col("relation_label_repr").alias("label"), verb.alias("verb"), clean.upper_snake(verb).alias("service"))
    return reports.value_counts(out, "label", "verb", "service")


# ids


def _broken(spark, sf_dir) -> DataFrame:
    """Line items as references whose ids have to be rebuilt from properties written as Python text."""
    kinds = F.array(*[F.lit(k) for k in ("Issue", "PullRequestReviewComment", "Commit", "Release", "Gollum", "Actor", "")])
    kind = F.get(kinds, (F.col("l_linenumber") % 7).cast("int"))
    number = F.when(F.col("l_quantity") < 25, F.col("l_orderkey").cast("string"))
    props = F.concat(
        F.lit("{'repo_id': "), F.col("l_suppkey"), F.lit(", 'repo_name': 'it/em', 'issue_number': "), F.coalesce(number, F.lit("None")),
        F.lit(", 'pull_review_comment_id': '"), F.col("l_partkey"), F.lit("', 'release_id': "), F.col("l_linenumber"), F.lit("}"),
    )
    return spread(read(spark, sf_dir, "lineitem")).select(
        F.concat(F.lit("IC_"), F.col("l_suppkey"), F.lit("#"), F.col("l_orderkey"), F.lit("#"), F.col("l_linenumber")).alias("src_entity_id"),
        F.lit("IssueComment").alias("src_entity_type"),
        F.when(F.col("l_returnflag") == "N", "X_None").when(F.col("l_returnflag") == "R", "").otherwise("I_1#1").alias("tar_entity_id"),
        F.lit("Object").alias("tar_entity_type"), F.lit("Reference").alias("relation_type"), kind.alias("tar_entity_type_fine_grained"),
        F.lit("").alias("tar_entity_match_pattern_type"),
        F.concat(F.lit("see "), F.md5(F.col("l_partkey").cast("string"))).alias("tar_entity_match_text"),
        props.alias("tar_entity_objnt_prop_dict"), "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity",
    )


_FIX = """WITH b AS (SELECT *, ['Issue','PullRequestReviewComment','Commit','Release','Gollum','Actor','Issue'][CAST(l_linenumber % 7 AS INT) + 1] AS kind,
   l_linenumber % 7 = 6 AS blank, CASE l_returnflag WHEN 'N' THEN 'X_None' WHEN 'R' THEN '' ELSE 'I_1#1' END AS old,
   CASE WHEN l_quantity < 25 THEN CAST(l_orderkey AS VARCHAR) END AS num FROM lineitem),
 f AS (SELECT *, CASE kind WHEN 'Issue' THEN 'I_' || l_suppkey || '#' || num
     WHEN 'PullRequestReviewComment' THEN 'PRRC_' || l_suppkey || '#' || num || '#r' || l_partkey
     WHEN 'Commit' THEN 'C_' || l_suppkey || '@' || md5(CAST(l_partkey AS VARCHAR))
     WHEN 'Release' THEN 'RE_' || l_suppkey || '-' || l_linenumber END AS made,
   CASE WHEN kind IN ('Issue', 'PullRequestReviewComment') AND num IS NULL THEN 'issue_number'
        WHEN kind = 'Actor' THEN 'actor_id' ELSE '' END AS gaps FROM b),
 g AS (SELECT *, CASE WHEN kind = '' THEN 'skipped_no_fine_grained' WHEN old = 'I_1#1' THEN 'skipped_not_needed'
     WHEN kind = 'Gollum' THEN 'failed_unsupported_type:Gollum' WHEN gaps <> '' THEN 'failed_missing_fields:' || gaps ELSE 'repaired' END AS status FROM f)"""
_FIX = _FIX.replace("'Actor','Issue']", "'Actor','']").replace("l_linenumber % 7 = 6 AS blank, ", "")


@register(_FIX + " SELECT l_orderkey, l_linenumber, kind, made AS entity_id, gaps AS missing FROM g WHERE kind NOT IN ('', 'Gollum')")
def exid_rebuild(spark, sf_dir):
    kind = F.col("tar_entity_type_fine_grained")
    made = pre.rebuild(_broken(spark, sf_dir).where(~kind.isin("", "Gollum")), kind)
    return made.select("l_orderkey", "l_linenumber", kind.alias("kind"), "entity_id", F.array_join("missing", ",").alias("missing"))


@register(_FIX + " SELECT status, CASE WHEN status = 'repaired' THEN made ELSE old END AS entity_id, count(*) AS n FROM g GROUP BY ALL")
def exid_repair_status(spark, sf_dir):
    fixed = pre.preprocess(_broken(spark, sf_dir), "fast_exid").select(
        F.col("tar_entity_id_repair_status").alias("status"), F.col("tar_entity_id").alias("entity_id")
    )
    return reports.value_counts(fixed, "status", "entity_id")


@register(_FIX + " SELECT split_part(status, ':', 2) AS field, count(*) AS n FROM g WHERE status LIKE 'failed_missing_fields:%' GROUP BY 1")
def missing_field_counter(spark, sf_dir):
    return reports.missing_fields(pre.preprocess(_broken(spark, sf_dir), "fast_exid"))


@register(
    _FIX + """, h AS (SELECT kind, count(*) AS total, avg(CASE WHEN status LIKE 'failed_missing%' THEN 1.0 ELSE 0 END) AS missing,
        avg(CASE WHEN status = 'repaired' THEN 1.0 ELSE 0 END) AS recovered FROM g WHERE kind <> '' GROUP BY 1)
    SELECT kind, total, round(missing, 6) AS missing_ratio, round(recovered, 6) AS recoverable_ratio,
      CASE WHEN missing > 0.5 AND recovered >= 0.5 THEN 'HIGH' WHEN missing > 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS priority FROM h"""
)
def repair_priority(spark, sf_dir):
    return reports.repair_priority(pre.preprocess(_broken(spark, sf_dir), "fast_exid"))


@register(
    """WITH d AS (SELECT CASE WHEN l_linenumber % 3 = 0 THEN 'Actor' ELSE 'IssueComment' END AS st, * FROM lineitem)
    SELECT CASE WHEN st = 'Actor' THEN 'Actor' ELSE 'Repo' END AS src_entity_type_agg,
      CASE l_linenumber % 4 WHEN 0 THEN 'Repo' WHEN 1 THEN 'Actor' ELSE 'Object' END AS tar_entity_type_agg,
      count(*) AS n, count(DISTINCT CASE l_linenumber % 4 WHEN 0 THEN 'R_' || l_suppkey WHEN 1 THEN 'A_' || l_suppkey ELSE 'T' || l_orderkey END) AS targets
    FROM d GROUP BY ALL"""
)
def granular_agg(spark, sf_dir):
    k = F.col("l_linenumber") % 4
    number = F.col("l_suppkey").cast("string")
    props = F.when(k == 0, F.concat(F.lit("{'repo_id': "), number, F.lit("}"))).when(
        k == 1, F.concat(F.lit("{'actor_id': '"), number, F.lit("'}"))
    ).when(k == 2, F.lit("{'repo_id': None, 'actor_id': 3}")).otherwise(F.lit("not an object"))
    kind = F.when(F.col("l_linenumber") % 3 == 0, "Actor").otherwise("IssueComment")
    rows = read(spark, sf_dir, "lineitem").select(
        pre.aggregated(F.lit("A_1"), kind, F.concat(F.lit("T"), F.col("l_orderkey")), clean.object_map(props), F.col("l_suppkey")).alias("a")
    ).select("a.*")
    return rows.groupBy("src_entity_type_agg", "tar_entity_type_agg").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("tar_entity_id_agg").alias("targets")
    )


@register(
    """SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_name WHEN c_custkey % 4 = 1 THEN c_mktsegment
      WHEN c_custkey % 4 = 2 THEN 'unknown' END AS value, c_custkey % 4 = 3 OR c_custkey % 4 = 2 AS placeholder FROM customer"""
)
def alias_coalesce(spark, sf_dir):
    k = F.col("c_custkey") % 4
    rows = read(spark, sf_dir, "customer").select(
        "c_custkey", F.when(k == 0, F.col("c_name")).when(k == 1, " ").otherwise("nan").alias("a"),
        F.when(k == 1, F.col("c_mktsegment")).when(k == 2, "unknown").otherwise("None").alias("b"), F.lit(None).cast("string").alias("c"),
    )
    value = clean.first_present("a", "b", "c")
    return rows.select("c_custkey", value.alias("value"), clean.is_placeholder(value).alias("placeholder"))


@register("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props_parse(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@register(
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'int' WHEN 1 THEN 'float' ELSE 'text' END AS kind,
      CASE event_id % 3 WHEN 0 THEN CAST(user_id AS DOUBLE) WHEN 1 THEN user_id + 0.5 END AS number FROM events"""
)
def numeric_coerce(spark, sf_dir):
    k, user = F.col("event_id") % 3, F.col("user_id").cast("string")
    text = F.when(k == 0, F.concat(F.lit(" "), user)).when(k == 1, F.concat(user, F.lit(".5"))).otherwise(F.concat(user, F.lit("_x")))
    return read(spark, sf_dir, "events").select("event_id", clean.coerced_kind(text).alias("kind"), clean.coerced_number(text).alias("number"))


# aggregations and reports


@register(
    f"""WITH {oracle.RAW} SELECT src_entity_type, tar_entity_type, relation_type,
      coalesce(string_agg(DISTINCT nullif(relation_label_repr, ''), '|' ORDER BY nullif(relation_label_repr, '')), '') AS labels,
      coalesce(string_agg(DISTINCT nullif(pattern, ''), '|' ORDER BY nullif(pattern, '')), '') AS patterns, count(*) AS n FROM raw GROUP BY ALL"""
)
def native_relation_collapse(spark, sf_dir):
    return reports.collapse(
        raw_records(spark, sf_dir), ("src_entity_type", "tar_entity_type", "relation_type"),
        {"labels": "relation_label_repr", "patterns": "tar_entity_match_pattern_type"},
    )


@register(oracle.edges() + " SELECT s_label AS src_label, t_label AS dst_label, count(*) AS n FROM e GROUP BY ALL")
def pair_counts(spark, sf_dir):
    return reports.value_counts(graph(spark, sf_dir).edges, "src_label", "dst_label")


@register(
    oracle.edges() + """, c AS (SELECT verb, count(*) AS n FROM e WHERE rel = 'EVENT_ACTION' GROUP BY 1)
    SELECT verb, n, row_number() OVER w AS k, round(sum(n) OVER w / (SELECT sum(n) FROM c), 6) AS coverage FROM c
    WINDOW w AS (ORDER BY verb ROWS UNBOUNDED PRECEDING)"""
)
def coverage_curve(spark, sf_dir):
    return reports.coverage(graph(spark, sf_dir).edges.where("rel_type = 'EVENT_ACTION'"), "eventaction_verb_label").withColumnRenamed(
        "eventaction_verb_label", "verb"
    )


@register("SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS ratio FROM events GROUP BY 1")
def ratio_of_total(spark, sf_dir):
    return reports.ratios(read(spark, sf_dir, "events"), "event_type")


@register(
    """WITH a AS (SELECT l_returnflag AS k, count(*) AS n FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1),
      b AS (SELECT l_linestatus AS k, count(*) AS n FROM lineitem WHERE l_linenumber > 2 GROUP BY 1)
    SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta
    FROM a FULL JOIN b ON a.k = b.k"""
)
def before_after_delta(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem")
    before = rows.where("l_linenumber <= 2").select(F.col("l_returnflag").alias("k"))
    after = rows.where("l_linenumber > 2").select(F.col("l_linestatus").alias("k"))
    return reports.delta(before, after, "k")


@register(
    """WITH c AS (SELECT l_suppkey AS k, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT k, n, row_number() OVER (ORDER BY n, k) <= 5 AS rare FROM c"""
)
def rare_tail(spark, sf_dir):
    return reports.rare(read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k")), "k", 5)


@register("SELECT l_partkey AS k, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, k LIMIT 20")
def top_k_counts(spark, sf_dir):
    return reports.top_counts(read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k")), "k", 20)


@register(
    """WITH c AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, k) AS p FROM c)
    SELECT coalesce(sum(n) FILTER (WHERE p > 30), 0)::BIGINT AS tail_n, count(*) FILTER (WHERE p > 30) AS tail_keys FROM r"""
)
def tail_sum(spark, sf_dir):
    return reports.tail(read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k")), "k", 30)


@register(
    """SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events)
    WHERE r <= 3"""
)
def first3_per_group(spark, sf_dir):
    return reports.first_per_group(read(spark, sf_dir, "events"), ("event_type",), ("event_id",), 3).select("event_type", "event_id")


@register("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1")
def dedup_keep_last(spark, sf_dir):
    return reports.keep_last(read(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ("user_id",), "event_id")


@register(
    """SELECT n_name AS name, n_regionkey AS region, CAST(NULL AS DOUBLE) AS balance FROM nation
    UNION ALL SELECT s_name, NULL, s_acctbal FROM supplier"""
)
def union_all_by_name(spark, sf_dir):
    n = read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return n.unionByName(read(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")), True)


@register(
    """SELECT CAST(c_custkey AS VARCHAR) AS repo_id, CASE WHEN c_custkey % 5 = 0 THEN 'new/' ELSE 'old/' END || c_name AS repo_full_name FROM customer"""
)
def upsert_index(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    old = c.select(F.col("c_custkey").cast("string").alias("repo_id"), F.concat(F.lit("old/"), "c_name").alias("repo_full_name"))
    new = c.where("c_custkey % 5 = 0").select(F.col("c_custkey").cast("string").alias("repo_id"), F.concat(F.lit("new/"), "c_name").alias("repo_full_name"))
    blank = new.select("repo_id", F.lit(" ").alias("repo_full_name"))
    return resolve.upsert(old, new.unionByName(blank), "repo_id", "repo_full_name")


def _indexes(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    repos = read(spark, sf_dir, "nation").select(
        (F.col("n_nationkey") + 1).cast("string").alias("repo_id"), F.lower(F.concat(F.lit("org/"), "n_name")).alias("repo_full_name")
    )
    actors = read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("string").alias("actor_id"), F.regexp_replace("s_name", "[^A-Za-z0-9]", "").alias("actor_login")
    )
    return repos, actors


@register(
    """SELECT s_suppkey, CAST(n_nationkey + 1 AS VARCHAR) AS repo_id FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND s_suppkey % 2 = 0"""
)
def index_lookup(spark, sf_dir):
    repos, _ = _indexes(spark, sf_dir)
    names = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    asked = read(spark, sf_dir, "supplier").join(names, "s_nationkey").select(
        "s_suppkey", F.concat(F.when(F.col("s_suppkey") % 2 == 0, " Org/").otherwise("none/"), "n_name").alias("name")
    )
    return resolve.lookup(asked, "name", repos, "repo_id", "repo_full_name").select("s_suppkey", "repo_id")


@register(
    """SELECT count(*) AS rows, count(DISTINCT c_name) AS distinct_names, count(DISTINCT c_mktsegment) AS distinct_ids,
      (SELECT coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM customer GROUP BY c_mktsegment HAVING count(*) > 1)) AS duplicated_ids,
      0.0::DOUBLE AS missing_name_rate FROM customer"""
)
def index_quality(spark, sf_dir):
    return resolve.index_quality(read(spark, sf_dir, "customer"), "c_mktsegment", "c_name")


_RESOLVE = {
    "repo": """WITH q AS (SELECT s_suppkey, s_suppkey % 6 AS k, s_nationkey, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey)
      SELECT s_suppkey, CASE k WHEN 0 THEN 'R_' || (s_nationkey + 1) WHEN 1 THEN 'R_' || s_suppkey WHEN 2 THEN 'R_' || s_suppkey
          WHEN 3 THEN 'R_' || (s_nationkey + 1) END AS entity_id,
        CASE k WHEN 0 THEN 'local_index' WHEN 1 THEN 'direct_id' WHEN 2 THEN 'direct_kv_id' WHEN 3 THEN 'local_index' ELSE 'failed' END AS provenance
      FROM q""",
    "actor": """SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'A_' || s_suppkey WHEN 1 THEN 'A_' || s_suppkey WHEN 2 THEN 'A_' || s_suppkey
          WHEN 3 THEN 'A_' || s_suppkey END AS entity_id,
        CASE s_suppkey % 5 WHEN 0 THEN 'direct_id' WHEN 1 THEN 'local_index' WHEN 2 THEN 'direct_kv_id' WHEN 3 THEN 'local_index' ELSE 'failed' END AS provenance
      FROM supplier""",
}


@register(_RESOLVE["repo"])
def resolve_repo(spark, sf_dir):
    repos, _ = _indexes(spark, sf_dir)
    names = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    k, name, key = F.col("s_suppkey") % 6, F.concat(F.lit("Org/"), "n_name"), F.col("s_suppkey").cast("string")
    text = (
        F.when(k == 0, name).when(k == 1, F.concat(F.lit("R_"), key)).when(k == 2, F.concat(F.lit("repo_id="), key))
        .when(k == 3, F.concat(F.lit("https://github.com/"), name, F.lit("/issues/1"))).when(k == 4, "no/where").otherwise(" ")
    )
    asked = read(spark, sf_dir, "supplier").join(names, "s_nationkey").select("s_suppkey", text.alias("q"))
    return resolve.resolve_repo(asked, "q", repos).select("s_suppkey", "entity_id", "provenance")


@register(_RESOLVE["actor"])
def resolve_actor(spark, sf_dir):
    _, actors = _indexes(spark, sf_dir)
    k, key, handle = F.col("s_suppkey") % 5, F.col("s_suppkey").cast("string"), F.regexp_replace("s_name", "[^A-Za-z0-9]", "")
    text = (
        F.when(k == 0, F.concat(F.lit("A_"), key)).when(k == 1, F.concat(F.lit("@"), handle)).when(k == 2, F.concat(F.lit("actor_id:"), key))
        .when(k == 3, F.concat(F.lit("login="), F.upper(handle))).otherwise("nobody-here")
    )
    return resolve.resolve_actor(read(spark, sf_dir, "supplier").select("s_suppkey", text.alias("q")), "q", actors).select(
        "s_suppkey", "entity_id", "provenance"
    )


@register(
    """SELECT doc_id, unnest(regexp_extract_all(text, '@\\s*([A-Za-z0-9][A-Za-z0-9-]*)', 1)) AS handle FROM documents"""
)
def mentions_handles(spark, sf_dir):
    found = read(spark, sf_dir, "documents").where(F.col("text").contains("@")).select("doc_id", F.explode(mentions("text")).alias("m"))
    return found.where("m.hint_type = 'actor_handle'").select("doc_id", F.col("m.normalized_text").alias("handle"))


@register("SELECT n_nationkey, 'PR_' || n_nationkey AS pr, 'I_' || n_nationkey AS issue, 'C_' || n_nationkey AS commit_prefix FROM nation")
def repo_scope_prefix(spark, sf_dir):
    prefix = resolve.scope_prefixes(F.concat(F.lit("R_"), F.col("n_nationkey")), ("PullRequest", "Issue", "Commit"))
    return read(spark, sf_dir, "nation").select("n_nationkey", prefix.alias("p")).select(
        "n_nationkey", F.col("p")["PullRequest"].alias("pr"), F.col("p")["Issue"].alias("issue"), F.col("p")["Commit"].alias("commit_prefix")
    )


@register(
    f"""WITH {oracle.RAW}
    """ + " UNION ALL ".join(
        f"SELECT '{c}' AS field, count(*) AS rows, count(*) FILTER (WHERE {q} = '') AS missing, count(DISTINCT {q}) AS distinct_values FROM raw"
        for c, q in (("src_entity_type", "src_entity_type"), ("tar_entity_type", "tar_entity_type"), ("relation_type", "relation_type"),
                     ("relation_label_repr", "relation_label_repr"))
    )
)
def field_dictionary(spark, sf_dir):
    columns = ("src_entity_type", "tar_entity_type", "relation_type", "relation_label_repr")
    return reports.field_dictionary(raw_records(spark, sf_dir).select(*columns)).select("field", "rows", "missing", "distinct_values")


@register(
    f"""WITH {oracle.RAW}, k AS (SELECT *, md5(concat_ws('|', '42', {_ORDER})) AS h FROM raw)
    SELECT * EXCLUDE h RENAME (pattern AS tar_entity_match_pattern_type, match_text AS tar_entity_match_text) FROM (
      (SELECT * FROM k WHERE relation_type = 'Reference' ORDER BY h LIMIT 500) UNION ALL (SELECT * FROM k WHERE relation_type <> 'Reference' ORDER BY h LIMIT 500))"""
)
def stratified_sample(spark, sf_dir):
    return reports.stratified_sample(raw_records(spark, sf_dir), F.col("relation_type") == "Reference", 1000)


@register(
    """SELECT l_linenumber AS k, count(*) AS n, sum(l_quantity) AS total, round(avg(l_quantity), 6) AS mean, min(l_quantity) AS least,
      max(l_quantity) AS most FROM lineitem GROUP BY 1"""
)
def slot_aggregates(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("k")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("total"), F.round(F.avg("l_quantity"), 6).alias("mean"),
        F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"),
    )


@register(
    """SELECT event_type AS generator, count(*) AS examples, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0 END), 6) AS valid_rate,
      round(coalesce(sum(CASE WHEN value > 50 AND user_id % 2 = 0 THEN 1.0 ELSE 0 END) / nullif(sum(CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END), 0), 0), 6) AS repair_rate
    FROM events GROUP BY 1"""
)
def metrics_mean_over_attempts(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(
        F.col("event_type").alias("generator"), (F.col("value") > 50).alias("valid"), (F.col("user_id") % 2 == 0).alias("attempted"),
        (F.col("value") > 50).alias("repaired"),
    )
    return reports.metric_means(rows)


# the query language

cypher(
    "cypher_l1_opened_by",
    "MATCH (i:Issue)-[rel:EVENT_ACTION]->(a:Actor {entity_id: $actor}) WHERE rel.service_rel_type = 'OPENED_BY' RETURN i.entity_id AS issue, a.entity_id AS actor",
    " SELECT s_id AS issue, t_id AS actor FROM e WHERE s_label = 'Issue' AND t_label = 'Actor' AND svc = 'OPENED_BY' AND t_id = 'A_7'",
    params={"actor": "A_7"},
)
cypher(
    "cypher_l1_prefix",
    "MATCH (pr:PullRequest) WHERE pr.entity_id STARTS WITH 'PR_7#' RETURN pr.entity_id AS pr",
    " SELECT DISTINCT s_id AS pr FROM e WHERE s_label = 'PullRequest' AND starts_with(s_id, 'PR_7#')",
)
cypher(
    "cypher_l1_references",
    "MATCH (pr:PullRequest)-[rel:REFERENCE]->(x:Commit) WHERE rel.service_rel_type = 'REFERENCES' AND pr.entity_id STARTS WITH 'PR_1' "
    "RETURN pr.entity_id AS pr, x.entity_id AS sha",
    " SELECT s_id AS pr, t_id AS sha FROM e WHERE s_label = 'PullRequest' AND t_label = 'Commit' AND svc = 'REFERENCES' AND starts_with(s_id, 'PR_1')",
)
cypher(
    "cypher_l2_commented_after",
    "MATCH (ic:IssueComment)-[r1:EVENT_ACTION]->(i:Issue) MATCH (ic)-[r2:EVENT_ACTION]->(a:Actor) WHERE i.entity_id STARTS WITH 'I_7#' AND "
    "r1.service_rel_type = 'COMMENTED_ON_ISSUE' AND r2.service_rel_type = 'OPENED_BY' AND r1.source_event_time >= '1995-01-01T00:00:00Z' "
    "RETURN DISTINCT a.entity_id AS actor",
    """ SELECT DISTINCT b.t_id AS actor FROM e a JOIN e b ON a.s_uid = b.s_uid WHERE a.s_label = 'IssueComment' AND a.t_label = 'Issue'
      AND a.svc = 'COMMENTED_ON_ISSUE' AND b.svc = 'OPENED_BY' AND b.t_label = 'Actor' AND a.t >= '1995-01-01T00:00:00Z' AND starts_with(a.t_id, 'I_7#')""",
)
cypher(
    "cypher_l2_links",
    "MATCH (pr:PullRequest)-[rel:REFERENCE]->(e:ExternalResource) WHERE rel.service_rel_type = 'LINKS_TO' AND pr.entity_id STARTS WITH 'PR_3#' "
    "RETURN rel.url_domain_etld1 AS domain, e.entity_id AS url",
    " SELECT domain, t_id AS url FROM e WHERE s_label = 'PullRequest' AND svc = 'LINKS_TO' AND starts_with(s_id, 'PR_3#')",
)
cypher(
    "cypher_l2_mentions",
    "MATCH (ic:IssueComment)-[rel:REFERENCE]->(a:Actor {entity_id: 'A_s3'}) WHERE rel.service_rel_type = 'MENTIONS' RETURN ic.entity_id AS comment",
    " SELECT s_id AS comment FROM e WHERE rel = 'REFERENCE' AND svc = 'MENTIONS' AND t_uid = 'Actor:A_s3'",
)
cypher(
    "cypher_l3_repo_time",
    "MATCH (pr:PullRequest) WHERE pr.entity_id STARTS WITH 'PR_7#' MATCH (pr)-[rr:REFERENCE]->(x:Commit) WHERE rr.service_rel_type = 'REFERENCES' AND "
    "rr.source_event_time >= '1997-01-01T00:00:00Z' AND rr.source_event_time < '1999-01-01T00:00:00Z' "
    "RETURN pr.entity_id AS pr, x.entity_id AS sha, rr.source_event_time AS happened ORDER BY rr.source_event_time DESC, pr.entity_id, x.entity_id LIMIT 50",
    """ SELECT s_id AS pr, t_id AS sha, t AS happened FROM e WHERE svc = 'REFERENCES' AND starts_with(s_id, 'PR_7#') AND t >= '1997-01-01T00:00:00Z'
      AND t < '1999-01-01T00:00:00Z' ORDER BY t DESC, s_id, t_id LIMIT 50""",
)
cypher(
    "cypher_l3_optional_union",
    "MATCH (s)-[rm:REFERENCE]->(a:Actor {entity_id: 'A_s7'}) WHERE rm.service_rel_type = 'MENTIONS' "
    "OPTIONAL MATCH (s)-[ro:EVENT_ACTION]->(p:PullRequest) WHERE ro.service_rel_type = 'COMMENTED_ON_ISSUE' "
    "OPTIONAL MATCH (p)-[rl:REFERENCE]->(e:ExternalResource) WHERE rl.service_rel_type = 'LINKS_TO' "
    "RETURN DISTINCT p.entity_id AS pr, e.entity_id AS url",
    """ SELECT DISTINCT o.t_id AS pr, l.t_id AS url FROM e m
      LEFT JOIN (SELECT * FROM e WHERE t_label = 'PullRequest' AND svc = 'COMMENTED_ON_ISSUE') o ON o.s_uid = m.s_uid
      LEFT JOIN (SELECT * FROM e WHERE t_label = 'ExternalResource' AND svc = 'LINKS_TO') l ON l.s_uid = o.t_uid
      WHERE m.svc = 'MENTIONS' AND m.t_uid = 'Actor:A_s7'""",
)
cypher(
    "cypher_l3_domain_agg",
    "MATCH (pr:PullRequest)-[rel:REFERENCE]->(x:ExternalResource) WHERE rel.service_rel_type = 'LINKS_TO' AND rel.source_event_time >= "
    "'1995-01-01T00:00:00Z' AND rel.source_event_time < '1998-01-01T00:00:00Z' RETURN rel.url_domain_etld1 AS domain, count(*) AS c ORDER BY c DESC LIMIT 20",
    """ SELECT domain, count(*) AS c FROM e WHERE s_label = 'PullRequest' AND svc = 'LINKS_TO' AND t >= '1995-01-01T00:00:00Z'
      AND t < '1998-01-01T00:00:00Z' GROUP BY 1 ORDER BY c DESC LIMIT 20""",
)
cypher(
    "cypher_l4_combo",
    "MATCH (i:Issue) WHERE i.entity_id STARTS WITH 'I_1' MATCH (i)-[ro:EVENT_ACTION]->(a:Actor) MATCH (i)-[rl:REFERENCE]->(e:ExternalResource) "
    "WHERE ro.service_rel_type = 'OPENED_BY' AND rl.service_rel_type = 'LINKS_TO' AND rl.source_event_time >= '2000-06-01T00:00:00Z' "
    "RETURN i.entity_id AS issue, a.entity_id AS actor, rl.url_domain_etld1 AS domain, rl.source_event_time AS happened",
    """ SELECT o.s_id AS issue, o.t_id AS actor, l.domain, l.t AS happened FROM e o JOIN e l ON o.s_uid = l.s_uid
      WHERE o.s_label = 'Issue' AND o.svc = 'OPENED_BY' AND l.svc = 'LINKS_TO' AND l.t >= '2000-06-01T00:00:00Z' AND starts_with(o.s_id, 'I_1')""",
)
cypher(
    "cypher_l4_comment_commit",
    "MATCH (i:Issue) WHERE i.entity_id STARTS WITH 'I_7' MATCH (ic:IssueComment)-[rci:EVENT_ACTION]->(i) MATCH (i)-[rr:REFERENCE]->(c:Commit) "
    "WHERE rci.service_rel_type = 'COMMENTED_ON_ISSUE' AND rr.service_rel_type = 'REFERENCES' RETURN i.entity_id AS issue, c.entity_id AS sha, count(*) AS n",
    """ SELECT a.t_id AS issue, b.t_id AS sha, count(*) AS n FROM e a JOIN e b ON a.t_uid = b.s_uid WHERE a.svc = 'COMMENTED_ON_ISSUE'
      AND a.t_label = 'Issue' AND b.svc = 'REFERENCES' AND starts_with(a.t_id, 'I_7') GROUP BY ALL""",
)
cypher(
    "cypher_l4_in_list",
    "MATCH (ic:IssueComment)-[r1:EVENT_ACTION]->(pr:PullRequest) MATCH (pr)-[r2:EVENT_ACTION]->(r:Repo {entity_id: 'R_7'}) MATCH (ic)-[r3:REFERENCE]->(a:Actor) "
    "WHERE r1.service_rel_type = 'COMMENTED_ON_ISSUE' AND r2.service_rel_type = 'CREATED_IN' AND r3.service_rel_type IN ['MENTIONS','REFERENCES'] "
    "AND r3.source_event_time >= '1994-01-01T00:00:00Z' RETURN DISTINCT a.entity_id AS actor",
    """ SELECT DISTINCT c.t_id AS actor FROM e a JOIN e b ON a.t_uid = b.s_uid JOIN e c ON c.s_uid = a.s_uid WHERE a.svc = 'COMMENTED_ON_ISSUE'
      AND b.svc = 'CREATED_IN' AND b.t_id = 'R_7' AND a.t_label = 'PullRequest' AND c.svc IN ('MENTIONS', 'REFERENCES') AND c.rel = 'REFERENCE'
      AND c.t_label = 'Actor' AND c.t >= '1994-01-01T00:00:00Z'""",
)
cypher(
    "cypher_comp_agg",
    "MATCH (pr:PullRequest) WHERE pr.entity_id STARTS WITH 'PR_1' MATCH (pr)-[rl:REFERENCE]->(e:ExternalResource) OPTIONAL MATCH (pr)-[ra:REFERENCE]->(c:Commit) "
    "WHERE rl.service_rel_type = 'LINKS_TO' AND (ra IS NULL OR ra.service_rel_type IN ['MENTIONS','REFERENCES']) AND rl.source_event_time >= "
    "'1995-01-01T00:00:00Z' AND rl.source_event_time < '1998-01-01T00:00:00Z' RETURN rl.url_domain_etld1 AS domain, collect(DISTINCT c.entity_id) AS commits, "
    "max(rl.source_event_time) AS latest_time, count(DISTINCT pr.entity_id) AS pr_count ORDER BY pr_count DESC, latest_time DESC LIMIT 30",
    """ SELECT l.domain, coalesce(string_agg(DISTINCT r.t_id, '|' ORDER BY r.t_id), '') AS commits, max(l.t) AS latest_time, count(DISTINCT l.s_id) AS pr_count
      FROM e l LEFT JOIN (SELECT * FROM e WHERE rel = 'REFERENCE' AND t_label = 'Commit') r ON r.s_uid = l.s_uid AND l.svc = 'LINKS_TO'
        AND r.svc IN ('MENTIONS', 'REFERENCES') AND l.t >= '1995-01-01T00:00:00Z' AND l.t < '1998-01-01T00:00:00Z'
      WHERE l.s_label = 'PullRequest' AND l.rel = 'REFERENCE' AND l.t_label = 'ExternalResource' AND starts_with(l.s_id, 'PR_1') GROUP BY 1
      ORDER BY pr_count DESC, latest_time DESC LIMIT 30""",
    arrays=("commits",),
)
cypher(
    "cypher_pack_domain_topk",
    "MATCH (repo:Repo {entity_id: $repo})<-[:CREATED_IN]-(pr:PullRequest)-[l:LINKS_TO]->(e:ExternalResource) WHERE l.source_event_time >= date('1994-01-01') "
    "AND l.source_event_time < date('1999-01-01') RETURN l.url_domain_etld1 AS domain, COUNT(*) AS cnt ORDER BY cnt DESC LIMIT 10",
    """ SELECT l.domain, count(*) AS cnt FROM e c JOIN e l ON l.s_uid = c.s_uid WHERE c.svc = 'CREATED_IN' AND c.t_id = 'R_7' AND c.s_label = 'PullRequest'
      AND l.svc = 'LINKS_TO' AND l.t >= '1994-01-01' AND l.t < '1999-01-01' GROUP BY 1 ORDER BY cnt DESC LIMIT 10""",
    params={"repo": "R_7"},
)
cypher(
    "cypher_pack_optional_slice",
    "MATCH (i:Issue)-[:OPENED_BY]->(a:Actor {entity_id: 'A_7'}) OPTIONAL MATCH (c:IssueComment)-[:COMMENTED_ON_ISSUE]->(i) OPTIONAL MATCH "
    "(c)-[m:MENTIONS]->(x:Actor) RETURN i.entity_id AS issue, collect(DISTINCT x.entity_id)[0..10] AS mentioned, COUNT(m) AS cnt ORDER BY cnt DESC",
    """ SELECT o.s_id AS issue, array_to_string(list_sort(list_distinct(coalesce(list(m.t_id) FILTER (WHERE m.t_id IS NOT NULL), [])))[1:10], '|') AS mentioned,
      count(m.t_id) AS cnt FROM e o LEFT JOIN (SELECT * FROM e WHERE svc = 'COMMENTED_ON_ISSUE') c ON c.t_uid = o.s_uid
      LEFT JOIN (SELECT * FROM e WHERE svc = 'MENTIONS') m ON m.s_uid = c.s_uid
      WHERE o.svc = 'OPENED_BY' AND o.s_label = 'Issue' AND o.t_id = 'A_7' GROUP BY 1""",
    arrays=("mentioned",),
)


@register(oracle.edges() + " SELECT DISTINCT t_label AS label, t_id AS entity_id FROM e WHERE t_label = 'Repo'")
def cypher_whole_node(spark, sf_dir):
    return run_query(graph(spark, sf_dir), "MATCH (r:Repo) RETURN r").select("r.*")


# checks, templates and repair of queries: rows only, since their input is query text


def _corpus() -> list[dict]:
    return [{"id": n, "query_type": n, "nl_query": n.replace("_", " "), "gold_cypher": t} for n, t in TEXTS.items()]


@register()
def validate_batch(spark, sf_dir):
    texts = [*TEXTS.items(), ("free_form", FREE_FORM), ("empty", ""), ("cut", "MATCH (a:Actor RETURN a")]
    found = evaluate.validate_batch(spark.createDataFrame(texts, "query_id string, text string"), "text", Schema(), True)
    return found.select("query_id", F.array_join("codes", ",").alias("codes"), "valid")


@register()
def template_render_status(spark, sf_dir):
    templates = {n: Template(n, t.replace("'PR_7#'", "$pr_base_prefix"), (n,), hop_limit=3) for n, t in TEXTS.items()}
    runs = evaluate.run_templates(spark, _corpus(), templates, {n: n for n in templates}, Schema())
    return runs.select("query_id", "mode", "status", "category")


@register()
def repair_corpus_status(spark, sf_dir):
    cases = [
        {"case_id": f"{n}:{k}", "failure_type": kind, "generated_cypher": bad, "gold_cypher": t, "validator_errors": [kind]}
        for n, t in TEXTS.items()
        for k, kind, bad in (
            ("relation", "WRONG_RELATION_TYPE", t.replace("[rr:REFERENCE]", "[rr:EVENT_ACTION]")),
            ("scope", "WRONG_ENTITY_SCOPE", t.replace("STARTS WITH 'PR_", "STARTS WITH 'I_")),
            ("property", "ILLEGAL_PROPERTY", t.replace("rel.url_domain_etld1", "x.url_domain_etld1")),
        )
        if bad != t
    ]
    runs = evaluate.run_repairs(spark, cases, Schema(), lambda c: Intent(failure_type=c["failure_type"]))
    return runs.select("case_id", "failure_type", F.array_join("edits", ",").alias("edits"), "valid", "exact")
