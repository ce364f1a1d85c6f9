"""The star-schema tables as raw collaboration records, and as a graph."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.normalize import PropertyGraph, normalize, with_ordinal
from loomgraph.operators.store import drop, kept, written
from loomgraph.session import spread, tune
from loomgraph.vocabulary import NATIVE_LABELS

COLUMNS = (
    "src_entity_id", "src_entity_type", "tar_entity_id", "tar_entity_type", "relation_type", "relation_label_repr",
    "event_time", "tar_entity_match_pattern_type", "tar_entity_match_text",
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) and not p.isidentifier() else F.col(p).cast("string") for p in parts])


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as issues and pull requests, line items as their comments, customers and suppliers as actors, pages as links.

    Each table is read once; a row is turned into all its records at once.
    """
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    orders = spread(read(spark, sf_dir, "orders")).join(
        read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nk")), "o_custkey"
    )
    issue = F.col("o_orderstatus") == "O"
    orders = orders.select(
        "o_orderkey", "o_custkey", "nk", F.when(issue, "Issue").otherwise("PullRequest").alias("kind"),
        F.concat(F.when(issue, "I_").otherwise("PR_"), _text("nk", "#", "o_orderkey")).alias("oid"),
        stamp("o_orderdate").alias("at"),
    )
    pages = read(spark, sf_dir, "pages").select(F.col("page_id").alias("pid"), "url")
    items = spread(read(spark, sf_dir, "lineitem")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", stamp("l_shipdate").alias("at")
    ).crossJoin(pages.agg(F.count(F.lit(1)).alias("n_pages")))  # one row
    items = items.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "nk", "kind", "oid"), "l_orderkey")
    items = items.withColumn("pid", F.col("l_partkey") % F.col("n_pages")).join(pages, "pid", "left")
    comment = F.concat(F.lit("IC_"), _text("nk", "#", "l_orderkey", "#", "l_linenumber"))
    supplier = F.concat(F.lit("A_s"), F.col("l_suppkey").cast("string"))
    none = F.lit("")

    def record(source, s_type, target, t_type, relation, label, pattern=none, text=none):
        as_col = lambda x: F.lit(x) if isinstance(x, str) else x
        values = (source, s_type, target, t_type, relation, label, F.col("at"), pattern, text)
        return F.struct(*[as_col(v).alias(c) for v, c in zip(values, COLUMNS, strict=True)])

    oid, kind, url = F.col("oid"), F.col("kind"), F.col("url")
    commit = F.concat(F.lit("C_"), _text("nk"), F.lit("@"), F.md5(F.col("l_partkey").cast("string")))
    of_orders = F.array(
        record(oid, kind, F.concat(F.lit("A_"), _text("o_custkey")), "Actor", "EventAction", F.concat(kind, F.lit("_OpenedBy_Actor"))),
        record(oid, kind, F.concat(F.lit("R_"), _text("nk")), "Repo", "EventAction", F.concat(kind, F.lit("_CreatedIn_Repo"))),
    )
    of_items = F.array(
        record(comment, "IssueComment", oid, kind, "EventAction", F.concat(F.lit("IssueComment_CommentedOnIssue_"), kind)),
        record(comment, "IssueComment", supplier, "Actor", "EventAction", "IssueComment_OpenedBy_Actor"),
        F.when(url.isNotNull(), record(oid, kind, url, "ExternalResource", "Reference", none, "GitHub_Service_External_Links", url)),
        record(comment, "IssueComment", supplier, "Actor", "Reference", none, "Actor", none),
        F.when(F.col("l_quantity") < 10, record(oid, kind, commit, "Commit", "Reference", none, "SHA", none)),
        F.when(F.col("l_returnflag") == "R", record(comment, "IssueComment", none, none, "Reference", none, "GitHub_Other_Service", none)),
    )
    each = lambda df, records: df.select(F.explode(records).alias("r")).where("r IS NOT NULL").select("r.*")
    return each(orders, of_orders).unionByName(each(items, of_items))


@contextmanager
def passing_graph(spark: SparkSession, sf_dir: str) -> Iterator[PropertyGraph]:
    """The graph for one writing of it: the stored one if the session has it, else made from records that go afterwards.

    A sink reads nodes and edges once each, so storing them first would only add a writing and a reading of the whole.
    """
    held = spark.__dict__.get("_loomgraph_graphs", {}).get((sf_dir, "skip"))
    if held is not None:
        yield held
        return
    rows = written(raw_records(spark, sf_dir), "records")
    try:
        yield normalize(rows, NATIVE_LABELS, prefer_aggregated=False)
    finally:
        drop(rows)


def graph(spark: SparkSession, sf_dir: str, policy: str = "skip") -> PropertyGraph:
    """The normalised graph, made once for a session and read from its folder from then on.

    With a policy that numbers records, they are put in a total order first.
    """
    held = spark.__dict__.setdefault("_loomgraph_graphs", {})
    if (sf_dir, policy) not in held:
        rows = raw_records(spark, sf_dir)
        # written once, since nodes, edges and counts each read them; an order is written by itself
        rows = written(rows, "records") if policy == "skip" else with_ordinal(rows, *COLUMNS)
        held[sf_dir, policy] = kept(normalize(rows, NATIVE_LABELS, policy, prefer_aggregated=False))
        drop(rows)
    return held[sf_dir, policy]
