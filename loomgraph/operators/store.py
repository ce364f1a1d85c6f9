"""Graphs kept as Parquet: normalised once, edges numbered, and pruned by relation when they are read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.normalize import ORDINAL, PropertyGraph
from loomgraph.session import delete_on_exit, file_system, shared_folder

RELATIONS = ("rel_type", "service_rel_type")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, which goes when the driver ends."""
    path = f"{shared_folder(spark)}/loomgraph/{name}-{uuid.uuid4().hex}"
    delete_on_exit(spark, path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df read back from a scratch folder."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    out = _read(df.sparkSession, path, df)
    out._scratch_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete the folder behind written() rows that nothing reads any more."""
    if hasattr(df, "_scratch_path"):
        p, fs = file_system(df.sparkSession, df._scratch_path)
        fs.delete(p, True)


def _read(spark: SparkSession, path: str, like: DataFrame | None) -> DataFrame:
    return (spark.read if like is None else spark.read.schema(like.schema)).parquet(path)


def _edges(graph: PropertyGraph) -> DataFrame:
    """Edges with edge_uid, their number in the table; parallel edges of equal properties stay apart by it."""
    edges = graph.edges
    number = F.col("edge_uid") if "edge_uid" in edges.columns else F.monotonically_increasing_id()
    return edges.select(number.alias("edge_uid"), *[c for c in edges.columns if c not in ("edge_uid", ORDINAL)])


def save(graph: PropertyGraph, path: str) -> None:
    """nodes by label and edges by native and service relation, so that labels and relations prune files; and the skipped count."""
    graph.nodes.write.mode("overwrite").option("compression", "zstd").partitionBy("label").parquet(f"{path}/nodes")
    _edges(graph).write.mode("overwrite").option("compression", "zstd").partitionBy(*RELATIONS).parquet(f"{path}/edges")
    if graph.records is not None:
        counts = graph.records.groupBy("skipped").agg(F.sum(graph.rows_of_record()).alias("n"))
        counts.coalesce(1).write.mode("overwrite").parquet(f"{path}/records")


def load(spark: SparkSession, path: str, like: PropertyGraph | None = None) -> PropertyGraph:
    """The graph that save() wrote. Blank relations come back as empty text; `like` saves looking the schemas up."""
    edges = _read(spark, f"{path}/edges", _edges(like) if like else None)
    edges = edges.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in RELATIONS})
    return PropertyGraph(_read(spark, f"{path}/nodes", like.nodes if like else None), edges, spark.read.parquet(f"{path}/records"))


def kept(graph: PropertyGraph) -> PropertyGraph:
    """The graph read back from a folder of its own."""
    spark = graph.edges.sparkSession
    path = scratch_path(spark, "graph")
    save(graph, path)
    return load(spark, path, graph)


def numbered_once(graph: PropertyGraph) -> PropertyGraph:
    """The graph with edge_uid at every edge for a single scan; another scan may number the edges otherwise."""
    return graph if "edge_uid" in graph.edges.columns else PropertyGraph(graph.nodes, _edges(graph), graph.records)


def identified(graph: PropertyGraph) -> PropertyGraph:
    """The graph with edge_uid at every edge; one without it is written once, since numbers must not change between scans."""
    if "edge_uid" in graph.edges.columns:
        return graph
    if graph.numbered is None:
        spark = graph.edges.sparkSession
        path, edges = scratch_path(spark, "edges"), _edges(graph)
        edges.write.mode("overwrite").parquet(path)
        graph.numbered = PropertyGraph(graph.nodes, _read(spark, path, edges), graph.records)
    return graph.numbered
