"""Records that arrive as a stream: the batch expressions for edges, which need no state, on a streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame

from loomgraph.operators.normalize import normalize
from loomgraph.vocabulary import DEFAULT_LABELS


def edge_stream(records: DataFrame, labels: dict[str, str] = DEFAULT_LABELS, policy: str = "skip") -> DataFrame:
    """Edges of a stream of records. The policy that numbers records needs an input order, which a stream hasn't."""
    if policy == "unknown":
        raise ValueError("unknown ids are places in the input; a stream has none")
    return normalize(records, labels, policy).edges


def write_edges(records: DataFrame, path: str, checkpoint: str, labels: dict[str, str] = DEFAULT_LABELS):
    """Append edges to a Parquet table, once each; returns the query. Nodes are a batch aggregate over that table."""
    out = edge_stream(records, labels).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return out.partitionBy("rel_type").trigger(availableNow=True).start()
