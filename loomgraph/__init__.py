"""loomgraph: property graphs of collaboration events as Spark DataFrames."""
