"""What a session needs: the package on the workers, and the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a table up to which its rows are dealt to all cores; a larger one has splits enough of its own.
SPREAD_BYTES = 64 << 20


def ship_package(spark: SparkSession | None = None) -> None:
    """Send this package to the executors, once for each context, so that functions of its modules can be read there."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None or getattr(spark.sparkContext, "_loomgraph_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="loomgraph-code-")) / "loomgraph.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))
    spark.sparkContext._loomgraph_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, as in tests, a local master gets a temporary one."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = context._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="loomgraph-")
        context.setCheckpointDir(root)
    return root.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """Hadoop's path and file system of a path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """Make a folder that goes when the driver ends."""
    p, fs = file_system(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)


def tune(spark: SparkSession) -> None:
    """Settings that the graph engine's plans want: the JVM compiles no method above 8000 bytes, so generated ones stay below."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def spread(df: DataFrame) -> DataFrame:
    """The rows of a small table dealt to all cores, as one small file is one split; one of more bytes or files stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    small = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= SPREAD_BYTES
    return df.repartition(cores) if small and len(df.inputFiles()) < cores else df
