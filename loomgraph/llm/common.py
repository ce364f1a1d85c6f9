"""Helpers shared by the corpus operators: the shared scratch folder, lineage cuts, word expressions."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.session import delete_on_exit, shared_folder, ship_package, spread

#: A word is a run of anything but the six ASCII blanks; bytes.split() without arguments cuts at the same six.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"
#: Rows of one Arrow batch. Texts are whole, so batches are kept short enough for Python workers.
ARROW_ROWS = 256
#: Bytes of one Arrow batch, for very long texts; a longer text is a batch of its own.
ARROW_BYTES = 16 << 20


class Scratch:
    """Tables written to the shared folder to cut lineage; they outlive any executor and go when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_folder(spark)}/loomgraph/{name}-{uuid.uuid4().hex}"
        delete_on_exit(spark, self.base)
        self.count = 0

    def keep(self, df: DataFrame) -> DataFrame:
        """Write df as Parquet and read it back with its own schema."""
        self.count += 1
        path = f"{self.base}/{self.count}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(conf).delete(path, True)


def short_batches(spark: SparkSession) -> None:
    """Get the session ready for Arrow stages: the package on the workers, and batches of few rows, as texts can be long."""
    ship_package(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int = 8192) -> Iterator[None]:
    """Longer Arrow batches for the actions inside, whose rows are short."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def words(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def n_words(text: Column) -> Column:
    """The number of words, counted without building them."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
