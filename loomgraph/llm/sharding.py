"""Resharding by minimum-cost flow: the fewest bytes move from old shards to new capacities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

SHARDS, OLD_SHARDS, BUCKETS = 16, 12, 1024


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> dict[tuple[int, int], int]:
    """Units from each supply i to each capacity j at the least total of cost(i, j), by successive shortest paths.

    Supplies must fit the capacities. The graph has one node a shard, so it is small whatever the bytes.
    """
    n, m = len(supply), len(capacity)
    start, end = n + m, n + m + 1
    to, room, price, out = [], [], [], [[] for _ in range(n + m + 2)]

    def edge(a: int, b: int, units: int, c: int) -> None:
        for x, y, u, v in ((a, b, units, c), (b, a, 0, -c)):
            out[x].append(len(to))
            to.append(y)
            room.append(u)
            price.append(v)

    for i, units in enumerate(supply):
        edge(start, i, units, 0)
    first = len(to)
    for i in range(n):
        for j in range(m):
            edge(i, n + j, min(supply[i], capacity[j]), cost(i, j))
    last = len(to)
    for j, units in enumerate(capacity):
        edge(n + j, end, units, 0)
    while True:
        best, via, queue = {start: 0}, {}, [start]
        while queue:
            a = queue.pop(0)
            for e in out[a]:
                b, c = to[e], best[a] + price[e]
                if room[e] and c < best.get(b, c + 1):
                    best[b], via[b] = c, e
                    queue.append(b)
        if end not in best:
            break
        path, at = [], end
        while at != start:
            path.append(via[at])
            at = to[via[at] ^ 1]
        units = min(room[e] for e in path)
        for e in path:
            room[e] -= units
            room[e ^ 1] += units
    pairs = {((e - first) // 2 // m, (e - first) // 2 % m): room[e ^ 1] for e in range(first, last, 2)}
    return {k: u for k, u in pairs.items() if u}


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def _laid_out(supply: list[int], flow: dict[tuple[int, int], int]) -> list[list[tuple[int, int]]]:
    """For each old shard the (end, new shard) of consecutive byte ranges; what stays comes first."""
    out = []
    for i in range(len(supply)):
        at, cuts = 0, []
        for j in sorted((j for a, j in flow if a == i), key=lambda j: (j != i, j)):
            at += flow[i, j]
            cuts.append((at, j))
        out.append(cuts or [(0, i)])
    return out


def sized(docs: DataFrame, old_shard: Column | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, hash, old_shard, document); document holds all columns. A null text has no bytes and size 1."""
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.xxhash64("doc_id", text)
    old = F.pmod(digest, F.lit(OLD_SHARDS)) if old_shard is None else old_shard
    return docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        digest.alias("hash"), old.cast("int").alias("old_shard"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"),
    )


def reshard(rows: DataFrame, shards: int = SHARDS, capacities: list[int] | None = None) -> DataFrame:
    """rows of sized() with shard and slot.

    Each old shard is a line of blocks, large documents first. The flow cuts the line into ranges for new shards; a
    document goes where its middle lies, so a shard differs from its capacity by half a document for each cut. Only the
    shard sizes come to the driver. Slots count up from 0 in each new shard without a gap.
    """
    scratch = Scratch(rows.sparkSession, "reshard")
    # documents wait in a written table for their places, so that texts aren't sorted
    whole = scratch.keep(rows.withColumn("__row", F.monotonically_increasing_id()))
    rows = whole.drop("document")
    magnitude = F.floor(F.log2("size")).cast("int")
    rows = scratch.keep(
        rows.withColumn("block", F.lit(-BUCKETS) * magnitude + F.pmod(F.xxhash64("hash"), F.lit(BUCKETS)).cast("int"))
    )
    blocks = scratch.keep(rows.groupBy("old_shard", "block").agg(F.sum("size").alias("bytes")))
    held = {r[0]: r[1] for r in blocks.groupBy("old_shard").agg(F.sum("bytes")).collect()}
    supply = [int(held.get(i, 0)) for i in range(max(held, default=0) + 1)]
    capacities = capacities or equal_capacities(sum(supply), shards)
    flow = min_cost_flow(supply, capacities, lambda i, j: int(i != j))
    cuts = [F.array(*[F.struct(F.lit(e).alias("end"), F.lit(j).alias("shard")) for e, j in line]) for line in _laid_out(supply, flow)]
    line = Window.partitionBy("old_shard").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    placed = blocks.select("old_shard", "block", (F.sum("bytes").over(line) - F.col("bytes")).alias("offset"))
    order = ("size", "hash", "doc_id", "text_crc32")
    inside = Window.partitionBy("old_shard", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(placed, ["old_shard", "block"])
    out = out.withColumn("middle", F.col("offset") + F.sum("size").over(inside) - F.col("size") / 2)
    ranges = F.array(*cuts)[F.col("old_shard")]
    reached = F.filter(ranges, lambda x: x["end"] > F.col("middle"))
    out = out.withColumn("shard", F.coalesce(F.get(reached, F.lit(0))["shard"], F.element_at(ranges, -1)["shard"]))
    group = ["shard", "old_shard", "block"]
    out = scratch.keep(out.withColumn("nth", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).drop("middle", "offset"))
    before = Window.partitionBy("shard").orderBy("old_shard", "block").rowsBetween(Window.unboundedPreceding, -1)
    counts = out.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select(*group, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    out = out.join(counts, group).select("__row", "shard", (F.col("ahead") + F.col("nth") - 1).alias("slot"))
    return whole.join(out, "__row").drop("__row")


def rewrite(placed: DataFrame, path: str) -> list[int]:
    """Write the shards that get or lose rows, one folder each, under path; the other shards' folders stay as they are.

    Files hold the documents with all their columns, and their slots, by which each file is sorted; texts are not shuffled
    again for an order across files. A shard that has lost all its rows loses its folder.
    """
    spark = placed.sparkSession
    moved = placed.where("shard <> old_shard").select(F.explode(F.array("shard", "old_shard")).alias("s")).distinct()
    affected = sorted(r[0] for r in moved.collect())
    part = placed.where(F.col("shard").isin(affected)).select("document", "slot", "shard")
    part = part.sortWithinPartitions("shard", "slot")
    part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    held = {r[0] for r in placed.select("shard").distinct().collect()}
    for shard in set(affected) - held:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/shard={shard}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return affected


def op9(docs: DataFrame) -> DataFrame:
    """Law `bytes`: 12 old shards by hash go to 16 of near equal bytes; affected shards are rewritten and read back.

    Null ids and texts are placed like others, repeated rows get slots of their own, an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    placed = reshard(sized(docs))
    path = f"{scratch.base}/files"
    affected = rewrite(placed, path)
    columns = ("doc_id", "size", "text_crc32", "shard", "slot", "old_shard")
    out = placed.where(~F.col("shard").isin(affected)).select(*columns)
    if affected:
        held = placed.select("document", F.col("slot").cast("long"), "shard").schema
        files = docs.sparkSession.read.schema(held).parquet(path)
        documents = files.select("document.doc_id", "document.text", F.struct("shard", "slot").alias("at"))
        read = sized(documents).select("*", "document.at.shard", "document.at.slot").select(*columns)
        out = out.unionByName(read)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "old_shard",
    )
