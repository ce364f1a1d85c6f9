"""Mixing sources to target weights: water-filled targets, permuted blocks, a hypergeometric splitting tree over shards."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, n_words

#: A document is repeated at most this many times.
MOST = 3
#: Words of one part of a shard, about 100 MB of text; a part is sorted by one task.
PART_WORDS = 16_000_000
#: Depth of the splitting tree: 2**DEPTH output shards.
DEPTH = 4


def _name(source):
    return F.coalesce(source, F.lit(""))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, key): key is a hash of id and text that orders documents; its first two digits are the block."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text))
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.substring(key, 1, 16).alias("key"))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) to target: all words shared by weights 1, 2, 3, repeating; none above MOST times its size.

    Sources in falling order of need: those whose cap lies under their share are fixed at it, and what is left is shared
    anew, which ends at one level for all the others. The table has one row for each source.
    """
    all_rows = Window.partitionBy()
    rank = F.row_number().over(Window.partitionBy().orderBy(F.col("source").asc_nulls_last()))
    t = sizes.withColumn("weight", (rank - 1) % 3 + 1).withColumn("cap", MOST * F.col("source_size"))
    order = all_rows.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    t = t.select(
        "*",
        F.row_number().over(order).alias("at"),
        (F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("left"),
        F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("weights"),
    )
    t = t.withColumn("level", F.col("left") / F.col("weights"))
    t = t.withColumn("free", F.col("cap") / F.col("weight") > F.col("level"))
    level = F.min(F.when(F.col("free"), F.struct("at", "level"))).over(all_rows)
    t = t.withColumn("first", level)
    capped = F.col("first").isNull() | (F.col("at") < F.col("first.at"))
    target = F.when(capped, F.col("cap").cast("double")).otherwise(F.col("first.level") * F.col("weight"))
    return t.select("source", "source_size", "weight", target.alias("target"))


def split_tree(slots: DataFrame, depth: int = DEPTH) -> DataFrame:
    """slots (source, block, copy) with a shard: each node draws half of its slots without replacement for its left child.

    A draw of half the slots splits the node's block quotas of all sources by a multivariate hypergeometric law, and the
    quotas of the leaves add up to the exact quotas of the root. There are at most 256 slots a source and copy.
    """
    out = slots.withColumn("shard", F.lit(0))
    for level in range(depth):
        label = F.concat_ws(":", F.lit(f"split{level}"), _name(F.col("source")), "block", F.col("copy").cast("string"))
        node = Window.partitionBy("shard")
        rank = F.row_number().over(node.orderBy(F.md5(label), F.col("source").isNull(), "source", "block", "copy"))
        right = 2 * rank > F.count(F.lit(1)).over(node) + 1
        out = out.withColumn("shard", 2 * F.col("shard") + right.cast("int"))
    return out


def decisions(rows: DataFrame, scratch: Scratch, depth: int = DEPTH) -> DataFrame:
    """One row for each source: its size, target, whole copies, blocks drawn once more, and the last key of a cut block."""
    blocks = scratch.keep(
        rows.groupBy("source", F.substring("key", 1, 2).alias("block")).agg(F.sum("size").alias("words"))
    )
    goal = targets(blocks.groupBy("source").agg(F.sum("words").alias("source_size")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    goal = scratch.keep(goal.withColumn("whole", whole))
    g = goal.withColumnRenamed("source", "of")
    order = F.struct(F.md5(F.concat_ws(":", F.lit("block"), _name(F.col("source")), "block")).alias("at"), "block", "words")
    drawn = blocks.join(g, F.col("source").eqNullSafe(F.col("of"))).groupBy(
        "source", "source_size", "target", "whole"
    ).agg(F.sort_array(F.collect_list(order)).alias("deck"))
    # blocks in permuted order, each drawn whole if it still fits; at most 256 of a source
    start = F.struct((F.col("target") - F.col("whole") * F.col("source_size")).alias("left"), F.array().cast("array<string>").alias("got"))
    fits = lambda s, x: x["words"] <= s["left"]
    dealt = F.aggregate(
        "deck",
        start,
        lambda s, x: F.struct(
            F.when(fits(s, x), s["left"] - x["words"]).otherwise(s["left"]).alias("left"),
            F.when(fits(s, x), F.concat(s["got"], F.array(x["block"]))).otherwise(s["got"]).alias("got"),
        ),
    )
    drawn = drawn.withColumn("dealt", dealt)
    spare = F.filter("deck", lambda x: ~F.array_contains(F.col("dealt.got"), x["block"]))
    least = F.array_min(F.transform(spare, lambda x: F.struct(x["words"], x["at"], x["block"])))
    drawn = drawn.withColumn("cut", least["block"]).select("*", F.explode("deck").alias("b"))
    drawn = drawn.select(
        "source", "source_size", "target", "whole", "b.block", "b.words", F.col("dealt.left").alias("left"),
        F.when(F.array_contains("dealt.got", F.col("b.block")), 1)
        .when((F.col("b.block") == F.col("cut")) & (F.col("dealt.left") > 0), 2).otherwise(0).alias("flag"),
    )
    drawn = scratch.keep(drawn)

    # the block that the remainder ends in is cut: first between runs of keys with five equal digits, then between keys
    cut = drawn.where("flag = 2").select(
        F.col("source").alias("of"), F.col("block").alias("in"), F.col("left")
    )
    inside = rows.join(
        cut, F.col("source").eqNullSafe(F.col("of")) & (F.substring("key", 1, 2) == F.col("in"))
    ).groupBy("source", "left", "key").agg(F.sum("size").alias("words"))
    inside = scratch.keep(inside)
    by_run = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, 0)
    runs = inside.groupBy("source", "left", F.substring("key", 1, 5).alias("run")).agg(F.sum("words").alias("words"))
    runs = runs.withColumn("upto", F.sum("words").over(by_run))
    last = runs.where("upto > left and upto - words <= left").select(
        F.col("source").alias("of"), "run", (F.col("left") - F.col("upto") + F.col("words")).alias("room")
    )
    by_key = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    ends = inside.join(last, F.col("source").eqNullSafe(F.col("of")) & (F.substring("key", 1, 5) == F.col("run")))
    # a key is taken while it brings the words nearer to the target
    nearer = F.col("upto") - F.col("words") / 2 < F.col("room")
    ends = ends.withColumn("upto", F.sum("words").over(by_key)).groupBy("source", "run").agg(
        F.max(F.when(nearer, F.col("key"))).alias("key")
    )
    ends = ends.select(F.col("source").alias("of"), F.coalesce("key", "run").alias("last_key"))

    copies = F.col("whole") + (F.col("flag") > 0).cast("int")
    slots = drawn.select("source", "block", F.explode(F.sequence(F.lit(1), copies)).alias("copy"), copies.alias("n")).where(
        "n > 0"
    )
    shards = split_tree(slots.drop("n"), depth).groupBy("source", "block").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("copy", "shard"))), lambda x: x["shard"]).alias("shards")
    )
    shards = shards.select(F.col("source").alias("of"), F.col("block").alias("in"), "shards")
    joined = drawn.join(shards, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("in")), "left")
    packed = joined.groupBy("source", "source_size", "target", "whole").agg(
        F.map_from_entries(F.collect_list(F.struct("block", F.struct("flag", "shards")))).alias("blocks")
    )
    return scratch.keep(packed.join(ends, F.col("source").eqNullSafe(F.col("of")), "left").drop("of"))


def planned(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows with source_size, target, copies and shards (one for each copy)."""
    d = found.withColumnRenamed("source", "of")
    block = F.element_at("blocks", F.substring("key", 1, 2))
    out = rows.join(d, F.col("source").eqNullSafe(F.col("of"))).withColumn("block", block)
    more = (F.col("block.flag") == 1) | ((F.col("block.flag") == 2) & F.coalesce(F.col("key") <= F.col("last_key"), F.lit(False)))
    out = out.withColumn("copies", F.col("whole") + more.cast("int"))
    shards = F.coalesce(F.slice("block.shards", F.lit(1), F.col("copies")), F.array().cast("array<int>"))
    return out.withColumn("shards", shards).drop("of", "whole", "blocks", "last_key", "block")


def op4(docs: DataFrame) -> DataFrame:
    """Words that the mix takes of each document; shards lists the output shard of each copy.

    Null and blank texts have size 0; a null source is a source of its own, last in order. Repeated rows with equal id and
    text share a key, so a cut takes them together. Without words all targets are 0; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = scratch.keep(sized(docs))
    return planned(rows, decisions(rows, scratch)).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"),
        F.concat_ws(",", F.transform("shards", lambda s: s.cast("string"))).alias("shards"),
    )


def parts_for(words: float, shards: int) -> int:
    """Parts of a shard, so that one holds about PART_WORDS words at any size of the table."""
    return max(1, math.ceil(words / shards / PART_WORDS))


def mix(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """The mixed rows, with the columns of docs: a row for each copy, dealt to shards and shuffled within each part.

    The number of parts of a shard follows from the words that the mix takes, unless given.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    found = decisions(scratch.keep(sized(docs)), scratch)
    parts = parts or parts_for(found.agg(F.sum("target")).first()[0] or 0, 2**DEPTH)
    text = F.coalesce(F.col("text"), F.lit(""))
    id_text = F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text)
    hidden = docs.select(F.struct(*docs.columns).alias("row"), F.col("source"), F.substring(F.md5(id_text), 1, 16).alias("key"))
    out = planned(hidden, found).select("row", "key", F.posexplode("shards").alias("copy", "shard"))
    out = out.withColumn("part", F.pmod(F.xxhash64("key", "copy"), F.lit(parts)))
    out = out.repartition("shard", "part").sortWithinPartitions("shard", "part", F.xxhash64("copy", "key"))
    return out.select("row.*")
