"""SimHash fingerprints, linked exactly within a Hamming radius by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import jaccard
from .common import Scratch, short_batches
from .components import components

BITS = 64
#: Fingerprints of one bucket that one task compares at once; larger buckets are cut into pairs of chunks.
CHUNK = 2048
_MULT = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th hash family, derived from the first by a 64-bit finaliser."""
    if not k:
        return h
    h = h + np.uint64((k * 0x9E3779B97F4A7C15) % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(_MULT[0])
    h = (h ^ (h >> np.uint64(27))) * np.uint64(_MULT[1])
    return h ^ (h >> np.uint64(31))


def _majority(h: np.ndarray) -> int:
    """A signed 64-bit word of the bits set in over half of the hashes."""
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
    # eight one-byte counters are added at once; 255 rows cannot overflow one
    sums = np.add.reduceat(bits, np.arange(0, len(h), 255), axis=0).view(np.uint8).reshape(-1, BITS)
    return int(np.packbits(2 * sums.sum(axis=0, dtype=np.int64) > len(h), bitorder="little").view(np.int64)[0])


def fingerprint(text: bytes | None, shingle: int = 4, families: int = 1) -> list[int]:
    """Signed 64-bit SimHashes of a UTF-8 text; no words give zero, fewer words than a shingle are one shingle."""
    words = (text or b"").lower().split()
    if not words:
        return [0] * families
    joined, n = b" ".join(words), len(words)
    if n <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, n)
        ends = np.cumsum(lengths + 1) - 1
        starts, stops = (ends - lengths)[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)]
    h = np.array(hashes, np.uint64)
    return [_majority(_mixed(h, k)) for k in range(families)]


def masks(radius: int, width: int = BITS) -> list[int]:
    """Covering masks of the lowest `width` bits: bit i holds a vector of radius+1 bits, mask v the bits whose vector has odd overlap with v.

    Up to radius differing bits have vectors that do not span the space, so some v is orthogonal to all of them and its
    mask leaves out every differing bit: the pair collides in that table.
    """
    full = 2 ** (radius + 1) - 1
    return [
        sum(1 << i for i in range(width) if ((i % full + 1) & v).bit_count() % 2) for v in range(1, full + 1)
    ]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def fingerprints(docs: DataFrame, shingle: int, families: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fps): one row for each row of docs."""
    short_batches(docs.sparkSession)
    source = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).cast("binary").alias("t")
    )
    schema = T.StructType(
        [
            T.StructField("doc_id", source.schema["doc_id"].dataType),
            T.StructField("text_hash", T.LongType()),
            T.StructField("fps", T.ArrayType(T.LongType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py(), shingle, families) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(fps, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "fps"]
            )

    return source.mapInArrow(run, schema)


def _forest(node: np.ndarray, fp: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of one block: each reached node is compared with the nodes not reached yet."""
    rest, out = np.arange(len(fp)), []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(fp[rest] ^ fp[at]).sum(axis=1) <= most
            found, rest = rest[near], rest[~near]
            out += [(int(node[at]), int(node[x])) for x in found]
            queue += found.tolist()
    return out


def _block_links(most: int):
    """Rows (block, node, fps) sorted by block to links of nodes whose fingerprints differ in `most` bits or fewer in all."""

    def linked(node: np.ndarray, fp: np.ndarray) -> list[tuple[int, int]]:
        if len(fp) == 2:
            return [(int(node[0]), int(node[1]))] if int(np.bitwise_count(fp[0] ^ fp[1]).sum()) <= most else []
        return _forest(node, fp, most)

    def pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            block, node = b.column(0).to_numpy(), b.column(1).to_numpy()
            fp = b.column(2).flatten().to_numpy().view(np.uint64).reshape(len(block), -1)
            if held is not None:
                block, node, fp = (np.concatenate(x) for x in zip(held, (block, node, fp), strict=True))
            cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist()]
            out = [x for a, z in zip(cuts, cuts[1:], strict=False) for x in linked(node[a:z], fp[a:z])]
            held = (block[cuts[-1] :], node[cuts[-1] :], fp[cuts[-1] :])
            yield pairs(out)
        if held is not None:
            yield pairs(linked(held[1], held[2]))

    return run


def links(nodes: DataFrame, radius: int, width: int = BITS, most: int | None = None) -> DataFrame:
    """(node, fps) with distinct nodes to links (a, b) that connect all nodes within the radius in some family.

    Buckets of one node are dropped by a partial aggregate. A bucket of any size is cut into chunks of about CHUNK nodes
    and each pair of chunks is one block, so no task holds a bucket and no pair is lost; a block yields a spanning forest.
    With `most`, nodes that meet on the lowest `width` bits of a family are linked if all their fingerprints together
    differ in at most that many bits.
    """
    parts = [_signed(m) for m in masks(radius, width)]
    at = nodes.select("node", F.posexplode("fps").alias("family", "fp"))
    keys = at.select(
        "node",
        "fp",
        F.explode(
            F.array(*[F.xxhash64(F.col("family"), F.lit(v), F.col("fp").bitwiseAND(F.lit(m))) for v, m in enumerate(parts)])
        ).alias("key"),
    )
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Spark takes the exploded keys to be as small as the table of nodes, and would broadcast them
    shared = shared.hint("merge")
    if most is None:
        members, most = keys.select("key", "node", F.array("fp").alias("fps")).join(shared, "key"), radius
    else:
        members = keys.select("key", "node").join(shared, "key").join(nodes, "node")
    members = members.withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int"))
    members = members.withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(7)), F.col("chunks")).cast("int"))
    blocks = members.withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)"))).select(
        F.xxhash64("key", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("block"), "node", "fps"
    )
    return blocks.repartition("block").sortWithinPartitions("block").mapInArrow(_block_links(most), "a long, b long")


def near_duplicates(
    docs: DataFrame, shingle: int = 5, radius: int = 4, families: int = 1, similarity: float | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, text_hash, fps, root, component_id): component_id is the smallest id reachable over links.

    Null, blank and empty texts have fingerprint zero and link like any other. Repeated rows and equal texts share a
    node. A null id never becomes a component_id unless its whole component has no other. An empty table gives no rows.

    Without a similarity, links are all pairs within the radius in some family. With one, links are all pairs of texts whose
    shingles have that Jaccard similarity or more; those within the radius in the first family are tried first, and
    jaccard.groups finds the rest. component_id and root are those of the texts.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    rows = fingerprints(docs, shingle, families, id_col, text_col)
    if similarity is not None:
        rows = scratch.keep(rows)
        texts = scratch.keep(jaccard.groups(docs, shingle, similarity, text_col, radius))
        ids = rows.groupBy("text_hash").agg(F.min("doc_id").alias("least"))
        smallest = texts.join(ids, "text_hash").groupBy("root").agg(F.min("least").alias("component_id"))
        named = scratch.keep(texts.join(smallest, "root"))
        return rows.join(named, "text_hash").select("doc_id", "text_hash", "fps", "root", "component_id")
    node = F.col("fps")[0] if families == 1 else F.xxhash64("fps")
    rows = scratch.keep(rows.withColumn("node", node))
    classes = scratch.keep(
        rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.min(F.col("fps")).alias("fps"))
    )
    linked = components(links(classes.select("node", "fps"), radius), scratch)
    rooted = classes.join(linked, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    smallest = scratch.keep(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    named = rooted.join(smallest, "root").select("node", "root", "component_id")
    # rows of many copies are a small file, but not small once broadcast
    return rows.join(named.hint("merge"), "node").select("doc_id", "text_hash", "fps", "root", "component_id")


def op1(docs: DataFrame) -> DataFrame:
    """Four-word shingles, four bits: doc_id, fingerprint, component_id for every document."""
    out = near_duplicates(docs, shingle=4, radius=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex(F.col("fps")[0]), 16, "0")).alias("fingerprint"), "component_id")


def dedup(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 4) -> DataFrame:
    """Keep one row of each near-duplicate group: the one with the smallest id (nulls last), then the smallest text hash.

    A group is connected by pairs of texts whose shingles have at least that Jaccard similarity; all such pairs count, and
    no other. SimHash proposes the pairs within the radius, the exact similarity decides, and jaccard.groups proposes the
    pairs beyond the radius. Columns are those of docs. Rows repeated in full leave one.
    """
    scratch = Scratch(docs.sparkSession, "dedup")
    texts = scratch.keep(jaccard.groups(docs, shingle, similarity, radius=radius))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("text_hash"))
    # the first row of each text comes from a partial aggregate, so a text with many copies is one row of the join
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash")).groupBy("text_hash").agg(F.min(order).alias("first"))
    stay = rows.join(texts, "text_hash").groupBy("root").agg(F.min("first").alias("first"))
    stay = stay.select(F.col("first.doc_id").alias("__id"), F.col("first.text_hash").alias("__hash"))
    keyed = docs.withColumn("__key", F.xxhash64("text"))
    kept = keyed.join(stay, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__hash")), "left_semi")
    return kept.dropDuplicates(["doc_id", "__key"]).select(*docs.columns)
