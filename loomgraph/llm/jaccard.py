"""Groups of texts whose word shingles have a Jaccard similarity of at least a bound, with no pair lost and none beyond."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import Scratch, arrow_batches, short_batches
from .components import components
from .substrings import Rolling, _mix

#: Bytes of a sketch: counts of the shingles' hashes in as many cells.
CELLS = 256
#: Members of a bucket that are compared with one of them first, and members of a block in which all pairs are compared.
FAN, CHUNK = 512, 2048
#: Least keys of a text that its rows carry in blocks, so that a pair with several keys in common is told apart once.
LEAST_KEYS = 16
#: Parts of a set for each shingle of the smallest set that is cut alike.
PARTS = 0.625
#: Rows of the ids of wanted texts up to which they are broadcast; beyond, the texts are shuffled.
BROADCAST_ROWS = 500_000
_SLACK = 1e-9
_U = np.uint64


def shingles(text: bytes | None, n: int) -> np.ndarray:
    """The sorted distinct hashes of a text's n-word shingles; fewer words are one shingle, no words none.

    A shingle's hash comes from sums over the hashes of its words, so each word is hashed once.
    """
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, _U)
    k = min(n, len(words))
    at = np.arange(len(words) - k + 1)
    return np.unique(Rolling(words).runs(at, at + k))


def similar(x: np.ndarray, y: np.ndarray, bound: float) -> bool:
    """Whether two sets have a Jaccard similarity of at least the bound."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= bound * (len(x) + len(y) - both) - _SLACK


def prefix_length(size: int, bound: float) -> int:
    """Of two sets that reach the bound, the first so many members in any one order have a member in common."""
    return size - math.ceil(bound * size - _SLACK) + 1 if size else 0


def most_differences(size: int, other: int, bound: float) -> int:
    """Members that lie in one of two sets only, at most, if the sets reach the bound."""
    return math.floor((size + other) * (1 - bound) / (1 + bound) + _SLACK)


def _parts(h: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes cut by value into `count` parts: of each part that isn't empty, the number of its members and a key of them."""
    part = ((h >> _U(32)) * _U(count)) >> _U(32)
    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    sizes = np.diff(np.append(starts, len(h)))
    return sizes, _mix(_mix(np.add.reduceat(_mix(h), starts)) + part[starts] * _U(0x9E3779B97F4A7C15) + _U(count))


def keys(h: np.ndarray, bound: float) -> np.ndarray:
    """Keys of a set of sorted hashes; any two sets that reach the bound have a key in common.

    Sets are cut alike into parts by the value of their members. Members in which two sets differ spoil one part each, and
    if fewer are spoilt than there are parts, the sets have a part in common. So they have one among the first D + 1 parts
    of each in any common order, where D is the most differences that the bound leaves; parts of many members come first,
    so a key stands for several shingles and a frequent shingle alone makes hardly any. The number of parts goes by
    octaves of the size of the smaller set; a set that may be the larger one of a pair of the octave below is cut for both.
    A set of no more parts than D has the keys of its first single members as well, as its partner then has.
    """
    n = len(h)
    if not n:
        return np.zeros(1, _U)
    octave, out = n.bit_length() - 1, []
    cuts = [(octave, math.floor(n / bound + _SLACK))]
    if octave and math.floor(((1 << octave) - 1) / bound + _SLACK) >= n:
        cuts.append((octave - 1, (1 << octave) - 1))
    for k, partner in cuts:
        most = most_differences(n, partner, bound)
        sizes, found = _parts(h, math.ceil(PARTS * (1 << k)))
        out.append(found[np.lexsort((found, -sizes))][: most + 1])
        if len(found) <= most:
            out.append(_mix(h[: prefix_length(n, bound)] + _U(1)))
    return np.unique(np.concatenate(out))


def sketch(hashes: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """Counts by cell, cut at 255: two sets differ in at least as many members as their sketches do in sum."""
    counts = np.bincount((hashes >> _U(65 - cells.bit_length())).astype(np.int64), minlength=cells)
    return np.minimum(counts, 255).astype(np.uint8)


def fine_cells(size: int) -> int:
    """Cells of the sketch that is read for single pairs: a power of two, about one for each shingle."""
    return max(CELLS, 1 << (size - 1).bit_length()) if size else CELLS


def _fine_near(x: bytes, y: bytes, sizes: int, bound: float) -> bool:
    """Whether two fine sketches leave the bound open; the one of more cells is folded to the other's number."""
    a, b = (np.frombuffer(c, np.uint8).astype(np.int64) for c in (x, y))
    n = min(len(a), len(b))
    a, b = (np.minimum(c.reshape(n, -1).sum(axis=1), 255) for c in (a, b))
    return int(np.abs(a - b).sum()) <= sizes * (1 - bound) / (1 + bound) + _SLACK


def _far(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, bound: float) -> np.ndarray:
    """Whether sketches rule the bound out: at it, sets differ in (1-bound)/(1+bound) of the sum of their sizes at most."""
    return np.abs(x.astype(np.int16) - y.astype(np.int16)).sum(axis=-1) > sizes * (1 - bound) / (1 + bound) + _SLACK


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, CELLS)


def _pairs(a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _nodes(texts: DataFrame, shingle: int, bound: float) -> DataFrame:
    """(text_hash, fp, size, sketch, fine, keys): one row for each row of texts; fp is the SimHash fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py(), shingle) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array([simhash.fingerprint(t.as_py(), shingle)[0] for t in b.column(1)], pa.int64()),
                    pa.array([len(h) for h in sets], pa.int64()), pa.array([sketch(h).tobytes() for h in sets], pa.binary()),
                    pa.array([sketch(h, fine_cells(len(h))).tobytes() for h in sets], pa.binary()),
                    pa.array([keys(h, bound).view(np.int64) for h in sets], pa.list_(pa.int64())),
                ],
                names=["text_hash", "fp", "size", "sketch", "fine", "keys"],
            )

    return texts.mapInArrow(run, "text_hash long, fp long, size long, sketch binary, fine binary, keys array<long>")


def met(nodes: DataFrame, scratch: Scratch, radius: int) -> DataFrame:
    """Pairs (a, b), a < b, of (node, fp) that connect all nodes whose SimHash fingerprints differ in `radius` bits or fewer.

    Fingerprints are linked through covering masks; of the nodes with one fingerprint, the least stands for all.
    """
    classes = scratch.keep(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    equal = nodes.join(classes, "fp").select(F.col("first").alias("a"), F.col("node").alias("b"))
    found = simhash.links(classes.select(F.col("fp").alias("node"), F.array("fp").alias("fps")), radius).distinct()
    ends = [classes.select(F.col("fp").alias(c), F.col("first").alias(f"first_{c}")) for c in ("a", "b")]
    found = found.join(ends[0], "a").join(ends[1], "b")
    found = found.select(F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b"))
    return equal.where("a <> b").unionByName(found)


def _near(pairs: DataFrame, nodes: DataFrame, bound: float, column: str) -> DataFrame:
    """Pairs (a, b) whose sketches in that column don't rule the bound out."""
    small = nodes.select("node", "size", column)
    one, two = small.toDF("a", "size_a", "x"), small.toDF("b", "size_b", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            if r.num_rows:
                a, b, sizes = (r.column(i).to_numpy() for i in range(3))
                if column == "sketch":
                    stay = ~_far(_sketches(r.column(3)), _sketches(r.column(4)), sizes, bound)
                else:
                    both = zip(r.column(3).to_pylist(), r.column(4).to_pylist(), sizes.tolist(), strict=True)
                    stay = np.array([_fine_near(x, y, n, bound) for x, y, n in both])
                yield _pairs(a[stay], b[stay])

    joined = pairs.join(one, "a").join(two, "b")
    joined = joined.where(F.least("size_a", "size_b") >= F.lit(bound) * F.greatest("size_a", "size_b") - _SLACK)
    return joined.select("a", "b", F.col("size_a") + F.col("size_b"), "x", "y").mapInArrow(run, "a long, b long")


def _verified(
    pairs: DataFrame, nodes: DataFrame, texts: DataFrame, scratch: Scratch, shingle: int, bound: float
) -> DataFrame:
    """Pairs (a, b) whose texts reach the bound; only texts of pairs that fine sketches leave open are moved."""
    pairs = scratch.keep(_near(pairs, nodes, bound, "fine"))
    ids = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = scratch.keep(nodes.select("node", "text_hash").join(ids, "node"))
    hashes = wanted.select("text_hash")
    if wanted.count() <= BROADCAST_ROWS:
        hashes = F.broadcast(hashes)
    # copies are dropped by a partial aggregate
    texts = texts.join(hashes, "text_hash", "left_semi").groupBy("text_hash").agg(F.first("t").alias("t"))
    texts = scratch.keep(wanted.join(texts, "text_hash").select("node", "t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}

        def of(node: int, text: pa.Scalar) -> np.ndarray:
            if node not in sets:
                if len(sets) >= 256:
                    sets.clear()
                sets[node] = shingles(text.as_py(), shingle)
            return sets[node]

        for r in batches:
            ids = zip(r.column(0).to_pylist(), r.column(1).to_pylist(), strict=True)
            stay = [(a, b) for i, (a, b) in enumerate(ids) if similar(of(a, r.column(2)[i]), of(b, r.column(3)[i]), bound)]
            yield _pairs(*(zip(*stay, strict=True) if stay else ((), ())))

    joined = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _least(column: pa.Array) -> np.ndarray:
    """Lists of sorted keys as one row each, filled up with the greatest long."""
    out = np.full((len(column), LEAST_KEYS), np.iinfo(np.int64).max)
    n = np.diff(column.offsets.to_numpy())
    out[np.arange(LEAST_KEYS) < n[:, None]] = column.flatten().to_numpy()
    return out


def _met_before(token: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the least keys of two texts have one in common that is below the bucket's own."""
    return ((x[:, :, None] == y[:, None, :]) & (x < token[:, None])[:, :, None]).any(axis=(1, 2))


def _block_pairs(bound: float):
    """Rows (block, token, chunk, node, root, size, sketch, least) sorted by block to pairs of other roots that size and sketch don't rule out.

    A pair is left to the bucket of the least key that both texts carry, if there is one below this bucket's. Rows of one
    chunk (-1: of any) are compared in that chunk's own block alone.
    """

    def compared(block, token, chunk, node, root, size, cells, least) -> pa.RecordBatch:
        a, b, at, apart = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.arange(len(block)), 1
        while True:  # rows are compared with the next one of their block, then with the one after it, and so on
            at = at[at + apart < len(block)]
            at = at[block[at] == block[at + apart]]
            if not len(at):
                break
            i, j = at, at + apart
            stay = (root[i] != root[j]) & (np.minimum(size[i], size[j]) >= bound * np.maximum(size[i], size[j]) - _SLACK)
            stay &= (chunk[i] < 0) | (chunk[i] != chunk[j])
            i, j = i[stay], j[stay]
            stay = ~_far(cells[i], cells[j], size[i] + size[j], bound)
            i, j = i[stay], j[stay]
            stay = ~_met_before(token[i], least[i], least[j])
            i, j = i[stay], j[stay]
            a.append(np.minimum(node[i], node[j]))
            b.append(np.maximum(node[i], node[j]))
            apart += 1
        return _pairs(np.concatenate(a), np.concatenate(b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for r in batches:
            if not r.num_rows:
                continue
            now = [r.column(i).to_numpy() for i in range(6)] + [_sketches(r.column(6)), _least(r.column(7))]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            # the last block may go on in the next batch
            cut = len(now[0]) - int(np.argmax(now[0][::-1] != now[0][-1])) if now[0][0] != now[0][-1] else 0
            if cut:
                yield compared(*(c[:cut] for c in now))
            held = [c[cut:] for c in now]
        if held is not None:
            yield compared(*held)

    return run


def groups(docs: DataFrame, shingle: int = 5, bound: float = 0.8, text_col: str = "text", radius: int = 4) -> DataFrame:
    """(text_hash, root): one row for each distinct text; equal roots are texts connected by pairs that reach the bound.

    The first candidates are the pairs that SimHash links within the radius. It can't reach every pair at the bound, so
    further candidates have a key in common, which every pair that reaches the bound has, at any size of the table. Each bucket's
    members are compared with one of them first; then all pairs of a bucket that are not connected yet, in blocks of two
    chunks, so no task holds a bucket. Buckets of the same members count once, and a pair that meets in several buckets
    leaves one of them, as a rule. Sketches drop pairs that cannot reach the bound, and the texts of the others decide.
    Texts without words are equal to each other and to no other.
    """
    spark = docs.sparkSession
    short_batches(spark)
    scratch = Scratch(spark, "jaccard")
    text = F.col(text_col)
    texts = docs.select(F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("t"))
    once = _nodes(texts, shingle, bound).groupBy("text_hash").agg(F.first(F.struct("fp", "size", "sketch", "fine", "keys")).alias("x"))
    nodes = scratch.keep(once.select(F.monotonically_increasing_id().alias("node"), "text_hash", "x.*"))
    at = nodes.select("node", F.explode("keys").alias("token"))
    held = [F.count(F.lit(1)).alias("n"), F.sum("node").alias("sum"), F.bit_xor(F.xxhash64("node")).alias("xor")]
    shared = at.groupBy("token").agg(*held).where("n > 1")
    # of keys with the same members one is enough, of a large group's one for each way in which it is dealt
    way = F.when(F.col("n") > FAN, F.pmod("token", F.lit(3))).alias("way")
    shared = shared.groupBy("n", "sum", "xor", way).agg(F.min("token").alias("token")).select("token", "n")
    members = scratch.keep(at.join(shared, "token"))

    # dealt in three ways, so that a large group's parts overlap and become one component
    dealt = F.pmod(F.xxhash64("node", F.pmod("token", F.lit(3))), F.ceil(F.col("n") / FAN))
    parts = members.select("token", "node", dealt.alias("part"))
    first = parts.groupBy("token", "part").agg(F.min("node").alias("a"))
    begun = parts.join(first, ["token", "part"]).where("node <> a").select("a", F.col("node").alias("b"))
    begun = begun.unionByName(met(nodes.select("node", "fp"), scratch, radius)).distinct()
    with arrow_batches(spark):
        begun = scratch.keep(_near(begun, nodes, bound, "sketch"))
    found = scratch.keep(_verified(begun, nodes, texts, scratch, shingle, bound))
    roots = scratch.keep(components(found, scratch))

    rooted = nodes.join(roots, "node", "left").select("node", "size", "sketch", F.coalesce("root", "node").alias("root"))
    named = scratch.keep(members.join(rooted.select("node", "root"), "node"))
    scratch.drop(members)
    split = named.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    left = named.join(split.select("token"), "token").select("token", "n", "node")
    left = left.withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int"))
    left = left.withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(7)), F.col("chunks")).cast("int"))
    left = scratch.keep(left)
    least = left.groupBy("node").agg(F.slice(F.sort_array(F.collect_list("token")), 1, LEAST_KEYS).alias("least"))
    blocks = left.withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)"))).select(
        F.xxhash64("token", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("block"), "token",
        F.when(F.col("chunk") == F.col("other"), -1).otherwise(F.col("chunk")).alias("chunk"), "node",
    )
    blocks = blocks.join(rooted.join(least, "node"), "node")
    blocks = blocks.select("block", "token", "chunk", "node", "root", "size", "sketch", "least")
    rest = blocks.repartition("block").sortWithinPartitions("block").mapInArrow(_block_pairs(bound), "a long, b long")
    with arrow_batches(spark):
        rest = scratch.keep(rest.distinct().join(begun, ["a", "b"], "left_anti"))
    scratch.drop(named)
    more = scratch.keep(_verified(rest, nodes, texts, scratch, shingle, bound))
    named = nodes.select("node", "text_hash").join(roots, "node", "left").select("text_hash", F.coalesce("root", "node").alias("root"))
    if more.isEmpty():
        return named
    # components that these pairs join are found among the roots alone
    above = [roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in ("a", "b")]
    ends = more.join(above[0], "a", "left").join(above[1], "b", "left")
    upper = components(ends.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")), scratch)
    return named.join(upper.toDF("root", "top"), "root", "left").select("text_hash", F.coalesce("top", "root").alias("root"))
