"""Repeated passages by level-wise doubling: only what repeats at one length is looked at at twice that length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, short_batches

U = np.uint64
#: Odd multipliers of two independent rolling hashes, with their inverses modulo 2**64.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
INVERSES = tuple(pow(m, -1, 2**64) for m in MULTIPLIERS)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64; grown by doubling and kept by the worker."""
    got = _POWERS.get(base)
    if got is None or len(got) < n:
        got = np.full(max(1024, 1 << (n - 1).bit_length()), base, U)
        got[0] = 1
        got = _POWERS[base] = np.multiply.accumulate(got)
    return got[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Rolling:
    """Hashes of any run of words of one text, from sums over its prefixes."""

    def __init__(self, words: list[bytes], which: int = 0):
        n = len(words)
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), U, n)
        if which:
            h = _mix(h + U(which))
        self.inverse = _powers(INVERSES[which], n + 1)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(h * _powers(MULTIPLIERS[which], n), out=self.sums[1:])

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(U))


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of each `width` neighbours, by doubling."""
    step, rest = 1, x
    while 2 * step <= width:
        rest = best(rest[:-step], rest[step:])
        step *= 2
    more = width - step
    return best(rest[: len(rest) - more], rest[more:]) if more else rest


def anchors(words: list[bytes], length: int) -> dict[str, np.ndarray] | None:
    """Anchor runs of a quarter of the length: those with the least hash in some window of `length` words.

    Equal windows hold equal anchors, so a window that repeats has an anchor that repeats. `context` covers all windows
    around an anchor, `middle` the runs of twice the anchor's length that end or begin with it.
    """
    n, short = len(words), -(-length // 4)
    if n < length:
        return None
    r = Rolling(words)
    at = np.arange(n - short + 1)
    g = r.runs(at, at + short)
    width = length - short + 1
    least = _sliding(g, width, np.minimum)
    pad = np.zeros(width - 1, U)
    chosen = np.flatnonzero(_sliding(np.concatenate([pad, least, pad]), width, np.maximum) == g)
    lo, hi = np.maximum(chosen - width + 1, 0), np.minimum(chosen, n - length)
    context = _mix(r.runs(lo, hi + length) + _mix(((chosen - lo) << 32 | (hi - lo)).astype(U)))
    twice = 2 * short
    right, left = np.minimum(chosen + twice, n), np.maximum(chosen - short, 0)
    right = np.where(chosen + twice <= n, r.runs(chosen, right) >> U(32), U(0))
    left = np.where(chosen >= short, r.runs(left, chosen + short) >> U(32), U(0))
    return {"anchor": g[chosen], "context": context, "middle": left << U(32) | right, "span": lo << 32 | hi}


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("hash"), text.cast("binary").alias("t"))


def _long(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.LongType()) for n in names]


def _found(docs: DataFrame, length: int) -> DataFrame:
    schema = T.StructType([docs.schema["doc_id"], *_long("hash", "anchor", "context", "middle", "span")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, parts = [], []
            for k, t in enumerate(b.column(2)):
                a = anchors(t.as_py().split(), length)
                if a is not None:
                    rows.append(np.full(len(a["span"]), k))
                    parts.append(a)
            if rows:
                pick = pa.array(np.concatenate(rows))
                more = [pa.array(np.concatenate([p[c] for p in parts]).view(np.int64)) for c in schema.names[2:]]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pick), b.column(1).take(pick), *more], names=schema.names)

    return docs.mapInArrow(run, schema)


def _packed(docs: DataFrame) -> DataFrame:
    """Texts compressed for the shuffle to their marks."""
    schema = T.StructType([docs.schema["doc_id"], *_long("hash"), T.StructField("z", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            z = pa.array([pack(t.as_py()) for t in b.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), z], names=schema.names)

    return docs.mapInArrow(run, schema)


def _same(right: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, Column]:
    """right with its key columns renamed, and the null-safe condition for a join on them."""
    on = None
    for n in names:
        right = right.withColumnRenamed(n, f"__{n}")
        term = F.col(n).eqNullSafe(F.col(f"__{n}")) if n == "doc_id" else F.col(n) == F.col(f"__{n}")
        on = term if on is None else on & term
    return right, on


def _windows(held: DataFrame, length: int) -> DataFrame:
    """Each window in the spans of a text once: two hashes, whether its passage repeats already, and its place."""
    names = ("high", "low", "weight", "hash", "place")
    schema = T.StructType([held.schema["doc_id"], *_long(*names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            rows, parts = [], []
            for k, (z, marks) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                words = unpack(z.as_py()).split()
                weight = np.zeros(len(words), np.int64)
                for m in marks.as_py():
                    lo, hi = m["span"] >> 32, m["span"] & 0xFFFFFFFF
                    weight[lo : hi + 1] = np.maximum(weight[lo : hi + 1], min(m["n"], 2))
                p = np.flatnonzero(weight)
                two = [Rolling(words, i).runs(p, p + length).view(np.int64) for i in (0, 1)]
                rows.append(np.full(len(p), k))
                parts.append((*two, weight[p], p))
            if rows:
                pick = pa.array(np.concatenate(rows))
                high, low, weight, place = (pa.array(np.concatenate([x[i] for x in parts])) for i in range(4))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pick), high, low, weight, b.column(1).take(pick), place], names=schema.names
                )

    return held.mapInArrow(run, schema)


def repeated_spans(docs: DataFrame, scratch: Scratch, length: int) -> DataFrame:
    """(doc_id, hash, span): ranges of starts (first << 32 | last) of windows that start anywhere else too.

    Level one counts anchors of a quarter of the length. Around those that repeat, equal contexts settle all their
    windows at once and stand for one another from then on: a context is all the words that any window around the anchor
    holds, so it is longer than a window, and where it is equal every longer length is equal as well; doubling it again
    could not tell its places apart. What differs goes on to runs of half the length, and what repeats there to whole
    windows, compared by 128-bit hashes. Counts pre-aggregate before each shuffle, and joins on a
    hot anchor can be split, since the other side is a written table with one row for each.
    """
    found = scratch.keep(_found(docs, length))
    again = scratch.keep(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"))
    first = scratch.keep(found.join(again, "anchor"))
    place = F.struct("doc_id", "hash", "span")
    contexts = scratch.keep(first.groupBy("anchor", "context", "middle").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("at")))
    settled = first.join(contexts.where("n > 1").select("anchor", "context"), ["anchor", "context"])
    settled = settled.select("doc_id", "hash", "span")

    mixed = contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("anchor")
    mixed = scratch.keep(mixed)
    halves = contexts.join(mixed, "anchor").select(
        "at", "n",
        F.explode(
            F.array(
                F.xxhash64("anchor", F.lit("L"), F.shiftrightunsigned("middle", 32)),
                F.xxhash64("anchor", F.lit("R"), F.col("middle").bitwiseAND(F.lit(0xFFFFFFFF))),
            )
        ).alias("half"),
    )
    halves = scratch.keep(halves)
    twice = scratch.keep(halves.groupBy("half").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("half"))
    open_ = halves.join(twice, "half").select("at.doc_id", "at.hash", "at.span", "n").distinct()
    marks = open_.groupBy("doc_id", "hash").agg(F.collect_list(F.struct("span", "n")).alias("marks"))
    marks, on = _same(marks, ("doc_id", "hash"))
    held = _packed(docs).join(marks, on).select("doc_id", "hash", "z", "marks").dropDuplicates(["doc_id", "hash"])
    windows = scratch.keep(_windows(held, length))
    seen = windows.groupBy("high", "low").agg(F.sum("weight").alias("w")).where("w > 1").select("high", "low")
    seen = scratch.keep(seen)
    single = windows.where("weight = 1").join(seen, ["high", "low"])
    single = single.select("doc_id", "hash", F.expr("shiftleft(place, 32) | place").alias("span"))
    return settled.unionByName(single)


def remove_repeats(docs: DataFrame, length: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept): texts without the words of windows of `length` words that start anywhere else.

    A null, empty or blank text has no words and keeps none, a text shorter than a window keeps all, and a text of any
    length is read as a whole. Repeated rows repeat one another, so their windows go. Null ids are an id like any other; an empty table gives no rows.
    """
    spark = docs.sparkSession
    short_batches(spark)
    scratch = Scratch(spark, "substrings")
    keyed = _keyed(docs, id_col, text_col)
    spans = repeated_spans(keyed, scratch, length)
    # repeated rows have equal spans; each is held once for all of them
    marks = spans.distinct().groupBy("doc_id", "hash").agg(F.collect_list("span").alias("spans"))
    marks, on = _same(marks, ("doc_id", "hash"))
    held = _packed(keyed).join(marks, on, "left").select("doc_id", "z", "spans")
    schema = T.StructType([keyed.schema["doc_id"], *_long("n_words", "n_removed"), T.StructField("kept", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            n, removed, kept = [], [], []
            for z, spans in zip(b.column(1), b.column(2), strict=True):
                words = unpack(z.as_py()).split()
                gone = 0
                if spans.is_valid:
                    s = spans.values.to_numpy()
                    edges = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edges, s >> 32, 1)
                    np.add.at(edges, (s & 0xFFFFFFFF) + length, -1)
                    stay = np.cumsum(edges)[:-1] == 0
                    gone = len(words) - int(stay.sum())
                    n.append(len(words))
                    words = [words[i] for i in np.flatnonzero(stay)]
                else:
                    n.append(len(words))
                removed.append(gone)
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())],
                names=schema.names,
            )

    return held.mapInArrow(run, schema)


def op3(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs, 35).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
