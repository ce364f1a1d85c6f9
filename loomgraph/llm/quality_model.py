"""Quality classifier: votes of the nearest labelled documents in a latent semantic space."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import short_batches

#: Labelled rows that the model is fitted on, at most; chosen by hash. This bounds what the driver holds and broadcasts.
SAMPLE_ROWS = 4000
#: Hashed features: words, word shapes, and counts of repetition. Each group has its own range and unit length.
WORD_DIMS, SHAPE_DIMS, FORM_DIMS = 3072, 512, 128
RANGES = ((0, WORD_DIMS), (WORD_DIMS, WORD_DIMS + SHAPE_DIMS), (WORD_DIMS + SHAPE_DIMS, WORD_DIMS + SHAPE_DIMS + FORM_DIMS))
DIMS = RANGES[-1][1]
GROUP_WEIGHTS = (1.0, 1.0, 0.5)
COMPONENTS, NEIGHBOURS, THRESHOLD = 48, 15, 0.3

_CLASSES = bytes(
    0x41 if 0x41 <= b <= 0x5A else 0x61 if 0x61 <= b <= 0x7A or b >= 0x80 else 0x30 if 0x30 <= b <= 0x39 else b for b in range(256)
)
_RUN = re.compile(rb"(.)\1+")


def features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Sparse features of a whole text: dimensions and log counts. An empty text has the form feature of no words."""
    words = (text or b"").split()
    n = len(words)
    counts = Counter(words)
    found: Counter = Counter()
    for w, c in counts.items():
        found[zlib.crc32(w.lower()) % WORD_DIMS] += c
    shapes: Counter = Counter()
    for s, c in Counter(_RUN.sub(rb"\1", b" ".join(words).translate(_CLASSES)).split()).items():
        shapes[WORD_DIMS + zlib.crc32(s) % SHAPE_DIMS] += c
    lines = [x for x in (text or b"").split(b"\n") if x.strip()]
    parts = {
        "distinct": 1 - len(counts) / n if n else 1,
        "adjacent": sum(map(eq, words, words[1:])) / n if n else 1,
        "top": max(counts.values()) / n if n else 1,
        "lines": 1 - len(set(lines)) / len(lines) if lines else 1,
    }
    # a share sets one feature for each step of a sixteenth that it reaches, so near shares have near vectors
    base = WORD_DIMS + SHAPE_DIMS
    steps = [f"{k}>={i}" for k, share in parts.items() for i in range(1, round(16 * share) + 1)]
    forms = [*dict.fromkeys(base + zlib.crc32(x.encode()) % FORM_DIMS for x in ["text", f"size:{n.bit_length()}", *steps])]
    at = np.array([*found, *shapes, *forms], np.int32)
    value = np.log1p(np.array([*found.values(), *shapes.values(), *[1] * len(forms)], np.float32))
    return at, value


@dataclass
class Model:
    idf: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def embed(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Unit latent vectors; a text without features is the zero vector."""
        return _unit(_weighted(rows, self.idf) @ self.projection)

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Exact cosines with all labelled vectors, one block; the nearest vote with their similarity as weight.

        Cosines count to five decimals. Of equal ones at the last place those of the least ids vote; without a positive
        similarity the score is the share of label 1.
        """
        cosine = np.round(self.embed(rows) @ self.vectors.T, 5)
        k = min(NEIGHBOURS, cosine.shape[1])
        last = np.partition(cosine, -k, axis=1)[:, -k, None]
        above, tied = cosine > last, cosine == last
        tied &= np.cumsum(tied, axis=1) <= k - above.sum(axis=1, keepdims=True)
        weight = np.where(above | tied, np.maximum(cosine, 0), 0).astype(np.float64)
        total, vote = weight.sum(axis=1), weight @ self.labels
        return np.clip(np.where(total > 0, vote / np.maximum(total, 1e-12), self.labels.mean()), 0.0, 1.0)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _weighted(rows: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray) -> np.ndarray:
    out = np.zeros((len(rows), DIMS), np.float32)
    for k, (at, value) in enumerate(rows):
        out[k, at] = value
    out *= idf
    for (a, z), w in zip(RANGES, GROUP_WEIGHTS, strict=True):
        out[:, a:z] = w * _unit(out[:, a:z])
    return out


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Model:
    """TF-IDF and a randomised truncated SVD with a fixed seed, on the bounded sample."""
    seen = np.zeros(DIMS)
    for at, _ in rows:
        seen[at] += 1
    idf = (np.log((1 + len(rows)) / (1 + seen)) + 1).astype(np.float32)
    x = _weighted(rows, idf)
    k = min(COMPONENTS, *x.shape)
    q = np.random.default_rng(0).standard_normal((DIMS, min(k + 16, DIMS))).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    model = Model(idf, (q @ v[:k].T).astype(np.float32), np.zeros((0, k), np.float32), labels.astype(np.float64))
    model.vectors = model.embed(rows)
    return model


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model | None:
    """Fit on at most `rows` labelled documents whose id isn't held out. None if there is no such row.

    Null labels and labels of unknown documents are left out; of the rest, the ids with the least hash are taken. An id
    counts once: of repeated labels the least, of repeated documents the least text.
    """
    short_batches(docs.sparkSession)
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows)
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("t")).join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.min("t").alias("t"), F.min("quality").alias("quality"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [features(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([x for x, _ in f], pa.list_(pa.int32())), pa.array([x for _, x in f], pa.list_(pa.float32()))],
                names=schema.names,
            )

    schema = T.StructType(
        [texts.schema["doc_id"], texts.schema["quality"], T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("value", T.ArrayType(T.FloatType()))]
    )
    got = sorted(texts.mapInArrow(run, schema).collect(), key=lambda r: (str(r[0]), r[1]))
    if not got:
        return None
    return train([(np.array(r[2], np.int32), np.array(r[3], np.float32)) for r in got], np.array([r[1] for r in got]))


def is_held_out() -> Column:
    """crc32 of the id as text leaves no remainder by 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' ids with a score; inputs are whole texts only. Without a model every score is 0.5."""
    spark = docs.sparkSession
    short_batches(spark)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    schema = T.StructType([source.schema["doc_id"], T.StructField("score", T.DoubleType())])
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            rows = [features(t.as_py()) for t in b.column(1)]
            s = np.full(len(rows), 0.5) if m is None or not rows else m.scores(rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], names=schema.names)

    return source.mapInArrow(run, schema)


def op2(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score and prediction for every document, repeated rows included; null and empty texts are scored by their form alone.

    A text of any length is read as a whole; other columns than doc_id and text are not looked at.
    """
    out = score(docs, fit(docs, labels)).withColumn("held_out", is_held_out())
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
