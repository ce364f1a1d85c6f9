"""Byte-level BPE with the tokenizers library over Arrow batches, and decoding back to bytes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import short_batches

#: Pieces that a Python worker remembers; when full, the memory is emptied. It changes speed only.
REMEMBERED = 200_000


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else the next from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + k) for k, b in enumerate(hidden)}


class Codec:
    """Encodes texts piece by piece. vocabulary: a tokenizers JSON file; pattern: the expression that cuts pieces."""

    def __init__(self, vocabulary: str, pattern: str):
        import regex
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)
        self.model, self.pieces = tokenizer.model, regex.compile(pattern).findall
        self.character = byte_characters()
        self.byte = {c: b for b, c in self.character.items()}
        added = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
        size = tokenizer.get_vocab_size()
        self.token = [b""] * size
        for i in range(size):
            s = tokenizer.id_to_token(i)
            self.token[i] = s.encode() if s in added else bytes(map(self.byte.__getitem__, s))
        self.known: dict[str, bytes] = {}

    def _packed(self, piece: str) -> bytes:
        """Ids of one piece as little-endian unsigned 32-bit integers."""
        mapped = "".join(map(self.character.__getitem__, piece.encode()))
        out = np.array([t.id for t in self.model.tokenize(mapped)], "<u4").tobytes()
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[piece] = out
        return out

    def encode_packed(self, text: str) -> bytes:
        known, pieces = self.known.get, self.pieces(text)
        found = list(map(known, pieces))
        if None in found:
            found = [f if f is not None else known(p) or self._packed(p) for f, p in zip(found, pieces, strict=True)]
        return b"".join(found)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_packed(text), "<u4")

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes of ids; a character whose bytes lie in several tokens comes together again."""
        return b"".join(map(self.token.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        """As text; bytes that are not UTF-8, as where a list of ids is cut in a character, become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def offsets(self, text: str, ids: np.ndarray) -> list[tuple[int, int]]:
        """Character ranges of each token; tokens that share a character both hold it."""
        lead = [b & 0xC0 != 0x80 for b in text.encode()]
        at = np.concatenate([[0], np.cumsum(lead)])
        out, pos = [], 0
        for i in ids.tolist():
            end = pos + len(self.token[i])
            out.append((int(at[pos + 1]) - 1, int(at[end])))
            pos = end
        return out


@lru_cache(maxsize=2)
def codec(vocabulary: str, pattern: str) -> Codec:
    return Codec(vocabulary, pattern)


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def encode(
    docs: DataFrame,
    vocabulary: str | None = None,
    pattern: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = True,
    offsets: bool = False,
) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids][, starts, ends]) for every row, from whole texts.

    A null text is empty: no tokens and the digest of no bytes. Rows are independent, so repeated rows give equal rows,
    and an empty table gives none. Markers of special tokens in a text are ordinary text.
    """
    files = default_files() if vocabulary is None or pattern is None else ("", "")
    vocabulary, pattern = vocabulary or files[0], pattern or files[1]
    short_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    fields = [
        source.schema["doc_id"],
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
    lists = ["ids"] * keep_ids + ["starts", "ends"] * offsets
    schema = T.StructType(fields + [T.StructField(x, T.ArrayType(T.IntegerType())) for x in lists])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary, pattern)
        for b in batches:
            n, packed, back, more = [], [], [], {x: [] for x in lists}
            for t in b.column(1):
                text = t.as_py()
                raw = c.encode_packed(text)
                ids = np.frombuffer(raw, "<u4")
                n.append(len(ids))
                packed.append(hashlib.sha256(raw).hexdigest())
                back.append(hashlib.sha256(c.decode_bytes(ids)).hexdigest())
                if keep_ids:
                    more["ids"].append(ids.astype(np.int32))
                if offsets:
                    spans = c.offsets(text, ids)
                    more["starts"].append([x for x, _ in spans])
                    more["ends"].append([x for _, x in spans])
            arrays = [b.column(0), pa.array(n, pa.int64()), pa.array(packed, pa.string()), pa.array(back, pa.string())]
            arrays += [pa.array(more[x], pa.list_(pa.int32())) for x in lists]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return source.mapInArrow(run, schema)


def decode(tokens: DataFrame, vocabulary: str | None = None, pattern: str | None = None, ids_col: str = "ids") -> DataFrame:
    """tokens with a column text: the ids decoded. Null ids give a null text, no ids an empty one."""
    files = default_files() if vocabulary is None or pattern is None else ("", "")
    vocabulary, pattern = vocabulary or files[0], pattern or files[1]

    @F.pandas_udf(T.StringType())
    def text(ids):
        c = codec(vocabulary, pattern)
        return ids.map(lambda x: None if x is None else c.decode(np.asarray(x, np.int64)))

    return tokens.withColumn("text", text(F.col(ids_col)))


def op8(docs: DataFrame) -> DataFrame:
    return encode(docs, keep_ids=False)
