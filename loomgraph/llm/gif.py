"""GIF media columns: LZW code streams, palettes, disposal and transparency, timed frames with colour histograms."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import short_batches

#: Codes have at most 12 bits (GIF89a), so a table has at most 4096 entries.
TOP = 4096
WIDTH, FRAME_ROWS, DELAY_CS = 64, 1024, 10
#: Pixels of a canvas or frame up to which a file is decoded; its header may claim any.
MOST_PIXELS = 1 << 26
GREY = bytes(v for i in range(256) for v in (i, i, i))


def _widths(count: int, least: int, first: int = 0) -> np.ndarray:
    """Bits of the codes number first, first+1, ... after a clear code: the table gets an entry with every code but one."""
    entries = (1 << (least - 1)) + 2 + np.maximum(np.arange(first, first + count) - 1, 0)
    return np.minimum(np.maximum(np.floor(np.log2(entries)).astype(np.int64) + 1, least), 12)


_WIDTHS = {least: _widths(2 * TOP, least) for least in range(3, 10)}


def lzw_encode(data: bytes, size: int = 8) -> bytes:
    """The code stream of palette indices below 2**size; the table is cleared when it is full."""
    clear = 1 << size
    segments, codes, table, free = [], [], {}, clear + 2
    get, put = table.get, codes.append
    at = data[0] if data else None
    for b in data[1:]:
        key = at << 8 | b
        found = get(key)
        if found is not None:
            at = found
            continue
        put(at)
        if free < TOP:
            table[key] = free
            free += 1
        else:
            codes.append(clear)
            segments.append(codes)
            codes, free = [], clear + 2
            put = codes.append
            table.clear()
        at = b
    if at is not None:
        put(at)
    codes.append(clear + 1)
    segments.append(codes)
    widths = np.concatenate([[size + 1], *[_WIDTHS[size + 1][: len(s)] for s in segments]])
    values = np.concatenate([[clear], *segments]).astype(np.uint16)
    bits = (values[:, None] >> np.arange(12, dtype=np.uint16)) & np.uint16(1)
    return np.packbits(bits[np.arange(12) < widths[:, None]].astype(np.uint8), bitorder="little").tobytes()


def lzw_decode(stream: bytes, size: int, most: int) -> bytes:
    """At most `most` indices of a code stream; a code beyond the table raises ValueError."""
    if not 2 <= size <= 8:
        raise ValueError(f"LZW code size {size}")
    clear = 1 << size
    base = [bytes([i]) for i in range(clear)] + [b"", b""]
    raw = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.uint32)
    bits, at, number, out, total = 8 * len(stream), 0, 0, [], 0
    table, prev = base[:], None
    steady = _WIDTHS[size + 1]
    while at < bits and total < most:
        widths = steady[number : number + TOP] if number < TOP else np.full(TOP, 12)
        ends = at + np.cumsum(widths)
        ends = ends[: np.searchsorted(ends, bits, "right")]
        if not len(ends):
            break
        widths = widths[: len(ends)]
        starts = ends - widths
        byte = starts >> 3
        codes = raw[byte] | raw[byte + 1] << np.uint32(8) | raw[byte + 2] << np.uint32(16)
        codes = (codes >> (starts & 7).astype(np.uint32)) & ((1 << widths) - 1).astype(np.uint32)
        stops = np.flatnonzero((codes == clear) | (codes == clear + 1))
        stop = int(stops[0]) if len(stops) else len(codes)
        for c in codes[:stop].tolist():
            if prev is None:
                if c >= clear:
                    raise ValueError("LZW stream starts with a code that isn't a literal")
                cur = base[c]
            else:
                if c < len(table):
                    cur = table[c]
                elif c == len(table) < TOP:
                    cur = prev + prev[:1]
                else:
                    raise ValueError("LZW code beyond the table")
                if len(table) < TOP:
                    table.append(prev + cur[:1])
            out.append(cur)
            total += len(cur)
            prev = cur
        if stop == len(codes):
            at, number = int(ends[-1]), number + len(codes)
            continue
        if codes[stop] == clear + 1:
            break
        at, number, table, prev = int(ends[stop]), 0, base[:], None
    return b"".join(out)[:most]


@dataclass
class Frame:
    """One timed frame: its rectangle, and the whole canvas (rows, columns, RGBA) as it is shown."""

    delay_ms: int
    x: int
    y: int
    width: int
    height: int
    disposal: int
    canvas: np.ndarray


def _interlaced(height: int) -> np.ndarray:
    """Row numbers in the order of the four passes."""
    return np.concatenate([np.arange(a, height, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])


def frames(data: bytes) -> Iterator[Frame]:
    """Frames of a GIF as shown, one after another: the canvas is kept, cleared or put back as each frame says."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    wide, high, packed = struct.unpack("<HHB", data[6:11])
    at, shared = 13, None
    if packed & 0x80:
        n = 2 << (packed & 7)
        shared = np.frombuffer(data[at : at + 3 * n], np.uint8).reshape(-1, 3)
        at += 3 * n
    if high * wide > MOST_PIXELS:
        raise ValueError("the canvas is too large")
    canvas = np.zeros((high, wide, 4), np.uint8)
    delay = disposal = 0
    clear = None

    def blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while (n := data[at]) != 0:
            parts.append(data[at + 1 : at + 1 + n])
            at += 1 + n
        return b"".join(parts), at + 1

    try:
        while (kind := data[at]) != 0x3B:
            if kind == 0x21:
                body, after = blocks(at + 2)
                if data[at + 1] == 0xF9:
                    flags, delay, index = struct.unpack("<BHB", body[:4])
                    disposal, clear = flags >> 2 & 7, index if flags & 1 else None
                at = after
                continue
            if kind != 0x2C:
                raise ValueError(f"unknown block {kind:#x}")
            x, y, w, h, packed = struct.unpack("<HHHHB", data[at + 1 : at + 10])
            at += 10
            palette = shared
            if packed & 0x80:
                n = 2 << (packed & 7)
                palette = np.frombuffer(data[at : at + 3 * n], np.uint8).reshape(-1, 3)
                at += 3 * n
            if palette is None:
                raise ValueError("no palette")
            size = data[at]
            stream, at = blocks(at + 1)
            if w * h > MOST_PIXELS:
                raise ValueError("the frame is too large")
            index = np.frombuffer(lzw_decode(stream, size, w * h), np.uint8)
            if len(index) < w * h:
                raise ValueError("too few pixels")
            index = index.reshape(h, w)
            if packed & 0x40:
                index = index[np.argsort(_interlaced(h))]
            if index.size and int(index.max()) >= len(palette):
                raise ValueError("index beyond the palette")
            area = canvas[y : y + h, x : x + w]
            index = index[: area.shape[0], : area.shape[1]]
            before = area.copy() if disposal == 3 else None
            seen = np.ones(index.shape, bool) if clear is None else index != clear
            area[seen, :3] = palette[index[seen]]
            area[seen, 3] = 255
            yield Frame(10 * delay, x, y, w, h, disposal, canvas)
            if disposal == 2:
                area[:] = 0
            elif disposal == 3:
                area[:] = before
            delay, disposal, clear = 0, 0, None
    except (IndexError, struct.error):
        raise ValueError("the file ends too early") from None


def _sub_blocks(stream: bytes) -> bytes:
    return b"".join(bytes([len(p)]) + p for i in range(0, len(stream), 255) if (p := stream[i : i + 255])) + b"\0"


def write_samples(payload: bytes) -> bytes:
    """A GIF whose 8-bit samples are the payload: frames of WIDTH columns and up to FRAME_ROWS rows, grey palette."""
    step = WIDTH * FRAME_ROWS
    rows = min(len(payload), step) // WIDTH
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, rows, 0xF7, 0, 0), GREY]
    for i in range(0, len(payload), step):
        part = payload[i : i + step]
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, DELAY_CS, 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0) + b"\x08")
        out.append(_sub_blocks(lzw_encode(part)))
    return b"".join([*out, b"\x3b"])


def read_samples(media: bytes, histograms: list[list[int]] | None = None) -> tuple[bytes, list[Frame]]:
    """The payload of write_samples, and its frames without their canvases; their colour histograms are added to a list."""
    parts, shown = [], []
    for f in frames(media):
        parts.append(f.canvas[f.y : f.y + f.height, f.x : f.x + f.width, 0].tobytes())
        if histograms is not None:
            histograms.append(colour_histogram(f.canvas).tolist())
        f.canvas = None
        shown.append(f)
    return b"".join(parts), shown


def colour_histogram(canvas: np.ndarray) -> np.ndarray:
    """Counts of visible pixels in 4 x 4 x 4 cells of red, green and blue."""
    seen = canvas[canvas[..., 3] > 0] >> 6
    return np.bincount(seen[:, 0].astype(np.int64) * 16 + seen[:, 1] * 4 + seen[:, 2], minlength=64)


def padded(text: bytes | None) -> bytes:
    text = text or b""
    return text + bytes(-len(text) % 64 if text else 64)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text as UTF-8, padded with zero bytes to a positive multiple of 64, as a GIF.

    A null text is empty: one row of 64 zero samples. Equal texts get equal media; an empty table gives no rows.
    """
    short_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    schema = T.StructType(
        [source.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py() or b"" for t in b.column(1)]
            media = [write_samples(padded(t)) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], names=schema.names
            )

    return source.mapInArrow(run, schema)


def frame_table(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row for each timed frame: rectangle, disposal, delay, start time and colour histogram; error for what fails.

    A media value that is null or not a GIF gives one row with an error and no frame number; frames before the fault stay.
    """
    short_batches(media.sparkSession)
    source = media.select(F.col(id_col).alias("doc_id"), F.col(media_col).alias("m"))
    longs = ["frame", "start_ms", "delay_ms", "x", "y", "width", "height", "disposal"]
    schema = T.StructType(
        [source.schema["doc_id"]]
        + [T.StructField(n, T.LongType()) for n in longs]
        + [T.StructField("histogram", T.ArrayType(T.LongType())), T.StructField("error", T.StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, ids = [], []
            for k, m in enumerate(b.column(1)):
                start = 0
                try:
                    for i, f in enumerate(frames(m.as_py() or b"")):
                        rows.append((i, start, f.delay_ms, f.x, f.y, f.width, f.height, f.disposal, colour_histogram(f.canvas).tolist(), None))
                        ids.append(k)
                        start += f.delay_ms
                except ValueError as e:
                    rows.append((None,) * 9 + (str(e),))
                    ids.append(k)
            arrays = [b.column(0).take(pa.array(ids, pa.int64()))]
            arrays += [pa.array([r[i] for r in rows], pa.int64()) for i in range(8)]
            arrays += [pa.array([r[8] for r in rows], pa.list_(pa.int64())), pa.array([r[9] for r in rows], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return source.mapInArrow(run, schema)


def _feature(payload: bytes, shown: list[Frame], histograms: list[list[int]]) -> str:
    """Frames, time and grey levels of the payload, and the filled cells (cell:pixels) of each frame's colour histogram."""
    counts = np.bincount(np.frombuffer(payload, np.uint8) >> 4, minlength=16)
    cells = "/".join(",".join(f"{i}:{n}" for i, n in enumerate(h) if n) for h in histograms)
    return f"frames={len(shown)};ms={sum(f.delay_ms for f in shown)};grey16={','.join(map(str, counts.tolist()))};rgb64={cells}"


def op5(docs: DataFrame) -> DataFrame:
    """Store every text as a GIF, read the stored bytes back and digest them."""
    stored = store(docs)
    text = lambda n: T.StructField(n, T.StringType())
    long = lambda n: T.StructField(n, T.LongType())
    schema = T.StructType(
        [stored.schema["doc_id"], long("n_bytes"), long("payload_bytes"), text("payload_sha256"), long("tail_crc32")]
        + [long("media_bytes"), text("media_sha256"), text("feature")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for m in b.column(2):
                media = m.as_py()
                histograms: list[list[int]] = []
                payload, shown = read_samples(media, histograms)
                rows.append(
                    (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media))
                    + (hashlib.sha256(media).hexdigest(), _feature(payload, shown, histograms))
                )
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *arrays], names=schema.names)

    return stored.mapInArrow(run, schema)
