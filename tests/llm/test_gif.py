import os
import random

import numpy as np
import pytest

from loomgraph.llm import gif

#: A public teaching sample: 10 x 10 pixels, four colours.
SAMPLE = bytes.fromhex(
    "47494638396110001000910000ffffffff00000000ff00000021f90400000000002c000000000a000a000002168c2d99872a1cdc33a00275ec95faa8de608c04914c01003b"
    .replace("10001000", "0a000a00")
)


def test_known_file():
    (frame,) = gif.frames(SAMPLE)
    assert (frame.width, frame.height, frame.canvas.shape) == (10, 10, (10, 10, 4))
    colours = {tuple(c[:3]) for c in frame.canvas.reshape(-1, 4).tolist()}
    assert colours == {(255, 255, 255), (255, 0, 0), (0, 0, 255)}
    assert frame.canvas[0, 0, :3].tolist() == [255, 0, 0] and frame.canvas[0, 9, :3].tolist() == [0, 0, 255]
    assert gif.colour_histogram(frame.canvas).sum() == 100


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 5000, 70000])
def test_round_trip(n):
    rnd = random.Random(n)
    for data in (os.urandom(n), bytes(rnd.choice(b"abc ") for _ in range(n)), b"a" * n):
        payload = gif.padded(data)
        assert len(payload) % 64 == 0 and payload and payload.startswith(data)
        back, shown = gif.read_samples(gif.write_samples(payload))
        assert back == payload and len(shown) == -(-len(payload) // 65536)
    for size in (2, 4, 7):
        indices = bytes(rnd.randrange(1 << size) for _ in range(n))
        assert gif.lzw_decode(gif.lzw_encode(indices, size), size, n) == indices


def _frame(index, x, y, w, h, disposal, clear=None, delay=5):
    flags = disposal << 2 | (clear is not None)
    return (
        b"\x21\xf9\x04" + bytes([flags, delay, 0, clear or 0, 0]) + b"\x2c" + b"".join(v.to_bytes(2, "little") for v in (x, y, w, h))
        + b"\0\x02" + gif._sub_blocks(gif.lzw_encode(bytes(index), 2))
    )


def test_disposal_transparency_and_delays():
    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    head = b"GIF89a" + b"\2\0\2\0" + bytes([0x91, 0, 0]) + palette
    data = head + _frame([1] * 4, 0, 0, 2, 2, 1) + _frame([2], 0, 0, 1, 1, 3) + _frame([3], 1, 1, 1, 1, 2) + _frame([0, 2, 0, 0], 0, 0, 2, 2, 0, 0) + b"\x3b"
    shown = [(f.delay_ms, f.canvas[..., :3].argmax(-1).tolist(), f.canvas[..., 3].tolist()) for f in gif.frames(data)]
    assert [s[0] for s in shown] == [50] * 4
    assert shown[1][1][0][0] == 1 and shown[2][1] == [[0, 0], [0, 2]]
    assert shown[3][1][0][1] == 1 and shown[3][2] == [[255, 255], [255, 0]]


def test_faults_are_rows(spark):
    df = spark.createDataFrame([(1, bytearray(SAMPLE)), (2, bytearray(b"nothing")), (3, None), (4, bytearray(SAMPLE[:40]))], "doc_id long, media binary")
    got = {r.doc_id: r for r in gif.frame_table(df).collect()}
    assert got[1].error is None and sum(got[1].histogram) == 100 and all(got[i].error for i in (2, 3, 4))


def test_query(docs, rows, empty):
    import hashlib
    import zlib

    got = gif.op5(docs).collect()
    want = sorted((str(r.doc_id), len((r.text or "").encode()), hashlib.sha256(p := gif.padded((r.text or "").encode())).hexdigest(), zlib.crc32(p[-64:])) for r in rows)
    assert sorted((str(g.doc_id), g.n_bytes, g.payload_sha256, g.tail_crc32) for g in got) == want
    assert gif.op5(empty).count() == 0 and np.all([g.payload_bytes % 64 == 0 for g in got])


def test_feature_holds_the_frames_colour_histograms(docs):
    some = docs.where("doc_id in (0, 204)")
    frames = {}
    for r in gif.frame_table(gif.store(some)).distinct().collect():
        frames.setdefault(r.doc_id, {})[r.frame] = ",".join(f"{i}:{n}" for i, n in enumerate(r.histogram) if n)
    for r in gif.op5(some).collect():
        assert r.feature.split("rgb64=")[1] == "/".join(frames[r.doc_id][k] for k in sorted(frames[r.doc_id]))
    assert len(frames[204]) > 1
