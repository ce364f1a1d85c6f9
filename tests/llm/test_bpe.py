import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

from loomgraph.llm import bpe


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


def test_vocabulary_and_random_texts():
    t, ranks = reference()
    c = bpe.codec(*bpe.default_files())
    assert all(c.token[r] == b for b, r in ranks.items())
    rnd = random.Random(0)
    alphabet = ["a", "B", " ", "\n", "\t", "　", "'s", "'S", "é", "é", "\0", "\x85", "😀", "1", "٣", "中", "<|endoftext|>", "\r", "ſ"]
    for _ in range(2000):
        s = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 14)))
        ids = c.encode(s)
        assert ids.tolist() == t.encode_ordinary(s) and c.decode(ids) == s


def test_split_characters_and_offsets():
    c = bpe.codec(*bpe.default_files())
    ids = c.encode("a😀é")
    assert c.decode(ids[:2]) == "a�" and c.decode_bytes(ids) == "a😀é".encode()
    spans = c.offsets("a😀é", ids)
    assert spans[0] == (0, 1) and spans[-1][1] == 3 and all(a < b for a, b in spans)


def test_query_equals_reference(docs, rows, empty):
    t, _ = reference()
    want = []
    for r in rows:
        ids = t.encode_ordinary(r.text or "")
        packed = np.array(ids, "<u4").tobytes()
        want.append((str(r.doc_id), len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    got = [(str(g.doc_id), g.n_tokens, g.ids_sha256, g.decoded_sha256) for g in bpe.op8(docs).collect()]
    assert sorted(got) == sorted(want)
    assert bpe.op8(empty).count() == 0


def test_decode_column(docs):
    back = bpe.decode(bpe.encode(docs.where("doc_id < 20"), offsets=True)).select("doc_id", "text")
    assert back.exceptAll(docs.where("doc_id < 20").select("doc_id", F.coalesce("text", F.lit("")))).count() == 0
