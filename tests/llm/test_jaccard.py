import random

import pytest

from loomgraph.llm import jaccard, simhash
from loomgraph.llm.common import Scratch


def sets(text, n=5):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def brute_groups(texts):
    """Connected components of all pairs at an exact similarity of 0.8 or more."""
    found, root = [sets(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(found):
        for j, y in enumerate(found[:i]):
            if 5 * len(x & y) >= 4 * len(x | y):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


def near_texts():
    """Texts with one to three changed words each, so that similarities lie on both sides of 0.8; all share a passage."""
    rnd, texts = random.Random(11), []
    vocabulary = [f"v{i}" for i in range(500)]
    passage = [rnd.choice(vocabulary) for _ in range(12)]
    for _ in range(40):
        base = passage + [rnd.choice(vocabulary) for _ in range(rnd.randint(20, 110))]
        for changes in (0, 1, 1, 2, 3):
            words = list(base)
            for at in rnd.sample(range(len(words)), changes):
                words[at] = f"new{rnd.randrange(10**6)}"
            texts.append(" ".join(words))
    return [*texts, "few words", "few  WORDS", "", None, " \n "]


def joined(pairs, n):
    """The least member of each one's component."""
    least = list(range(n))
    for _ in range(n):
        before = list(least)
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
        if least == before:
            break
    return least


def partition(keys, ids):
    out = {}
    for k, i in zip(keys, ids, strict=True):
        out.setdefault(k, set()).add(i)
    return sorted(map(sorted, out.values()))


def test_simhash_proposes_all_pairs_within_its_radius(spark):
    texts = [t for t in near_texts() if t]
    prints = [simhash.fingerprint(t.encode(), 5)[0] for t in texts]
    nodes = spark.createDataFrame(list(enumerate(prints)), "node long, fp long")
    found = {(r.a, r.b) for r in jaccard.met(nodes, Scratch(spark, "test"), 4).collect()}
    near = [(i, j) for j in range(len(texts)) for i in range(j) if ((prints[i] ^ prints[j]) & 2**64 - 1).bit_count() <= 4]
    assert found <= set(near) and len(found) > 5 and joined(found, len(texts)) == joined(near, len(texts))


def test_near_duplicate_stage_goes_through_simhash(spark, monkeypatch):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    seen, links = [], simhash.links

    def watched(nodes, radius, *rest):
        seen.append(({r.node for r in nodes.collect()}, radius))
        return links(nodes, radius, *rest)

    monkeypatch.setattr(simhash, "links", watched)
    docs = spark.createDataFrame(list(enumerate(near_texts())), "doc_id long, text string")
    corpus_pipeline.distinct_documents(spark, docs, "").count()
    assert seen == [({simhash.fingerprint((t or "").encode(), 5)[0] for t in near_texts()}, 4)]


def test_groups_equal_brute_force_at_any_chunk(spark, monkeypatch):
    texts = near_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = partition(brute_groups(texts), range(len(texts)))
    for fan, chunk, least in ((512, 2048, 16), (3, 8, 1)):
        monkeypatch.setattr(jaccard, "FAN", fan)
        monkeypatch.setattr(jaccard, "CHUNK", chunk)
        monkeypatch.setattr(jaccard, "LEAST_KEYS", least)
        monkeypatch.setattr(jaccard, "BROADCAST_ROWS", fan)
        got = simhash.near_duplicates(docs, 5, 4, 1, 0.8).collect()
        assert partition([r.root for r in got], [r.doc_id for r in got]) == want
        assert all(r.component_id == min(g) for r in got for g in want if r.doc_id in g)
    kept = {r.doc_id for r in simhash.dedup(docs).collect()}
    assert kept == {g[0] for g in want}


def block_rows(least):
    """Two equal texts of other roots that meet in the buckets 5, 7 and 9."""
    import numpy as np
    import pyarrow as pa

    cells = jaccard.sketch(np.arange(10, dtype=np.uint64)).tobytes()
    rows = [(100 + t, t, -1, node, node, 10, cells, least) for t in (5, 7, 9) for node in (1, 2)]
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=list("abcdefgh")
    )


def test_a_pair_leaves_one_of_its_buckets():
    """With all keys at hand the least bucket gives the pair; of keys that aren't carried each bucket gives it."""
    for least, want in (([5, 7, 9], 1), ([5], 1), ([], 3), ([9], 3)):
        got = sum(b.num_rows for b in jaccard._block_pairs(0.8)(iter([block_rows(least)])))
        assert got == want


def test_bounds_lose_no_pair():
    rnd = random.Random(3)
    import numpy as np

    for _ in range(300):
        n = rnd.randint(1, 200)
        x = {rnd.getrandbits(64) for _ in range(n)}
        y = set(rnd.sample(sorted(x), rnd.randint(int(0.8 * n), n))) | {rnd.getrandbits(64) for _ in range(rnd.randint(0, n // 5))}
        a, b = (np.array(sorted(s), np.uint64) for s in (x, y))
        true = 5 * len(x & y) >= 4 * len(x | y)
        assert jaccard.similar(a, b, 0.8) == true
        if true:
            p, q = jaccard.prefix_length(len(a), 0.8), jaccard.prefix_length(len(b), 0.8)
            assert set(a[:p].tolist()) & set(b[:q].tolist())
            assert not jaccard._far(jaccard.sketch(a), jaccard.sketch(b), np.array(len(a) + len(b)), 0.8)
            fine = [jaccard.sketch(h, jaccard.fine_cells(len(h))).tobytes() for h in (a, b)]
            assert jaccard._fine_near(*fine, len(a) + len(b), 0.8)


def test_pairs_at_the_bound_have_a_key_in_common():
    """Sets of all sizes, of exactly as many differences as the bound leaves, on one side, on both, across octaves of size."""
    import numpy as np

    rnd = np.random.default_rng(2)
    for n in [*range(1, 80), *range(80, 1100, 17)]:
        for _ in range(4):
            common = rnd.integers(0, 2**64, n, np.uint64)
            apart = int(n / 4)  # 0.8 of the union is common
            mine = int(rnd.integers(0, apart + 1))
            more = rnd.integers(0, 2**64, apart, np.uint64)
            a, b = np.unique(np.concatenate([common, more[:mine]])), np.unique(np.concatenate([common, more[mine:]]))
            assert jaccard.similar(a, b, 0.8)
            assert set(jaccard.keys(a, 0.8).tolist()) & set(jaccard.keys(b, 0.8).tolist())


def test_a_link_does_not_hang_on_other_documents(spark):
    words = [f"t{i}" for i in range(50)]
    pair = [(0, " ".join(words)), (1, " ".join(["x", *words[1:]]))]
    rnd = random.Random(4)
    others = [(10 + k, " ".join([*words[:5], *(f"o{rnd.randrange(10**6)}" for _ in range(60))])) for k in range(400)]
    for rows in (pair, pair + others):
        kept = simhash.dedup(spark.createDataFrame(rows, "doc_id long, text string"))
        assert kept.count() == len(rows) - 1


def test_texts_below_the_bound_are_no_link(spark):
    """One changed word in 50 leaves 41 of 51 shingles (0.804); two apart leave 36 of 56 (0.64) and stay two documents."""
    words = [f"t{i}" for i in range(50)]
    one, two = list(words), list(words)
    one[10] = two[10] = "x"
    two[30] = "y"
    pairs = {"linked": (words, one), "apart": (words, two)}
    for name, (a, b) in pairs.items():
        docs = spark.createDataFrame([(0, " ".join(a)), (1, " ".join(b))], "doc_id long, text string")
        assert simhash.dedup(docs).count() == (1 if name == "linked" else 2)


def test_pipeline_stage_equals_brute_force(spark, docs, rows):
    """Groups of the fixture by plain Python: one document of each stays, the one with the least id, nulls last."""
    import corpus_pipeline

    distinct = sorted({r.text for r in rows}, key=str)
    group = dict(zip(distinct, brute_groups(distinct), strict=True))
    ids = {}
    for r in rows:
        ids.setdefault(group[r.text], []).append(r.doc_id)
    want = sorted(str(min((i for i in g if i is not None), default=None)) for g in ids.values())
    assert sorted(str(r.doc_id) for r in corpus_pipeline.distinct_documents(spark, docs, "").collect()) == want
