import re

import xxhash

from loomgraph.llm import simhash


def brute(text, n=4):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]), seed=42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_masks_cover_every_pair_of_four_bits():
    from itertools import combinations

    masks = simhash.masks(4)
    assert len(masks) == 31
    for bits in combinations(range(0, 64, 3), 4):
        assert any(not any(m >> b & 1 for b in bits) for m in masks)


def test_components_equal_brute_force(docs, rows):
    got = simhash.op1(docs).collect()
    assert len(got) == len(rows)
    prints = sorted({brute(r.text) for r in rows})
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for r in rows:
        k = find(brute(r.text))
        if r.doc_id is not None:
            least[k] = min(least.get(k, r.doc_id), r.doc_id)
    want = sorted((str(r.doc_id), f"{brute(r.text):016x}", str(least.get(find(brute(r.text))))) for r in rows)
    assert sorted((str(g.doc_id), g.fingerprint, str(g.component_id)) for g in got) == want


def test_large_buckets_are_cut_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 8)
    from loomgraph.llm.common import Scratch
    from loomgraph.llm.components import components

    fps = [(i << 1) | (1 << 40) for i in range(200)]
    nodes = spark.createDataFrame([(p, [p]) for p in fps], "node long, fps array<long>")
    found = components(simhash.links(nodes, 4), Scratch(spark, "test")).collect()
    assert {r.root for r in found} == {min(fps)} and len(found) == len(fps) - 1


def test_exploded_keys_and_rows_are_not_broadcast(spark, docs, tmp_path):
    spark.createDataFrame([(p, [p]) for p in range(300)], "node long, fps array<long>").write.parquet(str(tmp_path / "nodes"))
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan(simhash.links(spark.read.parquet(str(tmp_path / "nodes")), 4))
    joins = [x for x in plan(simhash.op1(docs)).splitlines() if "Join" in x]
    assert "SortMergeJoin" in joins[0]


def test_dedup_keeps_one_of_each_group(docs, clashing, empty):
    kept = simhash.dedup(docs).collect()
    texts = [r.text for r in kept]
    assert len(texts) == len(set(texts)) and len(kept) < docs.count()
    out = simhash.dedup(clashing)
    assert out.columns == clashing.columns and out.count() == len(kept)
    assert simhash.dedup(empty).count() == 0 and simhash.op1(empty).count() == 0
