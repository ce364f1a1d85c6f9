from collections import defaultdict

from loomgraph.llm import mixing as q


def test_targets_and_words_taken(docs, rows, empty):
    got = q.op4(docs).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += len((r.text or "").encode().split())
    total = sum(sizes.values())
    weights = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    target, free = {}, set(sizes)
    left = total
    while True:
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        above = {s for s in free if share[s] > 3 * sizes[s]}
        if not above:
            target |= share
            break
        target |= {s: 3 * sizes[s] for s in above}
        free -= above
        left = total - sum(target.values())
    by_size = {v: k for k, v in sizes.items()}
    taken = defaultdict(int)
    for g in got:
        s = by_size[g.source_size]
        assert abs(g.target - target[s]) < 1e-6 * max(1, target[s]) and g.taken <= 3 * g.size
        taken[s] += g.taken
    longest = max(g.size for g in got)
    assert all(abs(taken[s] - target[s]) <= longest / 2 + 1 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, q.op4(docs.repartition(3)).collect()))
    assert q.op4(empty).count() == 0


def test_mix_deals_every_copy_once(docs, clashing, empty):
    planned = q.op4(docs).collect()
    copies = sum(len(g.shards.split(",")) for g in planned if g.shards)
    out = q.mix(docs)
    assert out.columns == docs.columns and out.count() == copies
    assert q.mix(clashing).columns == clashing.columns and q.mix(empty).count() == 0


def test_split_tree_halves_are_exact(spark):
    from collections import Counter

    slots = spark.createDataFrame([(s, f"{b:02x}", 1) for s, n in (("a", 40), ("b", 24)) for b in range(n)], "source string, block string, copy int")
    got = q.split_tree(slots, 3).collect()
    assert set(Counter(r.shard for r in got).values()) == {8}


def test_parts_follow_the_words():
    assert q.parts_for(0, 16) == q.parts_for(1000, 16) == 1
    assert q.parts_for(16 * 16_000_000 * 400, 16) == 400
