import zlib
from collections import defaultdict

import pytest

from loomgraph.llm import sharding as q


def brute_moved(supply, capacity):
    """Staying costs nothing, so the least moved is what exceeds a shard's own capacity."""
    return sum(max(0, s - (capacity[i] if i < len(capacity) else 0)) for i, s in enumerate(supply))


@pytest.mark.parametrize("supply,capacity", [([10, 0, 5], [5, 5, 5]), ([7, 7], [4, 4, 6]), ([3, 9, 1], [13]), ([], [0, 0]), ([100, 1], [51, 50])])
def test_flow_is_complete_and_moves_the_least(supply, capacity):
    flow = q.min_cost_flow(supply, capacity, lambda i, j: int(i != j))
    for i, s in enumerate(supply):
        assert sum(u for (a, _), u in flow.items() if a == i) == s
    for j, c in enumerate(capacity):
        assert sum(u for (_, b), u in flow.items() if b == j) <= c
    assert sum(u for (i, j), u in flow.items() if i != j) == brute_moved(supply, capacity)


def test_slots_sizes_and_balance(docs, rows, empty):
    got = q.op9(docs.where("doc_id <> 204 OR doc_id IS NULL")).collect()
    sizes = {str(r.doc_id): (len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in rows if r.doc_id is not None}
    by = defaultdict(list)
    for g in got:
        if g.doc_id is not None:
            assert (g.size, g.text_crc32) == sizes[str(g.doc_id)]
        by[g.shard].append(g)
    for shard in by.values():
        assert sorted(g.slot for g in shard) == list(range(len(shard)))
    longest = max(g.size for g in got)
    total = [sum(g.size for g in by[s]) for s in range(16)]
    assert max(total) - min(total) <= 2 * longest and q.op9(empty).count() == 0


def test_rewrite_touches_only_affected_shards(spark, docs, tmp_path):
    placed = q.reshard(q.sized(docs), 4)
    affected = q.rewrite(placed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {r.shard for r in back.select("shard").distinct().collect()} <= set(affected)
    assert back.count() == placed.where(placed.shard.isin(affected)).count()


def test_rewritten_files_hold_whole_documents_and_retired_shards_go(spark, docs, tmp_path):
    from pyspark.sql import functions as F

    path, sized = str(tmp_path / "out"), q.sized(docs)
    old = sized.select("document", F.lit(0).cast("long").alias("slot"), F.col("old_shard").alias("shard"))
    old.write.partitionBy("shard").parquet(path)
    placed = q.reshard(sized, 4)
    affected = q.rewrite(placed, path)
    assert set(range(4, 12)) <= set(affected)
    back = spark.read.parquet(path)
    assert sorted(map(str, back.select("document.*").collect())) == sorted(map(str, docs.collect()))
    assert {r.shard for r in back.select("shard").distinct().collect()} == set(range(4))


def test_query_reads_the_rewritten_files(docs, monkeypatch):
    paths, rewrite = [], q.rewrite
    monkeypatch.setattr(q, "rewrite", lambda placed, path: paths.append(path) or rewrite(placed, path))
    out = q.op9(docs)
    assert len(paths) == 1 and any(f"{paths[0]}/shard=" in f for f in out.inputFiles())
