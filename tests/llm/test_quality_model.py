from pathlib import Path

import pytest

from loomgraph.llm import quality_model as q

DATA = Path("/root/testdata/sf0.01")


def test_features_take_the_whole_text():
    a, b = q.features(b"word " * 50000), q.features(b"word " * 50000 + b"%%% end")
    assert set(a[0]) != set(b[0])
    assert len(q.features(None)[0]) and q.features(None)[0].tolist() == q.features(b"")[0].tolist()


def test_edge_cases(docs, empty, spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (41, None)], "doc_id long, quality int")
    got = q.op2(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= g.score <= 1 and g.predicted == int(g.score >= 0.3) for g in got)
    assert q.op2(empty, labels).count() == 0
    assert {g.score for g in q.op2(docs, labels.where("false")).collect()} == {0.5}


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    got = q.op2(docs, labels).where("held_out").join(labels, "doc_id").collect()
    right = sum(g.predicted == g.quality for g in got)
    assert len(got) > 40 and right / len(got) >= 0.9


def test_votes_equal_brute_force_with_ties():
    """Scores of small models by a plain loop: the 15 nearest by cosine, then by place, weigh with their cosine."""
    import numpy as np

    rnd = np.random.default_rng(1)
    texts = [" ".join(rnd.choice(["alpha", "beta", "Gamma", "delta9", "!!"], rnd.integers(1, 30))).encode() for _ in range(60)]
    texts += texts[:25]  # ties
    labels = rnd.integers(0, 2, len(texts))
    model = q.train([q.features(t) for t in texts], labels)
    asked = [*texts[:20], b"", None, b"unknown words only"]
    got = model.scores([q.features(t) for t in asked])
    for t, s in zip(asked, got, strict=True):
        v = model.embed([q.features(t)])[0]
        near = sorted(((-round(float(np.float32(v @ w)), 5), k) for k, w in enumerate(model.vectors)))[:15]
        weight = [max(-c, 0) for c, _ in near]
        want = sum(w * labels[k] for w, (_, k) in zip(weight, near, strict=True)) / sum(weight)
        assert abs(s - want) < 0.02


def test_repeated_ids_count_once(docs, spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    one = q.fit(docs, labels)
    many = q.fit(docs.unionByName(docs).unionByName(docs), labels.unionByName(labels))
    assert len(one.labels) == len(many.labels) == len({r.doc_id for r in labels.collect() if __import__("zlib").crc32(str(r.doc_id).encode()) % 5})


def test_clashing_columns(clashing, docs, spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    names = ("t", "score", "quality", "held_out", "predicted", "at", "value")
    from pyspark.sql import functions as F

    more = docs.select("*", *[F.lit("x").alias(n) for n in names])
    key = lambda r: str((r.doc_id, r.held_out, round(r.score, 4), r.predicted))
    assert sorted(map(key, q.op2(more, labels).collect())) == sorted(map(key, q.op2(docs, labels).collect()))
