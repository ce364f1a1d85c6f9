import hashlib
import random
import re
from collections import Counter

from loomgraph.llm import substrings as q


def brute(texts, length=35):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + length]) for w in split for i in range(len(w) - length + 1))
    out = []
    for w in split:
        gone = {j for i in range(len(w) - length + 1) if seen[tuple(w[i : i + length])] > 1 for j in range(i, i + length)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def check(df):
    rows = df.select("doc_id", "text").collect()
    want = sorted((str(r[0]), *b) for r, b in zip(rows, brute([r[1] for r in rows]), strict=True))
    assert sorted((str(g[0]), *g[1:]) for g in q.op3(df).collect()) == want


def test_fixture(docs, empty):
    check(docs.where("doc_id <> 204 OR doc_id IS NULL"))
    assert q.op3(empty).count() == 0


def test_shifted_overlapping_and_periodic_passages(spark):
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)]
    base = [[rnd.choice(vocabulary) for _ in range(300)] for _ in range(4)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rnd.randint(0, 5)):
            at = rnd.randint(0, 290)
            words += rnd.choice(base)[at : at + rnd.randint(5, 70)] + [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 30))]
        words = ["a"] * rnd.randint(30, 90) if i % 17 == 0 else ["a", "b"] * rnd.randint(10, 50) if i % 19 == 0 else words
        rows.append((i if i % 23 else None, " ".join(words) if i % 29 else None))
    check(spark.createDataFrame(rows + rows[:5], "doc_id long, text string"))
