import math
import re
from collections import Counter

from loomgraph.llm import licenses as q


def brute_best(text):
    """Dense TF-IDF cosines over the union of all terms."""
    token = re.compile(r"[a-z0-9]+(?:[.+-][a-z0-9]+)*")
    bags = [Counter(token.findall(t.lower())) for _, t in q.TEMPLATES]
    n = len(bags)
    idf = lambda w: math.log((1 + n) / (1 + sum(w in b for b in bags))) + 1
    mine = Counter(token.findall(text.lower()))
    norm = lambda b: math.sqrt(sum((c * idf(w)) ** 2 for w, c in b.items())) or 1
    return max(sum(c * mine[w] * idf(w) ** 2 for w, c in b.items()) / norm(b) / norm(mine) for b in bags)


def test_cosines_equal_brute_force():
    m = q.Matcher()
    for text in ("Licensed under the Apache License", "licensed under CC BY 4.0 or so", "the the license", "Released under the MIT License."):
        assert abs(m.best(text)[0] - brute_best(text)) < 1e-9
    assert m.scan("x\nThis work is licensed under the GNU General Public License, version 3.")[1] == "GPL-3.0"
    assert m.scan("nothing here") == (0.0, None, False) and m.scan("") == (0.0, None, False)


def test_nearest_ancestor_states_the_licence(spark):
    rows = [
        ("LICENSE", "Released under the MIT License."), ("src/a/LICENSE", "Licensed under CC BY-NC 4.0."), ("src/a/b/c.py", "code"), ("src/d.py", "code"),
        ("src/a/own.py", "Licensed under the Apache License, Version 2.0."), (None, "code"), ("src/a/odd.py", "the license is unclear"), ("e.py", None),
    ]
    docs = spark.createDataFrame([(i, t, p) for i, (p, t) in enumerate(rows)], "doc_id long, text string, path string")
    got = {r.doc_id: r for r in q.inherit(q.notices(docs, docs.path)).collect()}
    assert [got[i].license for i in range(8)] == ["MIT", "CC-BY-NC-4.0", "CC-BY-NC-4.0", "MIT", "Apache-2.0", None, "unknown", "MIT"]
    assert got[2].distance == 1 and got[2].inherited_from == "src/a/LICENSE" and got[3].distance == 1


def test_query(docs, empty):
    got = q.op10(docs).collect()
    assert len(got) == docs.count() and {g.license for g in got if g.doc_id == 220} == {"MIT"}
    assert q.op10(empty).count() == 0


MIT = q.TEMPLATES[1][1]


def test_licence_files_of_any_length_state_their_licence(spark):
    rows = [("a/LICENSE", "Copyright 2020\n" + MIT + " and more terms" * 40), ("a/x.py", "code"), ("b/7", MIT + " " + MIT), ("b/8", "code"), ("c/9", MIT + " other words" * 90), ("c/10", "code")]
    docs = spark.createDataFrame([(i, t, p) for i, (p, t) in enumerate(rows)], "doc_id long, text string, path string")
    found = q.notices(docs, docs.path).cache()
    names, shares = ({r.doc_id: r.license for r in q.inherit(found, named).collect()} for named in (True, False))
    assert names[1] == "MIT" and shares[3] == "MIT" and names[3] is None and shares[5] is None


def test_notices_are_found_anywhere_in_a_text():
    m, words = q.Matcher(), q._TOKEN.findall(MIT.lower())
    wrapped = "\n".join(["code = 1"] * 40 + ["# " + " ".join(words[i : i + 7]) for i in range(0, len(words), 7)] + ["more = 2"] * 40)
    assert m.scan(wrapped)[1] == "MIT"
    line = " ".join(["padding"] * 60) + " Licensed under the Apache License, Version 2.0. " + " ".join(["padding"] * 60)
    assert m.scan(line)[1] == "Apache-2.0"
