import re
from collections import Counter

from loomgraph.llm import quality_rules as q

W = r"[^\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    w = re.findall(W, text)
    lines = [x for x in text.split("\n") if re.search(W, x)]
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_measures_equal_brute_force(docs, rows, empty):
    got = q.op7(docs).collect()
    assert sorted((str(g[0]), *g[1:7]) for g in got) == sorted((str(r.doc_id), *brute(r.text)) for r in rows)
    assert all(not g.kept for g in got if g.base_failed)
    assert q.op7(empty).count() == 0


def test_order_of_rules_does_not_matter(docs):
    rules = q.default_rules()
    a = q.judge(docs, rules).where("kept").count()
    assert a == q.judge(docs, rules[::-1]).where("kept").count() == q.keep_good(docs).count()


def test_stage_keeps_columns_that_clash(clashing):
    out = q.keep_good(clashing)
    assert out.columns == clashing.columns and out.select("kept").distinct().collect()[0][0] == "kept"


def test_cascade_order_is_by_rejections_per_cost(docs):
    from pyspark.sql import functions as F

    never, always = q.Rule("never", lambda m: F.lit(False), 1), q.Rule("always", lambda m: m.n_words >= 0, 4)
    half = q.Rule("half", lambda m: m.n_words % 2 == 0, 1)
    assert [r.name for r in q.plan_cascade(docs, [never, always, half])] == ["half", "always", "never"]
    assert [r.name for r in q.plan_cascade(docs.where("false"), [never, always])] == ["never", "always"]


def test_stage_equals_brute_force(docs, rows):
    """Rules beside the base ones are left out, so that plain Python gives the whole verdict."""
    kept = sorted(str(r.text) for r in q.keep_good(docs, []).collect())
    assert kept == sorted(str(r.text) for r in rows if not brute(r.text)[-1])
    assert 0 < len(kept) < len(rows)


def test_cascade_stops_at_the_first_rejection(spark):
    """A rule that would fail the job is never evaluated on a document that an earlier rule has rejected."""
    from pyspark.sql import functions as F

    rows = [("few words",), ("w " * 3 + "more different words in this text so that it has enough of them to be let through by rule one",)]
    docs = spark.createDataFrame(rows, "text string")
    first = q.Rule("first", lambda m: m.n_words < 20, 0.01)
    breaks = q.Rule("breaks", lambda m: F.when(m.n_words < 20, F.raise_error(F.lit("evaluated"))).otherwise(F.lit(False)), 9)
    verdict = q._let(q.words(F.col("text")), lambda w: q.cascade([first, breaks], q.lazy(q._text(), w)))
    assert [r[0] for r in docs.select(verdict).collect()] == ["first", None]
