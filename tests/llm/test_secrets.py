import hashlib
import re

from loomgraph.llm import secrets as q


def brute(text):
    text = text or ""
    words = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    kinds = (
        ("assign", rf"(?:{words})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[1]) >= 6),
        ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24),
    )
    out = [(m.start(), i, k, m.end()) for i, (k, p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m)]
    return ",".join(f"{k}:{a}:{z}" for a, _, k, z in sorted(out))


def test_base_spans_equal_brute_force(docs, rows, empty):
    got = q.op6(docs).collect()
    want = sorted((str(r.doc_id), hashlib.sha256(brute(r.text).encode()).hexdigest()) for r in rows)
    assert sorted((str(g.doc_id), g.base_sha256) for g in got) == want
    assert q.op6(empty).count() == 0


def test_ownership_parts_examples_from_live_tokens(docs):
    got = {g.doc_id: g for g in q.op6(docs).where("doc_id BETWEEN 207 AND 212").collect()}
    assert all(got[i].spans == "" and got[i].n_example == 1 for i in range(209, 213))
    text = docs.where("doc_id = 208").first().text
    at = text.index("Zz9")
    assert got[208].spans.endswith(f"live:{at}:{len(text)}") and got[208].n_live == 5
    assert got[207].n_assign == 2


def test_redaction(docs, clashing, empty):
    out = {r.doc_id: r for r in q.redact(docs, "n_chars").where("doc_id IN (200, 207, 209)").collect()}
    assert "abc123" not in out[207].text and "xyzxyz12" not in out[207].text and out[207].n_chars == len(out[207].text)
    assert out[200].text is None and out[209].text.startswith("see Ex4mple")
    assert q.redact(docs).count() == docs.count() and q.redact(clashing).columns == clashing.columns
    assert q.redact(empty).count() == 0


def test_verdict_follows_owners_and_repositories_in_bulk(spark):
    """600 tokens over 1 to 4 owners with 1 to 4 repositories each, against plain Python counts."""
    import random

    rnd, rows, held = random.Random(8), [], {}
    for k in range(600):
        token = f"Tk{k:04d}" + "".join(rnd.choice("ABCdef123") for _ in range(24))
        for owner in rnd.sample(["o1", "o2", "o3", "o4"], rnd.randint(1, 4)):
            for lang in rnd.sample(["en", "de", "fr", "es"], rnd.randint(1, 4)):
                for _ in range(rnd.randint(1, 2)):
                    rows.append((len(rows), f"key {token} end", lang, owner, 1))
                    held.setdefault(token, set()).add((owner, lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = {g.doc_id: g for g in q.op6(docs).collect()}
    verdicts = set()
    for i, text, *_ in rows:
        token = text.split()[1]
        owners = len({o for o, _ in held[token]})
        live = owners == 1 or (owners == 2 and len(held[token]) < 5)
        verdicts.add((owners, live))
        assert got[i].spans == (f"live:4:{4 + len(token)}" if live else "") and got[i].n_live == int(live) and got[i].n_example == int(not live)
    assert verdicts == {(1, True), (2, True), (2, False), (3, False), (4, False)}
