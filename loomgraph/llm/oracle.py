"""DuckDB text for the corpus operators that SQL can express on whole tables."""

W = r"[^\x20\x09-\x0D]+"
WORDS = f"d AS (SELECT row_number() OVER () AS rid, *, regexp_extract_all(coalesce(text, ''), '{W}') AS w FROM documents)"

OP3 = f"""WITH {WORDS},
p AS (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
h AS (SELECT rid, i, sha256(array_to_string(w[i:i + 34], ' ')) AS k FROM p),
r AS (SELECT rid, i FROM h WHERE k IN (SELECT k FROM h GROUP BY k HAVING count(*) > 1)),
c AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS j FROM r),
x AS (SELECT rid, unnest(w) AS v, generate_subscripts(w, 1) AS j FROM d),
k AS (SELECT x.rid, string_agg(v, ' ' ORDER BY x.j) AS t FROM x LEFT JOIN c ON c.rid = x.rid AND c.j = x.j WHERE c.j IS NULL GROUP BY 1),
n AS (SELECT rid, count(*) AS n FROM c GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN n USING (rid) LEFT JOIN k USING (rid)"""

OP7 = f"""WITH {WORDS},
p AS (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8),
h AS (SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS k FROM p),
r AS (SELECT rid, unnest(is_) AS i FROM (SELECT rid, list(i) AS is_ FROM h GROUP BY rid, k HAVING count(*) > 1)),
c AS (SELECT rid, count(DISTINCT j)::BIGINT AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS j FROM r) GROUP BY 1),
m AS (SELECT d.*, coalesce(text, '') AS t, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{W}')) AS lines,
        coalesce(c.n, 0) AS n_repeat_words FROM d LEFT JOIN c USING (rid)),
v AS (SELECT doc_id, t, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(lines) AS n_lines,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_repeat_words,
        len(regexp_extract_all(t, '\\p{{L}}')) AS letters, len(regexp_extract_all(t, '\\p{{Lu}}')) AS capitals, len(regexp_extract_all(t, '!!')) AS shouts FROM m),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM v)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols > 0.5 * n_words OR word_chars NOT BETWEEN 2 * n_words AND 15 * n_words OR 2 * n_dup_lines > n_lines
       OR 2 * letters < word_chars OR 2 * capitals > letters OR 2 * shouts > n_words) AS kept FROM b"""

_ASSIGN = (
    "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
)


def _kind(k: int, pattern: str, group: int) -> str:
    """(rid, k, s, e, v) of a pattern's matches: lengths of the pieces between them and of the matches, added up."""
    return f"""SELECT rid, {k} AS k, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s,
      m[i] AS t, g[i] AS v FROM (SELECT rid, m, p, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT rid, regexp_extract_all(t, '{pattern}') AS m,
      string_split_regex(t, '{pattern}') AS p, regexp_extract_all(t, '{pattern}', {group}) AS g FROM d WHERE regexp_matches(t, '{pattern}')))"""


OP6 = f"""WITH d AS (SELECT row_number() OVER () AS rid, *, coalesce(text, '') AS t FROM documents),
f AS ({_kind(0, _ASSIGN, 2)} UNION ALL {_kind(1, 'AKIA[A-Z0-9]{16,}', 0)} UNION ALL {_kind(2, '[0-9a-f]{24,}', 0)}
  UNION ALL {_kind(3, '[A-Za-z0-9+/_=-]{20,}', 0)}),
a AS (SELECT rid, k, s::BIGINT AS s, (s + length(t))::BIGINT AS e, v FROM f WHERE k IN (1, 2) OR k = 0 AND length(v) >= 6
  OR k = 3 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]')),
u AS (SELECT * FROM a x WHERE k < 3 OR NOT EXISTS (SELECT 1 FROM a y WHERE y.rid = x.rid AND y.k < 3 AND y.s < x.e AND x.s < y.e)),
o AS (SELECT v, count(DISTINCT coalesce(source, chr(1))) AS owners FROM u JOIN d USING (rid) GROUP BY 1),
j AS (SELECT u.*, owners < 3 AS live, ['assign', 'access', 'hex', 'live'][k + 1] || ':' || s || ':' || e AS txt FROM u JOIN o USING (v)),
z AS (SELECT rid, count(*) FILTER (WHERE k = 0) AS n0, count(*) FILTER (WHERE k = 1) AS n1, count(*) FILTER (WHERE k = 2) AS n2,
  coalesce(string_agg(txt, ',' ORDER BY s, k) FILTER (WHERE k < 3), '') AS base, coalesce(string_agg(txt, ',' ORDER BY s, k) FILTER (WHERE k < 3 OR live), '') AS every,
  count(*) FILTER (WHERE live) AS n_live, count(*) FILTER (WHERE NOT live) AS n_example FROM j GROUP BY 1)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(every, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example FROM d LEFT JOIN z USING (rid)"""


def _split(level: int) -> str:
    name = f"concat_ws(':', 'split{level}', coalesce(source, ''), block, CAST(copy AS VARCHAR))"
    return f"""t{level + 1} AS (SELECT source, block, copy, 2 * shard + CASE WHEN 2 * row_number() OVER (PARTITION BY shard ORDER BY md5({name}),
      source IS NULL, source, block, copy) > count(*) OVER (PARTITION BY shard) + 1 THEN 1 ELSE 0 END AS shard FROM t{level})"""


OP4 = f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{W}'))::BIGINT AS size,
    left(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 16) AS key FROM documents),
b AS (SELECT source, left(key, 2) AS block, sum(size)::BIGINT AS words FROM d GROUP BY ALL),
s0 AS (SELECT source, sum(words)::BIGINT AS ss FROM b GROUP BY 1),
s1 AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS wt, 3 * ss AS cap FROM s0),
s2 AS (SELECT *, row_number() OVER o AS pos, (sum(ss) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(wt) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM s1 WINDOW o AS (ORDER BY cap::DOUBLE / wt::DOUBLE, source NULLS LAST)),
s3 AS (SELECT min(pos) AS first FROM s2 WHERE cap::DOUBLE / wt::DOUBLE > level),
s4 AS (SELECT source, ss, CASE WHEN first IS NULL OR pos < first THEN cap::DOUBLE ELSE (SELECT level FROM s2 q WHERE q.pos = first) * wt END AS target FROM s2, s3),
g0 AS (SELECT *, CASE WHEN ss > 0 THEN floor(target / ss) ELSE 0 END::INT AS whole FROM s4),
deck AS (SELECT b.*, md5(concat_ws(':', 'block', coalesce(b.source, ''), block)) AS m, row_number() OVER (PARTITION BY b.source ORDER BY
    md5(concat_ws(':', 'block', coalesce(b.source, ''), block)), block) AS rk FROM b),
g AS (SELECT source, 0::BIGINT AS rk, target - whole * ss AS room, '' AS block, 0 AS flag, 0::BIGINT AS words, '' AS m FROM g0
  UNION ALL SELECT g.source, k.rk, CASE WHEN k.words <= g.room THEN g.room - k.words ELSE g.room END, k.block, (k.words <= g.room)::INT, k.words, k.m
  FROM g JOIN deck k ON k.source IS NOT DISTINCT FROM g.source AND k.rk = g.rk + 1),
e AS (SELECT source, arg_max(room, rk) AS room, arg_min(block, struct_pack(w := words, m := m, b := block)) FILTER (WHERE flag = 0 AND rk > 0) AS cut FROM g GROUP BY 1),
f AS (SELECT g.source, g.block, CASE WHEN g.flag = 1 THEN 1 WHEN g.block = e.cut AND e.room > 0 THEN 2 ELSE 0 END AS flag, e.room
  FROM g JOIN e ON e.source IS NOT DISTINCT FROM g.source WHERE rk > 0),
i AS (SELECT d.source, f.room, key, sum(size)::BIGINT AS words FROM d JOIN f ON f.source IS NOT DISTINCT FROM d.source AND f.block = left(key, 2) AND flag = 2 GROUP BY ALL),
r AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY run) AS upto FROM (SELECT source, room, left(key, 5) AS run, sum(words)::BIGINT AS words FROM i GROUP BY ALL)),
l AS (SELECT source, run, room - upto + words AS room FROM r WHERE upto > room AND upto - words <= room),
n AS (SELECT i.source, i.key, i.words, l.run, l.room, sum(i.words) OVER (PARTITION BY i.source ORDER BY i.key) AS upto
  FROM i JOIN l ON l.source IS NOT DISTINCT FROM i.source AND left(i.key, 5) = l.run),
q AS (SELECT source, coalesce(max(key) FILTER (WHERE upto - words / 2.0 < room), run) AS last_key FROM n GROUP BY source, run),
t0 AS (SELECT f.source, f.block, unnest(range(1, whole + (flag > 0)::INT + 1)) AS copy, 0 AS shard FROM f JOIN g0 ON g0.source IS NOT DISTINCT FROM f.source),
{_split(0)}, {_split(1)}, {_split(2)}, {_split(3)},
x AS (SELECT d.*, ss, target, whole + CASE WHEN flag = 1 OR flag = 2 AND key <= coalesce(last_key, '') THEN 1 ELSE 0 END AS copies
  FROM d JOIN g0 ON g0.source IS NOT DISTINCT FROM d.source JOIN f ON f.source IS NOT DISTINCT FROM d.source AND f.block = left(key, 2)
  LEFT JOIN q ON q.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, ss AS source_size, target, size * copies AS taken, coalesce((SELECT string_agg(CAST(t4.shard AS VARCHAR), ',' ORDER BY copy) FROM t4
  WHERE t4.source IS NOT DISTINCT FROM x.source AND t4.block = left(x.key, 2) AND copy <= x.copies), '') AS shards FROM x"""
