"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from tidemill.llm import quality, urlgraph
from tidemill.llm.queries import SHARD_BYTES, URL_RULES

SEP = r"[ \t\n\x0b\f\r]"


def shards() -> str:
    return f"""
WITH d AS (SELECT doc_id, (16 + coalesce(strlen(text), 0) + coalesce(strlen(lang), 0) + coalesce(strlen(source), 0))::BIGINT AS n_bytes, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT t.depth, h >> (60 - t.depth)::INT AS p, sum(n_bytes)::BIGINT AS n FROM d, (SELECT unnest(range(0, 61))::INT AS depth) t GROUP BY ALL),
leaf AS (SELECT a.* FROM s a LEFT JOIN s b ON b.depth = a.depth - 1 AND b.p = a.p >> 1
         WHERE (a.n <= {SHARD_BYTES} OR a.depth = 60) AND (a.depth = 0 OR b.n > {SHARD_BYTES}))
SELECT doc_id, n_bytes, depth, right(lpad(bin(p), 60, '0'), depth) AS shard, n AS shard_bytes
FROM d JOIN leaf ON d.h >> (60 - leaf.depth)::INT = leaf.p"""


#: Rounds of the SQL for scores that have settled: 0.85 ** 96 is below 2e-7.
SETTLED = 96


def urls() -> str:
    rules = sorted(URL_RULES, key=lambda r: (-len(r), r))
    fits = lambda host, path: {r: f"(({host} = '{r.partition('/')[0]}' OR ends_with({host}, '.{r.partition('/')[0]}')) AND starts_with({path}, '/{r.partition('/')[2]}'))" for r in rules}
    rule = lambda host, path: "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for r, c in fits(host, path).items()) + " END"
    root = "CASE WHEN path = '' THEN '/' ELSE path END"
    allow = ", ".join(f"'{r}'" for r in rules if URL_RULES[r] == "allow")
    link = urlgraph.TARGET.replace("'", "''")
    up, low, d = urlgraph.UPPER, urlgraph.LOWER, urlgraph.DAMPING
    counts = f"count(*) AS n, count(*) FILTER (WHERE rr IN ({allow})) AS allowed, count(*) FILTER (WHERE rr IS NOT NULL AND rr NOT IN ({allow})) AS blocked"
    steps = "".join(
        f""",
r{k + 1} AS MATERIALIZED (SELECT seed.host, seed.kind, seed.seed + seed.open * {d} * coalesce(m.v, 0) AS s FROM seed LEFT JOIN
  (SELECT a AS host, shares.kind, sum(s * share) AS v FROM shares JOIN r{k} ON r{k}.host = b AND r{k}.kind = shares.kind GROUP BY ALL) m USING (host, kind))"""
        for k in range(SETTLED)
    )
    return f"""
WITH u AS (SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
v AS (SELECT page_id, html, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
w AS (SELECT page_id, html, translate(raw, '{up}', '{low}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM v),
p AS MATERIALIZED (SELECT *, {rule("host", "path")} AS rule, {rule("host", root)} AS rr FROM w),
names AS (SELECT DISTINCT host FROM p WHERE host <> ''),
t AS (SELECT host AS src, unnest(regexp_extract_all(html, '{link}', 1)) AS rest FROM p WHERE host <> ''),
tv AS (SELECT src, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM t),
tw AS (SELECT src, translate(raw, '{up}', '{low}') AS dst, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM tv),
links AS (SELECT src, dst, {rule("dst", root)} AS rr FROM tw WHERE dst <> '' AND dst <> src),
fam AS (SELECT host AS h, regexp_replace(host, '^[^.]*\\.', '') AS q FROM names WHERE regexp_replace(host, '^[^.]*\\.', '') IN (SELECT host FROM names) AND regexp_replace(host, '^[^.]*\\.', '') <> host),
edges AS (SELECT src, dst, sum(w)::DOUBLE AS w FROM (SELECT src, dst, 1 AS w FROM links UNION ALL SELECT h, q, 1 FROM fam UNION ALL SELECT q, h, 1 FROM fam) GROUP BY ALL),
own AS (SELECT host, {counts} FROM p WHERE host <> '' GROUP BY host),
known AS (SELECT * FROM own UNION ALL SELECT dst, {counts} FROM links WHERE dst NOT IN (SELECT host FROM own) GROUP BY dst),
hosts AS (SELECT coalesce(known.host, e.host) AS host, coalesce(allowed / n, 0) AS trust, coalesce(blocked / n, 0) AS distrust FROM known FULL JOIN (SELECT src AS host FROM edges UNION SELECT dst FROM edges) e ON e.host = known.host),
seed AS MATERIALIZED (SELECT host, 'trust' AS kind, trust AS seed, 1 - trust - distrust AS open FROM hosts UNION ALL SELECT host, 'distrust', distrust, 1 - trust - distrust FROM hosts),
takes AS (SELECT src AS a, dst AS b, w, 'distrust' AS kind FROM edges UNION ALL SELECT dst, src, w, 'trust' FROM edges),
shares AS MATERIALIZED (SELECT a, b, kind, w / sum(w) OVER (PARTITION BY a, kind) AS share FROM takes),
r0 AS (SELECT host, kind, seed AS s FROM seed){steps},
bad AS (SELECT t.host FROM r{SETTLED} t JOIN r{SETTLED} x ON t.host = x.host AND t.kind = 'trust' AND x.kind = 'distrust' WHERE round(x.s, 9) >= {urlgraph.DISTRUST} AND round(x.s, 9) > round(t.s, 9))
SELECT page_id, host, path, rule, CASE WHEN rule IN ({allow}) THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END AS verdict FROM p"""


def near_duplicates() -> str:
    return r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, s FROM (
  SELECT doc_id, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS s FROM w WHERE len(ws) >= 3
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 2)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pairs JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
least AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, least(doc_id, coalesce(m, doc_id)) = doc_id AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)"""


def quality_rules() -> str:
    stop = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
    bad = []
    for r in quality.RULES:
        a, b = quality.RATIOS.get(r.metric, (r.metric, None))
        value = f"(CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0 END)" if b else a
        bad += [f"{value} < {r.least}"] * (r.least is not None) + [f"{value} > {r.most}"] * (r.most is not None)
    return rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '{SEP}+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (length(t) - length(replace(t, '!', '')))::BIGINT AS n_exclaims,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0b\f\r]')) AS ls, len(list_filter(ws, lambda x: lower(x) IN ({stop}))) AS n_stop_words FROM w),
f AS (SELECT m.*, len(ls) AS n_text_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM m LEFT JOIN cov USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR {" OR ".join(bad)}) AS kept FROM f"""


def warc() -> str:
    return """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS f FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN f = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN f = page_id THEN NULL ELSE f END AS refers_to FROM q"""


LOWER_AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def collocations() -> str:
    return rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({LOWER_AZ}, '[.,;:!?\n\x0b\f\r]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i : i + k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3)) t(k)),
f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS n FROM g GROUP BY ALL),
total AS (SELECT lang, sum(n) AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND n >= 10),
cuts AS (SELECT lang, phrase, a, j, array_to_string(ws[1 : j], ' ') AS lp, array_to_string(ws[j + 1 : k], ' ') AS rp FROM c, (VALUES (1), (2)) t(j) WHERE j < k),
s AS (SELECT cuts.lang, cuts.phrase, a, j, x.n AS l, y.n AS r, (1000000::HUGEINT * a * a) // (x.n * y.n) AS score FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = lp JOIN f y ON y.lang = cuts.lang AND y.phrase = rp),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
longer AS (SELECT lang, phrase, max(a) AS b FROM (SELECT lang, unnest([array_to_string(ws[1 : 2], ' '), array_to_string(ws[2 : 3], ' ')]) AS phrase, a FROM c WHERE k = 3) GROUP BY ALL),
kept AS (SELECT m.*, row_number() OVER (PARTITION BY m.lang ORDER BY score DESC, a DESC, m.phrase) AS rank FROM m LEFT JOIN longer USING (lang, phrase) WHERE b IS NULL OR 100 * b < 50 * a)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM kept JOIN total USING (lang) WHERE rank <= 2000"""


def variants() -> str:
    return rf"""
WITH RECURSIVE bits(i, k, c) AS (SELECT i, 0, i FROM range(256) x(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({LOWER_AZ}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 6 GROUP BY ALL),
hexed AS (SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM hexed, crc),
v AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed) WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
less AS (SELECT word, i, left(word, i) || substr(word, i + 2) AS d FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
near AS (SELECT a.word, b.word AS other FROM less a JOIN less b ON a.d = b.d AND a.i = b.i AND a.word <> b.word UNION SELECT less.word, d FROM less JOIN v ON v.word = d UNION SELECT d, less.word FROM less JOIN v ON v.word = d),
best AS (SELECT near.word, count(*) AS n_near, first(other ORDER BY v.n DESC, other) AS form, max(v.n) AS form_n FROM near JOIN v ON v.word = other GROUP BY 1),
up AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN form_n >= 5 * v.n THEN form END AS form, CASE WHEN form_n >= 5 * v.n THEN form_n END AS form_n FROM v LEFT JOIN best USING (word)),
walk(word, at_) AS (SELECT word, word FROM up UNION ALL SELECT walk.word, up.form FROM walk JOIN up ON up.word = at_ WHERE up.form IS NOT NULL),
root AS (SELECT walk.word, at_ AS root FROM walk JOIN up ON up.word = at_ WHERE up.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM up JOIN root USING (word)"""


def oracle_sql() -> dict[str, str]:
    return {"op2_shards": shards(), "op7_urls": urls(), "op8_neardup": near_duplicates(), "op9_quality": quality_rules(), "op10_warc": warc(), "op12_collocations": collocations(), "op13_variants": variants()}
