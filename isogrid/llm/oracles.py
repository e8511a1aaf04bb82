"""DuckDB SQL for those queries of the corpus operators that SQL can express."""

from .decontamination import NEAR_SHARE, SLACK, WINDOW
from .divergence import LEAST_DOCS, MOST_TERMS, SCALE
from .lexical_search import MOST_RANKS
from .mixing import MOST_USES, SEED, WEIGHTS
from .sharding import N_SHARDS, TABLE_SIZE, lookup_table, shard_names
from .url_filter import BLOCK_GLOBS, PREFIX_RULES

_WORDS = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)"

OP3 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, CAST({_WORDS} AS BIGINT) AS size, md5('{SEED}' || coalesce(CAST(doc_id AS VARCHAR), '')) AS o FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % {len(WEIGHTS)}
  {' '.join(f'WHEN {n} THEN {w}' for n, w in enumerate(WEIGHTS))} END AS w FROM d GROUP BY source),
r AS (SELECT *, {MOST_USES} * source_size / w AS ratio FROM s),
l AS (SELECT a.ratio, (SELECT sum(source_size) FROM s) - coalesce(sum({MOST_USES} * b.source_size), 0) AS words,
  (SELECT sum(w) FROM s) - coalesce(sum(b.w), 0) AS ws
  FROM r a LEFT JOIN r b ON b.ratio < a.ratio OR (b.ratio = a.ratio AND encode(b.source) < encode(a.source)) GROUP BY a.source, a.ratio),
v AS (SELECT min_by(words / ws, ratio) AS level FROM l WHERE words / ws <= ratio),
t AS (SELECT source, source_size, least(CAST({MOST_USES} * source_size AS DOUBLE), coalesce(w * (SELECT level FROM v), 0)) AS target FROM r),
q AS (SELECT d.*, t.source_size, t.target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY o, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
a AS (SELECT *, CAST(round(target) AS BIGINT) AS goal, use * source_size + b AS start FROM q CROSS JOIN range({MOST_USES}) u(use)),
p AS (SELECT r, o, doc_id, size, use, least(size, goal - start) AS words, CAST(least(start + size, goal) AS DOUBLE) / goal AS finish FROM a WHERE size > 0 AND start < goal
  UNION ALL SELECT r, o, doc_id, size, use, start + size - goal, CAST(start + size AS DOUBLE) / goal FROM a WHERE size > 0 AND start < goal AND start + size > goal
  UNION ALL SELECT r, o, doc_id, size, 0, 0, NULL FROM q)
SELECT doc_id, source, size, source_size, target, taken, CASE WHEN target > 0 AND size > 0 THEN (b + size) / target END AS first_finish FROM q
JOIN (SELECT r, CAST(sum(greatest(0, least(words, budget - ahead))) AS BIGINT) AS taken FROM (
  SELECT r, words, (SELECT sum(source_size) FROM s) AS budget, coalesce(sum(words) OVER (ORDER BY finish, o, doc_id, size, use ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM p) GROUP BY r) USING (r)
"""

_ORDER = sorted(range(len(PREFIX_RULES)), key=lambda r: (-len(PREFIX_RULES[r][1] + PREFIX_RULES[r][2]), PREFIX_RULES[r][0] != "block", r))
_FITS = {r: f"((host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '{p}'))" for r, (_, h, p) in enumerate(PREFIX_RULES)}
_HOSTS = [g for g in BLOCK_GLOBS if "/" not in g and "." not in g]
_like = lambda g: "".join({"*": "[\\s\\S]*", "^": "[^/]*", ".": "\\."}.get(c, c) for c in g)
_BAD = " OR ".join(f"regexp_full_match(host || path, '{_like(g)}')" for g in [*(g + "/*" for g in _HOSTS), *BLOCK_GLOBS])
OP5 = f"""
WITH c AS (SELECT page_id, regexp_matches(url, '://') AS ok, regexp_extract(url, '://([^/?#]*)([^?#]*)', 1) AS h, regexp_extract(url, '://([^/?#]*)([^?#]*)', 2) AS p FROM pages),
u AS (SELECT page_id, translate(coalesce(h, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(p, '') AS path FROM c)
SELECT page_id, host, path, CASE {' '.join(f"WHEN {_FITS[r]} THEN '{PREFIX_RULES[r][1] + PREFIX_RULES[r][2]}'" for r in _ORDER)} END AS rule,
  CASE {' '.join(f"WHEN {_FITS[r]} THEN '{PREFIX_RULES[r][0]}'" for r in _ORDER)} WHEN {_BAD} THEN 'block' ELSE 'allow' END AS verdict FROM u
"""

_TABLE = ",".join(map(str, lookup_table(shard_names(N_SHARDS))))
OP6 = f"""
WITH t AS (SELECT string_split('{_TABLE}', ',') AS shards),
k AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {TABLE_SIZE} AS INT) AS slot FROM documents)
SELECT doc_id, slot, CAST((SELECT shards FROM t)[slot + 1] AS INT) AS shard FROM k
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORD_TERMS} AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORD_TERMS} AS ws FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(ws), {WINDOW}) AS n, array_to_string(ws[s:s + {WINDOW - 1}], ' ') AS w FROM (SELECT item, ws, unnest(range(1, greatest(1, len(ws) - {WINDOW - 1}) + 1)) AS s FROM b WHERE len(ws) > 0)),
dp AS (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS s FROM d),
m AS (SELECT r, s, n, item FROM (SELECT r, s, n, array_to_string(ws[s:s + n - 1], ' ') AS w FROM dp CROSS JOIN (SELECT DISTINCT n FROM bw) WHERE s + n - 1 <= len(ws)) JOIN bw USING (n, w)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT r, s, n FROM m)) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY encode(item)) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r),
wp AS (SELECT w, unnest(string_split(w, ' ')) AS t, unnest(range(n)) AS o, n FROM (SELECT DISTINCT w, n FROM bw)),
ps AS (SELECT r, s, ws[s] AS t, len(ws) AS nw FROM dp WHERE ws[s] IN (SELECT t FROM wp)),
rk AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY c, o) AS k FROM (SELECT wp.*, c, count(*) OVER (PARTITION BY w) AS held FROM wp JOIN (SELECT t, count(*) AS c FROM ps GROUP BY t) USING (t)) WHERE held = n),
an AS (SELECT w, n, r, s - o AS st FROM rk JOIN ps USING (t) WHERE k = 1 AND s - o >= 1 - {SLACK} AND s - o + n - 1 <= nw + {SLACK}),
mt AS (SELECT an.w, an.n, an.r, an.st, rk.k, min(abs(ps.s - an.st - rk.o)) AS f FROM an JOIN rk ON rk.w = an.w AND rk.k > 1 JOIN ps ON ps.r = an.r AND ps.t = rk.t AND abs(ps.s - an.st - rk.o) <= {SLACK} GROUP BY ALL),
nr AS (SELECT w, r FROM (SELECT w, n, r, st, count(*) + 1 AS found FROM mt GROUP BY ALL HAVING min(k) = 2) WHERE found >= {NEAR_SHARE} * n UNION SELECT w, r FROM an WHERE n = 1),
ni AS (SELECT r, count(DISTINCT item) AS n_near FROM nr JOIN bw USING (w) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near_items
FROM d LEFT JOIN h USING (r) LEFT JOIN i USING (r) LEFT JOIN ni USING (r)
"""

_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP12 = f"""
WITH d AS (SELECT * FROM (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ws FROM documents) WHERE len(ws) > 0),
s AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(len(ws)) AS BIGINT) AS l FROM d),
q AS (SELECT k, item_id, t, CAST(count(*) AS BIGINT) AS times FROM (SELECT row_number() OVER () AS k, item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY ALL),
p AS (SELECT r, doc_id, t, n, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, doc_id, CAST(len(ws) AS BIGINT) AS n, unnest(ws) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000*ln(CAST(2*(SELECT nd FROM s) + 2 AS DOUBLE)/CAST(2*count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p GROUP BY t),
g AS (SELECT r, doc_id, t, w*((1000000000*tf)//(1000*tf + 12*(75 + (25*n*(SELECT nd FROM s))//(SELECT l FROM s)))) AS gain FROM p JOIN w USING (t)),
c AS (SELECT k, item_id, r, doc_id, CAST(sum(times*gain) AS BIGINT) AS score FROM q JOIN g USING (t) GROUP BY k, item_id, r, doc_id)
SELECT item_id, rank, doc_id, score FROM (SELECT item_id, CAST(row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id NULLS FIRST) AS INT) AS rank, doc_id, score FROM c WHERE score > 0) WHERE rank <= {MOST_RANKS}
"""

_LETTERS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"
OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LETTERS} AS ws FROM documents),
t AS (SELECT r, lang, source, unnest(ws) AS t FROM d),
k AS (SELECT lang, t FROM t GROUP BY lang, t HAVING count(DISTINCT r) >= {LEAST_DOCS}),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
gr AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, t, count(*) AS c FROM t JOIN k USING (lang, t) GROUP BY ALL),
n AS (SELECT lang, source, CAST(coalesce(sum(c), 0) AS HUGEINT) AS n FROM gr LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT gr.lang, gr.source, k.t, coalesce(c.c, 0) AS c, 1 + ({SCALE}*CAST(coalesce(c.c, 0) + 1 AS HUGEINT))//(n.n + v.v) AS p
  FROM gr JOIN k USING (lang) JOIN v USING (lang) JOIN n USING (lang, source) LEFT JOIN c ON c.lang = gr.lang AND c.source = gr.source AND c.t = k.t),
l AS (SELECT lang, t, 1 + ({SCALE}*CAST(sum(c) + 1 AS HUGEINT))//((SELECT sum(n.n) FROM n WHERE n.lang = p.lang) + any_value(v.v)) AS q FROM p JOIN v USING (lang) GROUP BY lang, t),
pr AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p)*(a.p - b.p)//b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM gr a JOIN gr b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pr ON pr.lang = a.lang AND pr.source = a.source AND pr.item = b.source
  UNION ALL SELECT lang, source, 'term', t, (p - q)*(p - q)//q FROM p JOIN l USING (lang, t) WHERE c > 0 AND p > q)
SELECT * FROM (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INT) AS rank FROM x) WHERE part = 'pair' OR rank <= {MOST_TERMS}
"""

ORACLES = {"op6_sharding": OP6, "op3_mixing": OP3, "op5_url_filter": OP5, "op11_decontamination": OP11, "op12_lexical_search": OP12, "op13_source_divergence": OP13}
