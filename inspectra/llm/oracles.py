"""DuckDB SQL for the queries that SQL can express; the others are tested against brute force in tests/llm.

op2 is sequential within a shard, op3 and op10 train models, op8 and op12 need a tokenizer, op9 an HTML parser and op11
eigenvectors.
"""

from __future__ import annotations

from statistics import NormalDist

from .licenses import TEMPLATES, THRESHOLD, Known
from .mixing import BLOCK, SHARD_WORDS
from .quality import LIFT, PROBABILITY

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_KNOWN = Known(TEMPLATES, THRESHOLD)
_LICENSES = ", ".join(f"({k}, '{name}', {n}, {len(pairs)})" for k, (name, n, pairs) in enumerate(_KNOWN.rows))
_PAIRS = ", ".join(f"({k}, '{p}')" for k, (_, _, pairs) in enumerate(_KNOWN.rows) for p in pairs)
_ANCHORS = ", ".join(f"('{p}', {k}, {place})" for p, at in _KNOWN.anchors.items() for k, place in at)

OP1 = rf"""
WITH t(k, name, n, np) AS (VALUES {_LICENSES}), tp(k, p) AS (VALUES {_PAIRS}), an(p, k, place) AS (VALUES {_ANCHORS}),
d AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g') AS n, row_number() OVER () AS r FROM documents),
s AS (SELECT r, seg, seg = n AS whole, row_number() OVER () AS s FROM (SELECT r, n, unnest(list_distinct(list_concat([n], regexp_split_to_array(n, '\n(?: *\n)+'), string_split(n, chr(10))))) AS seg FROM d)),
w AS (SELECT r, s, whole, list_filter(regexp_split_to_array(seg, '[ \n]+'), lambda x: x <> '') AS w FROM s),
u AS (SELECT r, s, whole, unnest(w) AS x, unnest(range(0, len(w))) AS i FROM w),
b AS (SELECT r, s, whole, i, x || ' ' || lead(x) OVER (PARTITION BY s ORDER BY i) AS p FROM u QUALIFY p IS NOT NULL),
sn AS (SELECT r, s, count(DISTINCT p) AS n FROM b GROUP BY 1, 2),
sh AS (SELECT b.s, tp.k, count(DISTINCT b.p) AS shared FROM b JOIN tp USING (p) GROUP BY 1, 2),
sm AS (SELECT r, s, name, 2.0::DOUBLE * shared / (sn.n + t.np) AS dice FROM sh JOIN sn USING (s) JOIN t USING (k)),
segs AS (SELECT r, arg_min(name, {{'d': -dice, 'n': name}}) AS name, max(dice) AS dice FROM sm WHERE dice >= {THRESHOLD}::DOUBLE GROUP BY r, s),
st AS (SELECT DISTINCT r, s, k, greatest(i - place, 0) AS frm FROM b JOIN an USING (p) WHERE whole),
wp AS (SELECT st.r, st.k, st.frm, t.name, t.n, t.np, b.p FROM st JOIN t USING (k) JOIN b ON b.s = st.s AND b.i >= st.frm AND b.i < st.frm + t.n),
wd AS (SELECT r, wp.k, frm, name, n, 2.0::DOUBLE * count(DISTINCT tp.p) / (count(DISTINCT wp.p) + np) AS dice FROM wp LEFT JOIN tp ON tp.k = wp.k AND tp.p = wp.p GROUP BY r, wp.k, frm, name, n, np),
wb AS (SELECT r, name, frm, frm + n AS fin, -dice AS minus, k, {{'minus': -dice, 'name': name, 'k': k, 'frm': frm}} AS ord FROM wd WHERE dice >= {THRESHOLD}::DOUBLE QUALIFY row_number() OVER (PARTITION BY r, k ORDER BY -dice, frm) = 1),
wins AS (SELECT r, name, -minus AS dice FROM wb x WHERE NOT EXISTS (SELECT 1 FROM wb y WHERE y.r = x.r AND y.frm < x.fin AND x.frm < y.fin AND y.ord < x.ord)),
best AS (SELECT * FROM segs UNION ALL SELECT * FROM wins),
f AS (SELECT r, arg_min(name, {{'d': -dice, 'n': name}}) AS license, round(max(dice), 6) AS dice, count(*) AS n_matches, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses FROM best GROUP BY 1)
SELECT doc_id, license, dice, coalesce(n_matches, 0) AS n_matches, coalesce(licenses, '') AS licenses FROM d LEFT JOIN f USING (r)
"""

OP4 = f"""
WITH sized AS (SELECT doc_id, source, len({WORDS}) AS size, ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 15))::BIGINT AS ord FROM documents),
s AS (SELECT source IS NULL AS none, coalesce(source, '') AS src, sum(size)::BIGINT AS source_size FROM sized GROUP BY 1, 2),
w AS (SELECT *, row_number() OVER (ORDER BY none, src) AS rank, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY none, src) - 1) % 3) + 1]::DOUBLE AS weight FROM s),
l AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS fill FROM w),
o AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - (sum(cap) OVER u - cap)) / sum(weight) OVER v AS level FROM l WINDOW u AS (ORDER BY fill, rank ROWS UNBOUNDED PRECEDING), v AS (ORDER BY fill, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
water AS (SELECT arg_min(level, {{'f': fill, 'r': rank}}) AS water FROM o WHERE fill > level),
t AS (SELECT none, src, source_size, CASE WHEN fill <= level OR water IS NULL THEN cap ELSE least(water * weight, cap) END AS target FROM o, water),
c AS (SELECT none, src, unnest(range(0, (2 * target / {BLOCK})::BIGINT + 3)) AS k, target FROM t),
q AS (SELECT none, src, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, none, src, k) <= (SELECT round(sum(target) / {BLOCK}) FROM t) AND target > 0 AS won FROM c),
seats AS (SELECT none, src, count(*) FILTER (won) AS quota FROM q GROUP BY 1, 2),
dealt AS (SELECT d.*, t.*, quota, (ord // 64) % greatest(ceil(source_size / {SHARD_WORDS}), 1)::BIGINT AS shard FROM sized d JOIN t ON (d.source IS NULL) = t.none AND coalesce(d.source, '') = t.src JOIN seats USING (none, src)),
shards AS (SELECT none, src, shard, quota, sum(size)::BIGINT AS held FROM dealt GROUP BY ALL),
c2 AS (SELECT *, unnest(range(0, 2 * quota + 3)) AS k FROM shards),
won AS (SELECT none, src, shard, held, count(*) FILTER (nth <= quota AND held > 0) AS won FROM (SELECT *, row_number() OVER (PARTITION BY none, src ORDER BY held::DOUBLE / (2 * k + 1) DESC, shard, k) AS nth FROM c2) GROUP BY ALL),
laid AS (SELECT d.*, held, won, greatest(ceil(held / {BLOCK}), 1)::BIGINT AS n, sum(size) OVER (PARTITION BY none, src, shard ORDER BY ord, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS frm FROM dealt d JOIN won USING (none, src, shard))
SELECT doc_id, size, source_size, target, least(won // n * size + greatest(least(least(won % n * {BLOCK}, held) - frm, size), 0), 2 * size)::BIGINT AS taken FROM laid
"""

OP5 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS sh FROM d),
n AS (SELECT doc_id, len(sh) AS n FROM s), e AS (SELECT doc_id, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 75 * (na.n + nb.n - shared)),
g AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS root FROM n UNION SELECT g.b, r.root FROM r JOIN g ON g.a = r.id)
SELECT n.doc_id, n.n AS n_shingles, m.component_id FROM n JOIN (SELECT id, min(root) AS component_id FROM r GROUP BY 1) m ON m.id = n.doc_id
"""

OP6 = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {WORDS} AS w, row_number() OVER () AS r FROM documents),
u AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
win AS (SELECT r, i, x || ' ' || lead(x) OVER o || ' ' || lead(x, 2) OVER o AS k FROM u WINDOW o AS (PARTITION BY r ORDER BY i)),
rep AS (SELECT r, i, k IS NOT NULL AND count(*) OVER (PARTITION BY r, k) > 1 AS again FROM win),
cov AS (SELECT r, count(*) FILTER (c) AS n_repeat_words FROM (SELECT r, again OR coalesce(lag(again) OVER o, false) OR coalesce(lag(again, 2) OVER o, false) AS c FROM rep WINDOW o AS (PARTITION BY r ORDER BY i)) GROUP BY 1),
ln AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines FROM (SELECT r, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY 1),
m AS (SELECT doc_id, source, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, greatest(len(w), 1) AS n FROM d LEFT JOIN cov USING (r) LEFT JOIN ln USING (r)),
f AS (SELECT *, coalesce(source, '') AS host, source IS NULL AS none, NOT (word_chars / n BETWEEN 2.5::DOUBLE AND 12) AS f1, 10 * n_symbols > n AS f2, 10 * n_dup_lines > 3 * n_lines AS f3, 10 * n_repeat_words > 2 * n AS f4 FROM m),
x AS (SELECT none, host, rule, count(*) AS n, count(*) FILTER (bad) AS k FROM (SELECT none, host, unnest([1, 2, 3, 4]) AS rule, unnest([f1, f2, f3, f4]) AS bad FROM f) GROUP BY ALL),
g AS (SELECT rule, sum(n)::DOUBLE AS big, sum(n::DOUBLE * n) AS n2, count(*) - 1 AS noise, sum(k)::DOUBLE / sum(n) AS m, sum(k::DOUBLE * k / n) AS ks FROM x GROUP BY 1),
p AS (SELECT rule, m, CASE WHEN m > 0 AND m < 1 AND big - n2 / big - noise > 0 THEN least(greatest(((ks - big * m * m) / (m * (1 - m)) - noise) / (big - n2 / big - noise), 1 / 1001.0::DOUBLE), 0.5::DOUBLE) ELSE 1 / 1001.0::DOUBLE END AS rho FROM g),
y AS (SELECT none, host, rule, n, m, 1 / rho - 1 AS s, (k + m * (1 / rho - 1)) / (n + 1 / rho - 1) AS rate FROM x JOIN p USING (rule)),
h AS (SELECT none, host, bool_or(bad) AS any_bad, bool_or(bad AND rule = 1) AS b1, bool_or(bad AND rule = 2) AS b2, bool_or(bad AND rule = 3) AS b3, bool_or(bad AND rule = 4) AS b4 FROM (SELECT *, rate - {LIFT}::DOUBLE * m > {NormalDist().inv_cdf(PROBABILITY)}::DOUBLE * sqrt(rate * (1 - rate) / (n + s + 1)) AS bad FROM y) GROUP BY 1, 2),
j AS (SELECT f.*, f1::INT + f2::INT + f3::INT + f4::INT AS n_failed, h.any_bad AS host_bad, f1 AND b1 OR f2 AND b2 OR f3 AND b3 OR f4 AND b4 AS together, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f JOIN h USING (none, host))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_failed < 2 AND NOT together AS kept, n_failed, host_bad FROM j
"""

OP7 = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS id, vec_id AS root FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id),
c AS (SELECT id, min(root) AS component_id FROM r GROUP BY 1), n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON c.id = vec_id LEFT JOIN n ON n.a = vec_id
"""

_FIELD = lambda x: f"coalesce(strlen({x}::VARCHAR) || ':' || {x}, '-')"
_LEAF = lambda text: f"sha256({' || '.join(map(_FIELD, ('doc_id', 'source', 'lang', 'n_chars', text)))})"
_CRC = "xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT), lambda crc, b: list_reduce(range(0, 8)::UBIGINT[], lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END, xor(crc, b)), 4294967295::UBIGINT), 4294967295::UBIGINT)"

#: The tree by grouping runs, the ways to the root and the folding by recursion over levels.
OP13 = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, {_LEAF("text")} AS leaf, CASE WHEN {_CRC} % 2 = 0 THEN {_LEAF("replace(text, chr(10), '')")} END AS bad FROM documents),
r AS (SELECT *, row_number() OVER () AS i, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY source) AS n FROM d),
a AS (SELECT t, 0 AS l, p, leaf AS h, n FROM r UNION ALL SELECT t, l + 1, p // 3, sha256(string_agg(h, '' ORDER BY p)), (n + 2) // 3 FROM a WHERE n > 1 GROUP BY t, l, p // 3, n),
subs AS (SELECT t, l, h FROM a WHERE n = 1), m AS (SELECT count(*) AS n FROM subs),
b AS (SELECT 0 AS l, t AS p, h, m.n FROM subs, m UNION ALL SELECT l + 1, p // 3, sha256(string_agg(h, '' ORDER BY p)), (n + 2) // 3 FROM b WHERE n > 1 GROUP BY l, p // 3, n),
runs AS (SELECT false AS up, t, l, p // 3 AS run, list(h ORDER BY p) AS hs FROM a WHERE n > 1 GROUP BY t, l, p // 3 UNION ALL SELECT true, -1, l, p // 3, list(h ORDER BY p) FROM b WHERE n > 1 GROUP BY l, p // 3),
way AS (SELECT i, false AS up, t AS k, 0 AS l, p AS at, r.n, t AS home, m.n AS homes, '' AS proof, coalesce(bad, leaf) AS folded FROM r, m
  UNION ALL SELECT i, w.up, w.k, w.l, w.at, w.n, home, homes, w.proof || w.side, w.folded FROM (
    SELECT w.i, home, homes, w.up OR w.n = 1 AS up, CASE WHEN w.up OR w.n = 1 THEN -1 ELSE w.k END AS k, CASE WHEN NOT w.up AND w.n = 1 THEN 0 ELSE w.l + 1 END AS l,
      CASE WHEN NOT w.up AND w.n = 1 THEN home ELSE w.at // 3 END AS at, CASE WHEN NOT w.up AND w.n = 1 THEN homes ELSE (w.n + 2) // 3 END AS n, w.proof,
      CASE WHEN NOT w.up AND w.n = 1 THEN '' ELSE array_to_string(list_concat(hs[:w.at % 3], hs[w.at % 3 + 2:]), '') END AS side,
      CASE WHEN NOT w.up AND w.n = 1 THEN w.folded ELSE sha256(array_to_string(list_concat(hs[:w.at % 3], [w.folded], hs[w.at % 3 + 2:]), '')) END AS folded
    FROM way w LEFT JOIN runs ON runs.up = w.up AND runs.t = w.k AND runs.l = w.l AND runs.run = w.at // 3 WHERE NOT (w.up AND w.n = 1)) w),
fin AS (SELECT i, proof, folded FROM way WHERE up AND n = 1), root AS (SELECT h AS root FROM b WHERE n = 1)
SELECT doc_id, leaf, subs.h AS subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM r JOIN fin USING (i) JOIN subs USING (t), root
"""

ORACLES = {"op1_license_scan": OP1, "op4_mix_sources": OP4, "op5_jaccard_join": OP5, "op6_quality_rules": OP6, "op7_near_vectors": OP7, "op13_merkle_manifest": OP13}
