"""DuckDB SQL for the registered queries that SQL can express, written apart from the operators."""

from __future__ import annotations

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Windows of 13 words; levels of doubled length over distinct texts tell the longest run that repeats.
SUBSTRING = f"""
WITH RECURSIVE t AS (SELECT doc_id, text, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
i0 AS (SELECT doc_id, text, w, unnest(range(1, len(w) - 11)) AS i FROM t),
win AS (SELECT doc_id, text, i, array_to_string(w[i:i + 12], ' ') AS k FROM i0),
f AS (SELECT k, min(doc_id) AS first FROM win GROUP BY k),
hit AS (SELECT doc_id, i FROM win JOIN f USING (k) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM hit, range(13) r(j)),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM t),
kept AS (SELECT doc_id, count(*) AS n_words, count(g.i) AS n_removed, coalesce(string_agg(x, ' ' ORDER BY word.i) FILTER (g.i IS NULL), '') AS kept
  FROM word LEFT JOIN gone g USING (doc_id, i) GROUP BY doc_id),
rep AS (SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text),
lev AS (SELECT 13 AS len, doc_id, i, md5(k) AS k FROM (SELECT win.*, min(win.doc_id) OVER (PARTITION BY k) AS a, max(win.doc_id) OVER (PARTITION BY k) AS b FROM win JOIN rep USING (doc_id)) WHERE a < b
  UNION ALL SELECT len, doc_id, i, k FROM (SELECT x.len * 2 AS len, x.doc_id, x.i, md5(x.k || y.k) AS k, min(x.doc_id) OVER (PARTITION BY md5(x.k || y.k)) AS a, max(x.doc_id) OVER (PARTITION BY md5(x.k || y.k)) AS b
    FROM lev x JOIN lev y ON x.doc_id = y.doc_id AND y.i = x.i + x.len) WHERE a < b),
longest AS (SELECT rep.text, max(len) AS longest FROM lev JOIN rep USING (doc_id) GROUP BY rep.text)
SELECT t.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(longest, 0)::INT AS longest_run
FROM t LEFT JOIN kept USING (doc_id) LEFT JOIN longest ON longest.text = t.text"""

COMPONENTS = """reach AS (SELECT id, id AS c FROM node UNION SELECT e.b, r.c FROM reach r JOIN edge e ON e.a = r.id WHERE r.c < e.b),
comp AS (SELECT id, min(c) AS component_id FROM reach GROUP BY id)"""

#: 4-word shingles, pairs by shared shingles, components.
MINHASH = f"""
WITH RECURSIVE t AS (SELECT doc_id, {WORDS.format(LOWER.format("coalesce(text, '')"))} AS w FROM documents),
s0 AS (SELECT doc_id, array_to_string(w, ' ') AS s FROM t WHERE len(w) BETWEEN 1 AND 3 UNION SELECT doc_id, array_to_string(w[i:i + 3], ' ') FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM t)),
n AS (SELECT doc_id, count(*) AS n FROM s0 GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s0 a JOIN s0 b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM both_ JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
node AS (SELECT doc_id AS id FROM documents), edge AS (SELECT x AS a, y AS b FROM link UNION ALL SELECT y, x FROM link), {COMPONENTS}
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, component_id = doc_id AS kept FROM t LEFT JOIN n USING (doc_id) JOIN comp ON comp.id = doc_id"""

#: All pairs of vectors in double precision.
VECTORS = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
u AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS l FROM v WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(v) > 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
edge AS (SELECT p.vec_id AS a, q.vec_id AS b FROM u p JOIN u q ON p.vec_id <> q.vec_id AND len(p.v) = len(q.v) WHERE list_dot_product(p.v, q.v) / (p.l * q.l) >= 0.95),
node AS (SELECT vec_id AS id FROM embeddings), {COMPONENTS}
SELECT vec_id, (SELECT count(*) FROM edge WHERE edge.a = vec_id) AS n_links, component_id, component_id = vec_id AS kept FROM embeddings JOIN comp ON comp.id = vec_id"""

#: CRC-32 of the UTF-8 bytes by its table of 256 values, built from the polynomial; cuts at equal steps of the bytes.
SHARDING = """
WITH tab AS (SELECT list_transform(range(256), lambda x: list_reduce(list_concat([x], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab),
t AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, size, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(size - 1), lambda i: ('0x' || substring(h, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8))) AS text_crc32 FROM t, tab),
s AS (SELECT *, least(7, (2 * (sum(size) OVER (ORDER BY doc_id) - size) + size) * 8 // (2 * sum(size) OVER ()))::INT AS shard FROM c)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, NULL::INT AS grown_shard FROM s"""

#: Targets by water-filling; a source's documents in the order of a seeded hash form one stream, of which the mix takes the
#: first target words, going round.
MIXING = f"""
WITH t AS (SELECT doc_id, source, len({WORDS.format("coalesce(text, '')")}) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM t GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src FROM s),
w AS (SELECT *, [5, 2, 1][src % 3 + 1] AS w FROM o),
f AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () - 2::DOUBLE * (sum(source_size) OVER q - source_size) AS rest, (sum(w) OVER () - sum(w) OVER q + w)::DOUBLE AS heavy, row_number() OVER q AS k FROM w
  WINDOW q AS (ORDER BY source_size::DOUBLE / w, src ROWS UNBOUNDED PRECEDING)),
l AS (SELECT rest AS lr, heavy AS lh, k AS lk FROM f WHERE rest * w / heavy <= 2 * source_size ORDER BY k LIMIT 1),
g AS (SELECT source, source_size, CASE WHEN lk IS NULL OR k < lk THEN 2::DOUBLE * source_size ELSE lr * w / lh END AS target FROM f LEFT JOIN l ON true),
d AS (SELECT t.doc_id, size, source_size, target, floor(target + 1e-6)::BIGINT AS words, (sum(size) OVER (PARTITION BY t.source ORDER BY left(md5(doc_id || ':7'), 16), doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS pos
  FROM t JOIN g ON t.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, greatest(0, least(size, words - pos)) + greatest(0, least(size, words - pos - source_size)) AS taken FROM d"""

#: CRC-32 of bytes given as hex, by the table of the polynomial.
CRC_TABLE = """tab AS (SELECT list_transform(range(256), lambda x: list_reduce(list_concat([x], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab)"""
CRC = """xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(length({h}) // 2), lambda i: ('0x' || substring({h}, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)))"""

_TOLD = "coalesce(octet_length(encode({0}::VARCHAR)) || ':' || {0}::VARCHAR, '-')"
_LEAF = " || ".join(_TOLD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))

#: Levels of the trees of all languages, then those of their subroots; siblings of every node, proofs and folds level by level.
MERKLE = f"""
WITH RECURSIVE {CRC_TABLE},
h AS (SELECT *, hex(encode(doc_id::VARCHAR)) AS hx FROM documents),
d AS (SELECT doc_id, lang, sha256({_LEAF} || {_TOLD.format("text")}) AS leaf,
  CASE WHEN {CRC.format(h="hx")} % 3 = 0 THEN sha256({_LEAF} || {_TOLD.format("low")}) END AS other FROM (SELECT *, {LOWER.format("text")} AS low FROM h, tab)),
p AS (SELECT *, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS k, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf, other) - 1 AS pos FROM d),
low(k, lev, pos, node) AS (SELECT k, 0, pos, leaf FROM p UNION ALL
  SELECT k, lev + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY k) AS c FROM low) WHERE c > 1 GROUP BY k, lev, pos // 8),
sub AS (SELECT k, arg_max(node, lev) AS subroot, max(lev) AS height, row_number() OVER (ORDER BY encode(k)) - 1 AS pos FROM low GROUP BY k),
top(lev, pos, node) AS (SELECT 0, pos, subroot FROM sub UNION ALL
  SELECT lev + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER () AS c FROM top) WHERE c > 1 GROUP BY lev, pos // 8),
root AS (SELECT arg_max(node, lev) AS root, max(lev) AS height FROM top),
sib AS (SELECT k, lev, pos, coalesce(string_agg(node, '') OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(node, '') OVER (r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM (SELECT k, lev, pos, node FROM low UNION ALL SELECT NULL, lev, pos, node FROM top) WINDOW r AS (PARTITION BY k, lev, pos // 8 ORDER BY pos)),
fold AS (SELECT p.k, p.pos AS at, 0 AS lev, p.pos AS pos, coalesce(other, leaf) AS cur, '' AS proof FROM p UNION ALL
  SELECT f.k, f.at, f.lev + 1, CASE WHEN f.lev + 1 = s.height THEN s.pos ELSE f.pos // 8 END, sha256(b.l || f.cur || b.r), f.proof || b.l || b.r
  FROM fold f JOIN sub s ON s.k = f.k JOIN root ON f.lev < s.height + root.height
  JOIN sib b ON b.k IS NOT DISTINCT FROM (CASE WHEN f.lev < s.height THEN f.k END) AND b.lev = (CASE WHEN f.lev < s.height THEN f.lev ELSE f.lev - s.height END)
    AND b.pos = (CASE WHEN s.height = 0 AND f.lev = 0 THEN s.pos ELSE f.pos END))
SELECT p.doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = root AS verified
FROM p JOIN sub ON sub.k = p.k, root JOIN fold f ON f.k = p.k AND f.at = p.pos AND f.lev = sub.height + root.height"""

#: Every query against every row.
NEAREST = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
u AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda a, b: a + b)) AS score
  FROM u q JOIN u c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INT AS rank FROM d)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""

#: Near words by their letters with one left out: two words of one length agree without the same place, others hold each other.
SPELLING = f"""
WITH RECURSIVE {CRC_TABLE},
run AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS w FROM documents),
lo AS (SELECT doc_id, {LOWER.format("w")} AS w FROM run WHERE length(w) >= 6),
c AS (SELECT doc_id, w, count(*) AS c, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS hx FROM lo GROUP BY doc_id, w),
x AS (SELECT w, c, {CRC.format(h="hx")} AS h FROM c, tab),
y AS (SELECT CASE WHEN h % 199 = 0 THEN left(w, h % length(w)) || substring(w, h % length(w) + 2) ELSE w END AS word, c FROM x),
v AS (SELECT word, sum(c)::BIGINT AS n FROM y WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
i AS (SELECT word, n, unnest(range(length(word))) AS i FROM v),
cut AS (SELECT word, n, i, left(word, i) || substring(word, i + 2) AS rest FROM i),
pair AS (SELECT a.word, b.word AS near, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word AND length(a.word) = length(b.word)
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN v b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM cut a JOIN v b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(n) AS top FROM pair GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * v.n THEN (SELECT min(near) FROM pair p WHERE p.word = v.word AND p.n = top) END AS form, CASE WHEN top >= 5 * v.n THEN top END AS form_n FROM v LEFT JOIN best USING (word)),
r AS (SELECT word, word AS root FROM f WHERE form IS NULL UNION ALL SELECT f.word, r.root FROM f JOIN r ON f.form = r.word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN r USING (word)"""
