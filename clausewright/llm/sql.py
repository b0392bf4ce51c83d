"""The queries of the training-data operators in DuckDB's SQL, where SQL can express them."""

from __future__ import annotations

from importlib import resources

_WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HOSTS = ", ".join(f"('{h}')" for h in resources.files("clausewright.llm").joinpath("listed_hosts.txt").read_text().split())

OP2 = rf"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM docs, unnest(range(1, len(ws) - 11)) AS t(i)),
firsts AS (SELECT k, min(doc_id) AS f FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT doc_id, i FROM win JOIN firsts USING (k) WHERE f < doc_id), unnest(range(0, 13)) AS t(j)),
words AS (SELECT doc_id, p, ws[p] AS w FROM docs, unnest(range(1, len(ws) + 1)) AS t(p)),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS s, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (doc_id)
"""

OP3 = """
WITH RECURSIVE vecs AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM vecs a JOIN vecs b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN counts USING (vec_id) JOIN least USING (vec_id)
"""

OP4 = f"""
WITH rules(rule, verdict) AS (VALUES ('org/', 'allow'), ('example.org/es/', 'block'), ('example.org/en/1', 'block'), ('com/fr/', 'allow'), ('com/de/', 'block')),
listed(h) AS (VALUES {_HOSTS}),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(coalesce(r, ''), '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(coalesce(r, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
split AS (SELECT rule, verdict, split_part(rule, '/', 1) AS rh, substr(rule, strpos(rule, '/')) AS rp FROM rules),
fit AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM parts JOIN split ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id),
bad AS (SELECT DISTINCT page_id FROM parts JOIN listed ON host = h OR ends_with(host, '.' || h))
SELECT p.page_id, host, path, rule, coalesce(verdict, CASE WHEN bad.page_id IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p LEFT JOIN fit ON p.page_id = fit.page_id LEFT JOIN bad ON p.page_id = bad.page_id
"""

_DRAW = "('0x' || substr(md5({}), 1, 7))::BIGINT"

OP5 = rf"""
WITH docs AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM docs GROUP BY source),
s1 AS (SELECT *, [3.0, 1.0, 2.0][(rn - 1) % 3 + 1]::DOUBLE AS weight, (2 * source_size)::DOUBLE AS cap FROM s0),
s2 AS (SELECT *, cap / weight AS stop, 1.5 * (sum(source_size) OVER ())::DOUBLE AS words FROM s1),
s3 AS (SELECT *, (words - coalesce(sum(cap) OVER (ORDER BY stop, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY stop, rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s2),
s4 AS (SELECT *, max(CASE WHEN level <= stop THEN level END) OVER () AS the FROM s3),
s5 AS (SELECT rn, source, source_size, least(cap, coalesce(the * weight, cap)) AS target FROM s4),
s6 AS (SELECT *, round(sum(target) OVER () / 64)::BIGINT AS blocks FROM s5),
q1 AS (SELECT s6.*, count(*) FILTER (target > 0) OVER () AS n, sum(target) OVER () AS w FROM s6),
q2 AS (SELECT *, CASE WHEN target > 0 THEN floor(greatest(0.0, (blocks - n / 2) / w) * target + 0.5) ELSE 0 END::BIGINT AS base, CASE WHEN target > 0 THEN ceil(n * (target / w)) + 1 ELSE 0 END::BIGINT AS more FROM q1),
q3 AS (SELECT *, blocks - sum(base) OVER () AS rest FROM q2),
q4 AS (SELECT rn, target, rest, row_number() OVER (ORDER BY target / (2 * (base + k) + 1) DESC, rn) AS r FROM q3, unnest(range(0, more + 1)) AS t(k)),
q5 AS (SELECT rn, count(*) FILTER (r <= rest AND target > 0) AS won FROM q4 GROUP BY rn),
sources AS (SELECT q3.rn, source, source_size, target, base + won AS source_blocks, greatest(1, ceil(source_size / 262144))::BIGINT AS shards FROM q3 JOIN q5 USING (rn)),
rws AS (SELECT d.doc_id, d.size, s.*, md5('17:' || coalesce(d.doc_id::VARCHAR, '-')) AS draw, {_DRAW.format("'18:' || coalesce(d.doc_id::VARCHAR, '-')")} % s.shards AS shard
  FROM docs d JOIN sources s ON d.source IS NOT DISTINCT FROM s.source),
h0 AS (SELECT rn, source_blocks, shard, sum(size)::BIGINT AS shard_size FROM rws GROUP BY ALL),
h1 AS (SELECT *, count(*) FILTER (shard_size > 0) OVER (PARTITION BY rn) AS n, sum(shard_size) OVER (PARTITION BY rn) AS w FROM h0),
h2 AS (SELECT *, CASE WHEN shard_size > 0 THEN floor(greatest(0.0, (source_blocks - n / 2) / w) * shard_size + 0.5) ELSE 0 END::BIGINT AS base, CASE WHEN shard_size > 0 THEN ceil(n * (shard_size / w)) + 1 ELSE 0 END::BIGINT AS more FROM h1),
h3 AS (SELECT *, source_blocks - sum(base) OVER (PARTITION BY rn) AS rest FROM h2),
h4 AS (SELECT rn, shard, shard_size, rest, row_number() OVER (PARTITION BY rn ORDER BY shard_size / (2 * (base + k) + 1) DESC, shard) AS r FROM h3, unnest(range(0, more + 1)) AS t(k)),
h5 AS (SELECT rn, shard, count(*) FILTER (r <= rest AND shard_size > 0) AS won FROM h4 GROUP BY ALL),
shards AS (SELECT rn, shard, shard_size, base + won AS blocks FROM h3 JOIN h5 USING (rn, shard)),
line AS (SELECT r.*, h.shard_size, least(h.blocks * 64, 2 * h.shard_size) AS quota, greatest(h.shard_size, 1) AS room,
  coalesce(sum(size) OVER (PARTITION BY r.rn, r.shard ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins
  FROM rws r JOIN shards h ON r.rn = h.rn AND r.shard = h.shard),
passes AS (SELECT *, quota // room AS passes, quota - (quota // room) * shard_size AS rest, {_DRAW.format("'19:' || coalesce(source, '-') || ':' || shard::VARCHAR")} % room AS s FROM line),
begun AS (SELECT *, s - s % 64 AS b FROM passes)
SELECT doc_id, size, source_size, target,
  (passes * size + greatest(0, least(begins + size, b + rest) - greatest(begins, b)) + greatest(0, least(begins + size, b + rest - shard_size) - greatest(begins, 0)))::BIGINT AS taken
FROM begun
"""

OP6 = rf"""
WITH docs AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS k FROM docs, unnest(range(1, len(ws) - 6)) AS t(i)),
twice AS (SELECT doc_id, k FROM win GROUP BY doc_id, k HAVING count(*) > 1),
again AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM win JOIN twice USING (doc_id, k), unnest(range(0, 8)) AS t(j) GROUP BY doc_id),
feats AS (
  SELECT doc_id, source, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')))))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM docs LEFT JOIN again USING (doc_id)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM feats),
h0 AS (SELECT source AS host, count(*) AS n, count(*) FILTER (base_failed) AS f FROM judged GROUP BY source),
h1 AS (SELECT *, (sum(f) OVER ()) / (sum(n) OVER ())::DOUBLE AS mean, f / n AS own FROM h0),
h2 AS (SELECT *, avg((own - mean) * (own - mean)) OVER () AS spread FROM h1),
h3 AS (SELECT *, greatest(1.0, least(10000.0, coalesce(mean * (1 - mean) / nullif(spread, 0) - 1, 10000.0))) AS strength FROM h2),
hosts AS (SELECT host, (f + strength * mean) / (n + strength) AS rate FROM h3)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(rate, 9) AS host_rate, NOT base_failed AND rate <= 0.5 AS kept
FROM judged JOIN hosts ON source IS NOT DISTINCT FROM host
"""

OP8 = rf"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS ws FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 2], ' ') END AS s
  FROM docs, unnest(range(1, greatest(2, len(ws) - 1))) AS t(i) WHERE len(ws) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes s ON d.doc_id = s.doc_id JOIN least l ON d.doc_id = l.doc_id
"""

def _crc(name: str, table: str, column: str) -> str:
    """CTEs: ``name`` has each ``column`` and the crc32 of its decimal text, a bit a step."""
    x = f"xor(v, CASE WHEN i % 8 = 0 THEN ascii(s[i // 8 + 1]) ELSE 0 END)"
    return f"""{name}_bits(id, s, i, v) AS (
  SELECT DISTINCT {column}, {column}::VARCHAR, 0, 4294967295::BIGINT FROM {table} WHERE {column} IS NOT NULL
  UNION ALL SELECT id, s, i + 1, xor({x} >> 1, 3988292384 * ({x} & 1)) FROM {name}_bits WHERE i < 8 * length(s)),
{name} AS (SELECT id, xor(v, 4294967295)::BIGINT AS crc FROM {name}_bits WHERE i = 8 * length(s))"""


def _framed(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR)::VARCHAR || ':' || {column}::VARCHAR, '-')"


def _tree(name: str, leaves: str) -> str:
    """CTEs: ``name`` has all nodes of the trees of ``leaves`` (k, idx, h, cnt), ``name``_sides what stands left and right of each in its run."""
    return f"""{name}(k, level, idx, h, cnt) AS (
  SELECT k, 0, idx, h, cnt FROM {leaves}
  UNION ALL SELECT k, level + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (cnt + 2) // 3 FROM {name} WHERE cnt > 1 GROUP BY k, level, idx // 3, cnt),
{name}_sides AS (
  SELECT a.k, a.level, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM {name} a JOIN {name} b ON a.k = b.k AND a.level = b.level AND a.idx // 3 = b.idx // 3 WHERE a.cnt > 1 GROUP BY ALL)"""


OP12 = f"""
WITH RECURSIVE turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS i,
    coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
{_crc("crcs", "turns", "c")},
convs AS (SELECT id AS c, crc % 6 AS h, id - id % 100 AS b, (SELECT count(*) FROM turns t WHERE t.c = id) AS n, (SELECT count(*) FROM turns t WHERE t.c = id - id % 100) AS bn FROM crcs),
built AS (
  SELECT v.c, i AS d, r, x FROM convs v JOIN turns t ON t.c = v.b WHERE i <= h
  UNION ALL SELECT v.c, least(h, bn) + i - h, r, x FROM convs v JOIN turns t ON t.c = v.c WHERE i > h),
pre AS (
  SELECT c, d, length(x) AS chars, md5(string_agg(length(r)::VARCHAR || ':' || r || ';' || length(x)::VARCHAR || ':' || x, '' ) OVER (PARTITION BY c ORDER BY d)) AS k FROM built
  UNION ALL SELECT c, 0, 0, '' FROM convs),
lens AS (SELECT c, max(d) AS len FROM pre GROUP BY c),
nodes AS (
  SELECT d, k, min(c) AS conv_id, min(chars) AS chars, count(*) AS n_convs, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = len), '') AS ends FROM pre JOIN lens USING (c) GROUP BY d, k),
above AS (SELECT n.d, n.k, p.d AS pd, p.k AS pk FROM nodes n JOIN pre p ON p.c = n.conv_id AND p.d <= n.d),
kids AS (SELECT pd AS d, pk AS k, count(*) AS n_children FROM above WHERE d = pd + 1 GROUP BY ALL),
sums AS (
  SELECT pd AS d, pk AS k, count(*) FILTER (n_children IS NULL) AS n_leaves, sum((n_convs - 1) * chars)::BIGINT AS saved_tokens
  FROM above a JOIN nodes n ON n.d = a.d AND n.k = a.k LEFT JOIN kids ON kids.d = a.d AND kids.k = a.k GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves, saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN sums s ON s.d = n.d AND s.k = n.k LEFT JOIN kids ON kids.d = n.d AND kids.k = n.k
LEFT JOIN above a ON a.d = n.d AND a.k = n.k AND a.pd = n.d - 1 LEFT JOIN nodes p ON p.d = a.pd AND p.k = a.pk
"""

OP13 = f"""
WITH RECURSIVE {_crc("crcs", "documents", "doc_id")},
hashed AS (
  SELECT coalesce('=' || source, '') AS k, doc_id, sha256({" || ".join(map(_framed, ("doc_id", "source", "lang", "n_chars", "text")))}) AS h,
    sha256({" || ".join(map(_framed, ("doc_id", "source", "lang", "n_chars")))} || {_framed("CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")}) AS cut
  FROM documents LEFT JOIN crcs ON doc_id = id),
leaves AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, h, count(*) OVER (PARTITION BY k) AS cnt, doc_id, cut FROM hashed),
{_tree("nodes", "leaves")},
subs AS (SELECT k AS source, 'all' AS k, row_number() OVER (ORDER BY k) - 1 AS idx, h, count(*) OVER () AS cnt FROM nodes WHERE cnt = 1),
{_tree("tops", "subs")},
up(k, leaf_idx, level, idx, cnt, proof, f) AS (
  SELECT k, idx, 0, idx, cnt, '', cut FROM leaves
  UNION ALL SELECT u.k, leaf_idx, u.level + 1, u.idx // 3, (cnt + 2) // 3, proof || l || r, sha256(l || f || r) FROM up u JOIN nodes_sides s ON u.k = s.k AND u.level = s.level AND u.idx = s.idx WHERE cnt > 1),
over_(source, leaf_idx, level, idx, cnt, proof, f) AS (
  SELECT up.k, leaf_idx, 0, subs.idx, subs.cnt, proof, f FROM up JOIN subs ON up.k = subs.source WHERE up.cnt = 1
  UNION ALL SELECT source, leaf_idx, o.level + 1, o.idx // 3, (cnt + 2) // 3, proof || l || r, sha256(l || f || r) FROM over_ o JOIN tops_sides s ON o.level = s.level AND o.idx = s.idx WHERE cnt > 1)
SELECT doc_id, leaves.h AS leaf, subs.h AS subroot, (SELECT h FROM tops WHERE cnt = 1) AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = (SELECT h FROM tops WHERE cnt = 1) AS verified
FROM over_ JOIN leaves ON over_.source = leaves.k AND leaf_idx = leaves.idx JOIN subs ON subs.source = leaves.k WHERE over_.cnt = 1
"""

ORACLE_SQL: dict[str, str] = {"op2_fm_substrings": OP2, "op3_product_quantisation": OP3, "op4_url_filter": OP4, "op5_mixing": OP5, "op6_host_rules": OP6, "op8_tensored_minhash": OP8, "op12_prefix_trie": OP12, "op13_merkle_manifest": OP13}
