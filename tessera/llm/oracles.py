"""SQL of the operators that SQL can express, for the same tables."""

from __future__ import annotations

#: CRC-32 by its table, which follows from the reversed polynomial; bytes come from the text's hex digits.
CRC_TABLE = "(SELECT list(list_reduce([i] || range(8), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) FROM range(256) r(i))"
JUMP = """{name} AS (SELECT doc_id, 0 step, (doc_id::HUGEINT + 18446744073709551616) % 18446744073709551616 k, -1::BIGINT b, 0::BIGINT j FROM (SELECT DISTINCT doc_id FROM documents)
 UNION ALL SELECT doc_id, step + 1, (k * 2862933555777941757 + 1) % 18446744073709551616, j,
 floor((j + 1)::DOUBLE * (2147483648.0::DOUBLE / (((k * 2862933555777941757 + 1) % 18446744073709551616 // 8589934592)::DOUBLE + 1.0::DOUBLE)))::BIGINT FROM {name} WHERE j < {n})"""

OP1 = f"""WITH RECURSIVE {JUMP.format(name="a", n=24)}, {JUMP.format(name="b", n=25)}, t AS (SELECT {CRC_TABLE} t),
sa AS (SELECT doc_id, max(b)::INT shard FROM a WHERE b < 24 GROUP BY 1), sb AS (SELECT doc_id, max(b)::INT grown_shard FROM b WHERE b < 25 GROUP BY 1),
h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) h FROM documents),
c AS (SELECT doc_id, length(h) // 2 + 8 AS size, xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
 lambda s, x: xor(s // 256, t[(xor(s % 256, x) + 1)::INT])))::BIGINT text_crc32 FROM h, t)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, grown_shard FROM c JOIN sa USING (doc_id) JOIN sb USING (doc_id)"""

OP3 = """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) sh FROM w)),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY 1),
p AS (SELECT a.doc_id x, b.doc_id y, count(*) c FROM s a JOIN s b USING (sh) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
r AS (SELECT doc_id x, doc_id y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0) n_shingles, m.c component_id, d.doc_id = m.c kept FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) c FROM r GROUP BY 1) m ON m.x = d.doc_id"""

OP6 = """WITH h AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) h, length(hex(encode(coalesce(text, '')))) // 2 AS n FROM documents),
p AS (SELECT doc_id, n, s, sha256(substr(h, 2 * s + 1, 200)) k FROM (SELECT doc_id, n, h, unnest(range(greatest(n - 99, 0))) s FROM h)),
g AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) i FROM p) WHERE i > 1),
f AS (SELECT *, CASE WHEN s > lag(s) OVER d + 100 OR lag(s) OVER d IS NULL THEN 1 ELSE 0 END new FROM g WINDOW d AS (PARTITION BY doc_id ORDER BY s)),
r AS (SELECT doc_id, min(s) a, max(s) + 100 b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s) run FROM f) GROUP BY doc_id, run),
k AS (SELECT doc_id, coalesce(lag(b) OVER d, 0) a, r.a b FROM r WINDOW d AS (PARTITION BY doc_id ORDER BY r.a) UNION ALL SELECT h.doc_id, coalesce(max(r.b), 0), h.n FROM h LEFT JOIN r USING (doc_id) GROUP BY h.doc_id, h.n),
x AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) x FROM k JOIN h USING (doc_id) GROUP BY doc_id)
SELECT h.doc_id, n n_bytes, n - length(x) // 2 AS n_removed, (SELECT count(*) FROM r WHERE r.doc_id = h.doc_id) n_spans, sha256(unhex(x)) kept_sha256 FROM h JOIN x USING (doc_id)"""

#: Rounds are a chain of tables: nearest centroid of every vector (a), and the centroids that follow (c).
NEAR = """d{t} AS (SELECT i, k, sum((v.x - c.x) * (v.x - c.x))::BIGINT d FROM v JOIN c{t} c USING (j) GROUP BY 1, 2),
a{t} AS (SELECT i, k, d FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, k) r FROM d{t}) WHERE r = 1)"""
MOVE = """c{u} AS (SELECT k, j, coalesce(m.x, c.x) x FROM c{t} c LEFT JOIN
(SELECT k, j, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT x FROM v JOIN a{t} USING (i) GROUP BY 1, 2) m USING (k, j))"""
OP11 = f"""WITH e AS (SELECT row_number() OVER () i, vec_id, embedding e FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
v AS (SELECT i, vec_id, unnest(range(64)) j, unnest(list_transform(e, lambda x: floor(64 * x::DOUBLE)::BIGINT)) x FROM e),
f AS (SELECT i, row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR)) - 1 k FROM e WHERE vec_id IS NOT NULL ORDER BY 2 LIMIT 16),
c0 AS (SELECT k, j, x FROM v JOIN f USING (i)), {", ".join(NEAR.format(t=t) + ", " + MOVE.format(t=t, u=t + 1) for t in range(3))}, {NEAR.format(t=3)},
s AS (SELECT k, sha256(string_agg(x::VARCHAR, ',' ORDER BY j)) h FROM c3 GROUP BY 1)
SELECT vec_id, k::INT AS "cluster", d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT cluster_inertia, (sum(d) OVER ())::BIGINT inertia, h centroid_sha256 FROM a3 JOIN e USING (i) JOIN s USING (k)"""

OP13 = OP3.replace("100 * c >= 85 *", "100 * c >= 90 *").replace("m.c component_id, d.doc_id = m.c kept", "m.c component_id")

SQL = {"op1_sharding": OP1, "op3_near_duplicates": OP3, "op6_repeats": OP6, "op11_clustering": OP11, "op13_jaccard_join": OP13}
