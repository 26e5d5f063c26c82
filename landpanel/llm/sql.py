"""DuckDB SQL for the operators that SQL can express, by name of the query."""

SQL: dict[str, str] = {}

SQL["op1_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (coalesce(doc_id, 0) % 2147483647 * 2654435761) % 2147483647 AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
  FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][rank % 3 + 1] AS weight, 2 * source_size AS cap FROM s),
r AS (SELECT *, cap::DOUBLE / weight AS ratio FROM w),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level
  FROM r),
t AS (
  SELECT source, source_size, rank, CASE WHEN ratio <= level THEN cap::DOUBLE
         ELSE weight * max(CASE WHEN ratio > level THEN level END) OVER () END AS target FROM l),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.rank,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS c
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (
  SELECT *, least(size, greatest(floor(target)::BIGINT - c, 0)) AS t0, least(size, greatest(floor(target)::BIGINT - c - source_size, 0)) AS t1,
         c::DOUBLE / nullif(target, 0) AS u FROM p),
f AS (
  SELECT *, CASE rank % 3
    WHEN 0 THEN CASE WHEN u < 1 THEN least(2.0::DOUBLE * u / (1.5::DOUBLE + sqrt(greatest(2.25::DOUBLE - 2.0::DOUBLE * u, 0))), 1) ELSE 1 END
    WHEN 1 THEN CASE WHEN u < 1 THEN least(2.0::DOUBLE * u / (0.5::DOUBLE + sqrt(greatest(0.25::DOUBLE + 2.0::DOUBLE * u, 0))), 1) ELSE 1 END
    ELSE CASE WHEN u * 1.125::DOUBLE < 0.625::DOUBLE THEN least(2.0::DOUBLE * (u * 1.125::DOUBLE) / (1.0::DOUBLE + sqrt(1.0::DOUBLE + 2.0::DOUBLE * (u * 1.125::DOUBLE))), 0.5)
              WHEN u * 1.125::DOUBLE < 1.125::DOUBLE THEN least(0.5::DOUBLE + 2.0::DOUBLE * greatest(u * 1.125::DOUBLE - 0.625::DOUBLE, 0)
                   / (1.5::DOUBLE + sqrt(greatest(2.25::DOUBLE - 4.0::DOUBLE * greatest(u * 1.125::DOUBLE - 0.625::DOUBLE, 0), 0))), 1) ELSE 1 END END AS place
  FROM k)
SELECT doc_id, size, source_size, target, (t0 + t1)::BIGINT AS taken,
       CASE WHEN t0 + t1 > 0 THEN floor(place * 1000000)::BIGINT END AS place_ppm
FROM f"""

SQL["op8_topk"] = """
WITH v AS (
  SELECT vec_id AS id, min(list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id),
w AS (SELECT id, v FROM v WHERE len(v) = (SELECT len(v) AS n FROM v GROUP BY n ORDER BY count(*) DESC, n LIMIT 1)),
s AS (
  SELECT q.id AS query_id, c.id AS vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM w q JOIN w c ON q.id % 50 = 0 AND q.id <> c.id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

SQL["op2_near_duplicates"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS g FROM w),
n AS (SELECT doc_id, len(g)::BIGINT AS n FROM g),
e AS (SELECT doc_id, unnest(g) AS s FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT DISTINCT a AS id, a AS to_id FROM u UNION SELECT r.id, u.b FROM r JOIN u ON u.a = r.to_id),
k AS (SELECT id, min(to_id) AS component FROM r GROUP BY id)
SELECT n.doc_id, n.n AS n_shingles, coalesce(component, doc_id)::BIGINT AS component_id, doc_id = coalesce(component, doc_id) AS kept
FROM n LEFT JOIN k ON k.id = n.doc_id"""

SQL["op12_exact"] = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT *, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g"""

SQL["op11_lexical"] = r"""
WITH d AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
f AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM f GROUP BY doc_id),
s AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM n),
t AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
      FROM (SELECT term, count(*) AS df FROM f GROUP BY term), s),
i AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS q FROM i GROUP BY ALL),
c AS (SELECT f.doc_id, f.term, t.w * ((1000000000 * f.tf) // (1000 * f.tf + 12 * (100 - 25 + (25 * n.n * s.docs) // s.terms))) AS part
      FROM f JOIN n USING (doc_id) JOIN t USING (term), s),
r AS (SELECT item_id, doc_id, sum(q * part)::BIGINT AS score FROM q JOIN c USING (term) GROUP BY item_id, doc_id),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 20"""

SQL["op13_spelling"] = r"""
WITH RECURSIVE c AS (
  SELECT list(x ORDER BY n) AS crc FROM (
    SELECT n, list_reduce(list_prepend(n::BIGINT, range(8)::BIGINT[]), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(3988292384, a // 2) ELSE a // 2 END) AS x
    FROM range(256) t(n))),
r AS (
  SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS w FROM documents) GROUP BY ALL),
b AS (SELECT w, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS x FROM r WHERE len(w) >= 5),
h AS (
  SELECT w, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(x), 2), lambda i: ('0x' || x[i:i + 1])::BIGINT)),
         lambda a, y: xor(a // 256, crc[xor(a, y) % 256 + 1]))) AS h FROM b, c),
a AS (SELECT CASE WHEN h % 97 = 0 THEN w[1:h % len(w)] || w[h % len(w) + 2:] ELSE w END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM a WHERE len(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
g AS (SELECT word, n, p, word[1:p - 1] || word[p + 1:] AS form FROM v, range(1, 1000) t(p) WHERE p <= len(word)),
e AS (
  SELECT x.word, y.word AS other, y.n AS m FROM g x JOIN g y ON x.p = y.p AND x.form = y.form AND len(x.word) = len(y.word) AND x.word <> y.word
  UNION SELECT g.word, v.word, v.n FROM g JOIN v ON g.form = v.word
  UNION SELECT v.word, g.word, g.n FROM g JOIN v ON g.form = v.word),
k AS (SELECT word, count(*) AS n_near, max(m) AS m, arg_min(other, struct_pack(a := -m, b := hex(encode(other)))) AS other FROM e GROUP BY word),
f AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * v.n THEN other END AS form, CASE WHEN m >= 2 * v.n THEN m END AS form_n
  FROM v LEFT JOIN k USING (word)),
o AS (SELECT word, word AS root, form AS step FROM f UNION ALL SELECT o.word, o.step, f.form FROM o JOIN f ON f.word = o.step)
SELECT f.word, f.form, o.root, f.n, f.n_near, f.form_n FROM f JOIN o ON o.word = f.word AND o.step IS NULL"""
