"""SQL for the corpus operators that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM d),
x AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
h AS (SELECT a, b FROM p JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b WHERE 100 * n >= 80 * (len(sa.s) + len(sb.s) - n)),
l AS (SELECT a, b FROM h UNION ALL SELECT b, a FROM h),
r AS (SELECT doc_id AS id, doc_id AS seen FROM documents UNION SELECT r.id, l.b FROM r JOIN l ON r.seen = l.a),
c AS (SELECT id, min(seen) AS component_id FROM r GROUP BY id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c ON id = doc_id"""

OP4 = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS id, vec_id AS seen FROM embeddings UNION SELECT r.id, l.b FROM r JOIN l ON r.seen = l.a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN (SELECT id, min(seen) AS component_id FROM r GROUP BY id) ON id = vec_id LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) ON a = vec_id"""

OP9 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
k AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[s:s + 12], ' ') AS t FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
o AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS t FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM k))),
m AS (SELECT doc_id, o.s, o.n, item_id FROM o JOIN k ON o.t = k.t AND o.n = k.n),
h AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY doc_id),
f AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN f ON d.doc_id = f.doc_id"""

#: The checksum of zlib over the bytes of s, by its table, which a rule makes.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, CAST(len(hex(encode(s))) / 2 AS BIGINT)), lambda i: CAST('0x' || substr(hex(encode(s)), 2 * i + 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])))"""

OP11 = f"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crcs),
r AS MATERIALIZED (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents) WHERE length(run) >= 6 GROUP BY ALL),
k AS MATERIALIZED (SELECT run, n, {_CRC} AS h FROM (SELECT *, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS s FROM r), crc),
w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM k) WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
d AS MATERIALIZED (SELECT word, length(word) AS l, i, substr(word, 1, i) || substr(word, i + 2) AS part FROM (SELECT word, unnest(range(0, length(word))) AS i FROM w)),
p AS MATERIALIZED (SELECT a.word AS a, b.word AS b FROM d a JOIN d b ON a.part = b.part AND a.i = b.i AND a.l = b.l AND a.word <> b.word UNION SELECT d.word, w.word FROM d JOIN w ON d.part = w.word UNION SELECT w.word, d.word FROM d JOIN w ON d.part = w.word),
m AS MATERIALIZED (SELECT a AS word, count(*) AS n_near, min((-w.n, b)) AS best FROM p JOIN w ON w.word = b GROUP BY a),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best[1] >= 5 * w.n THEN best[2] END AS form, CASE WHEN -best[1] >= 5 * w.n THEN -best[1] END AS form_n FROM w LEFT JOIN m USING (word)),
c AS (SELECT word, word AS root, form AS up FROM f UNION ALL SELECT c.word, f.word, f.form FROM c JOIN f ON f.word = c.up)
SELECT f.word, f.form, c.root, f.n, f.n_near, CAST(f.form_n AS BIGINT) AS form_n FROM f JOIN c ON c.word = f.word AND c.up IS NULL"""


def _op12() -> str:
    """Two rounds of moving the codebooks, then codes: each step is a pair of CTEs."""
    near = "SELECT {row} AS row, p, min((list_sum(list_transform(list_zip(parts.x, {b}.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e)) AS best FROM parts JOIN {b} USING (p) GROUP BY 1, 2"
    steps = []
    for i in range(3):
        steps.append(f"a{i} AS MATERIALIZED (" + near.format(row="row", b=f"b{i}") + ")")
        if i < 2:
            moved = f"SELECT p, e, list(CAST(floor(s / n) AS BIGINT) ORDER BY d) AS x FROM (SELECT p, best[2] AS e, d, sum(x[d + 1]) AS s, CAST(count(*) AS DOUBLE) AS n FROM a{i} JOIN parts USING (row, p), (SELECT unnest(range(0, (SELECT max(len(x)) FROM parts))) AS d) GROUP BY ALL) GROUP BY p, e"
            steps.append(f"b{i + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.x, b{i}.x) AS x FROM b{i} LEFT JOIN ({moved}) m USING (p, e))")
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT row, p, v[p * (len(v) // 16) + 1:(p + 1) * (len(v) // 16)] AS x FROM v, (SELECT unnest(range(0, 16)) AS p)),
b0 AS MATERIALIZED (SELECT p, row - 1 AS e, x FROM parts WHERE row <= 64),
{", ".join(steps)},
c AS (SELECT row, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM a2 GROUP BY row)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM b2) AS codebooks_sha256
FROM v JOIN c USING (row)"""

ORACLE_SQL = {"op2_minhash": OP2, "op4_embeddings": OP4, "op9_decontamination": OP9, "op11_spelling": OP11, "op12_codes": _op12()}
