"""SQL for DuckDB that gives the rows of the text queries, where SQL can express them."""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
lk AS (SELECT a, b FROM (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2) p
  JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT lk.b, r.c FROM r JOIN lk ON lk.a = r.d)
SELECT r.d AS doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.c) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.d GROUP BY r.d
"""

MIXING = rf"""
WITH s AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, md5(CAST(doc_id AS VARCHAR)) AS k FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS ss FROM s GROUP BY source),
u AS (SELECT *, ([3, 1, 2])[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS w FROM t),
l AS (SELECT *, (CAST(sum(ss) OVER () AS DOUBLE) * CAST(1.5 AS DOUBLE) - CAST(coalesce(sum(2 * ss) OVER (ORDER BY CAST(2 * ss AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
  / CAST(sum(w) OVER (ORDER BY CAST(2 * ss AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lev FROM u),
g AS (SELECT source, ss, coalesce(least(max(CASE WHEN lev <= CAST(2 * ss AS DOUBLE) / w THEN lev END) OVER () * w, CAST(2 * ss AS DOUBLE)), CAST(2 * ss AS DOUBLE)) AS target FROM l),
q AS (SELECT s.doc_id, s.size, g.ss, g.target, CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b
  FROM s JOIN g ON g.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size, ss AS source_size, target, CAST(greatest(0, least(size, CAST(round(target) AS BIGINT) - b)) + greatest(0, least(size, CAST(round(target) AS BIGINT) - b - ss)) AS BIGINT) AS taken FROM q
"""

VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS size FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
lk AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.95),
r AS (SELECT vec_id AS d, vec_id AS c FROM v UNION SELECT lk.b, r.c FROM r JOIN lk ON lk.a = r.d)
SELECT d AS vec_id, CAST((SELECT count(*) FROM lk WHERE lk.a = d) AS BIGINT) AS n_links, min(c) AS component_id, min(c) = d AS kept FROM r GROUP BY d
"""

SUBSTRINGS = rf"""
WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM w)),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY h) AS f FROM win) WHERE doc_id > f),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w),
kept AS (SELECT word.doc_id, string_agg(word, ' ' ORDER BY word.p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY word.doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""

SUFFIXES = """
WITH x AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS (SELECT doc_id, p, md5(substr(x, 2 * p + 1, 200)) AS h FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 99)) AS p FROM x)),
late AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS rn FROM win) WHERE rn > 1),
run AS (SELECT doc_id, p, sum(CASE WHEN p - q > 100 OR q IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM late)),
span AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM run GROUP BY doc_id, g),
part AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM span UNION ALL SELECT doc_id, max(b), NULL FROM span GROUP BY doc_id),
kept AS (SELECT x.doc_id, string_agg(CASE WHEN b IS NULL THEN substr(x, 2 * a + 1) ELSE substr(x, 2 * a + 1, 2 * (b - a)) END, '' ORDER BY a) AS t, count(*) - 1 AS spans FROM x JOIN part ON part.doc_id = x.doc_id GROUP BY x.doc_id)
SELECT x.doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST((len(x) - len(coalesce(t, x))) // 2 AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(t, x))) AS kept_sha256 FROM x LEFT JOIN kept ON kept.doc_id = x.doc_id
"""

EXACT = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_INTEGERS = "list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {0}) AS BIGINT))"

NEGATIVES = f"""
WITH p AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform({_INTEGERS.format(256)}, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE label IS NOT NULL AND {_FINITE}),
d AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS s FROM p a JOIN p b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
pos AS (SELECT anchor_id, id AS positive_id, s AS positive_score FROM d WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, id) <= 5)
SELECT pos.anchor_id, positive_id, CAST(row_number() OVER one AS INTEGER) AS rank, d.id AS negative_id, positive_score, d.s AS negative_score
FROM pos JOIN d ON d.anchor_id = pos.anchor_id AND NOT d.same AND 80 * positive_score <= 100 * d.s AND 100 * d.s <= 100 * positive_score
WINDOW one AS (PARTITION BY pos.anchor_id, positive_id ORDER BY d.s DESC, d.id) QUALIFY row_number() OVER one <= 5
"""

_ROUND = """
n{0} AS (SELECT vec_id, v, k, d FROM (SELECT vec_id, v, k, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v, c{0}) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1)"""
_MEAN = """,
m{1} AS (SELECT k, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS c FROM (SELECT k, i, CAST(sum(x) AS DOUBLE) AS s, count(*) AS n FROM (SELECT k, unnest(v) AS x, unnest(range(1, 65)) AS i FROM n{0}) GROUP BY k, i) GROUP BY k),
c{1} AS (SELECT c{0}.k, coalesce(m{1}.c, c{0}.c) AS c FROM c{0} LEFT JOIN m{1} ON m{1}.k = c{0}.k),"""

CENTROIDS = (
    f"""
WITH v AS (SELECT vec_id, {_INTEGERS.format(64)} AS v FROM embeddings WHERE len(embedding) = 64 AND {_FINITE}),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS k, v AS c FROM v QUALIFY k < 16),"""
    + "".join(_ROUND.format(r) + (_MEAN.format(r, r + 1) if r < 3 else "") for r in range(4))
    + """
SELECT vec_id, CAST(n3.k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY n3.k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c3.c, ',')) AS centroid_sha256
FROM n3 JOIN c3 ON c3.k = n3.k
"""
)
