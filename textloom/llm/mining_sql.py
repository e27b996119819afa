"""DuckDB SQL of the queries on embeddings and of phrase mining."""

from __future__ import annotations

#: Every pair's cosine, then the least id reachable. Rows are told apart by their number, as ids may repeat.
LINKS = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS k, vec_id, CAST(embedding AS DOUBLE[]) AS e, len(embedding) AS n FROM embeddings),
ok AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
e AS (SELECT a.k AS a, b.k AS b, b.vec_id AS id FROM ok a JOIN ok b ON b.k <> a.k AND b.n = a.n AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT k, vec_id AS found FROM v UNION SELECT e.a, r.found FROM r JOIN e ON e.b = r.k),
c AS (SELECT k, min(found) AS component_id FROM r GROUP BY k),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN c ON c.k = v.k LEFT JOIN n ON n.a = v.k"""

PHRASES = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM d),
g AS (SELECT lang, k, g, count(*) AS a FROM (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS g FROM w, (VALUES (1), (2), (3)) AS t(k) WHERE len(w) >= k) GROUP BY ALL),
f AS (SELECT * FROM g WHERE a >= 10),
t AS (SELECT lang, k, g, a, cut, g[1:cut] AS first, g[cut + 1:] AS rest FROM (SELECT *, unnest(range(1, k)) AS cut FROM f WHERE k > 1)),
s AS (SELECT t.lang, t.g, t.a, cut, l.a AS l, r.a AS r, CAST(1000000 * CAST(t.a AS HUGEINT) * t.a // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
    FROM t JOIN f l ON l.lang = t.lang AND l.g = t.first JOIN f r ON r.lang = t.lang AND r.g = t.rest),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
x AS (SELECT lang, q, max(a) AS longer FROM (SELECT lang, unnest([g[1:2], g[2:3]]) AS q, a FROM f WHERE k = 3) GROUP BY lang, q),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY lang),
o AS (SELECT b.lang, array_to_string(b.g, ' ') AS phrase, b.a, b.l, b.r, b.score FROM b LEFT JOIN x ON x.lang = b.lang AND x.q = b.g WHERE coalesce(100 * x.longer < 50 * b.a, true))
SELECT o.lang, row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM o JOIN n ON n.lang = o.lang
QUALIFY rank <= 2000"""


def clusters(k: int = 8, rounds: int = 10, seed: int = 3) -> str:
    """Integer k-means, one set of rows for each round."""
    parts = [
        "v AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS HUGEINT)) AS q FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), q) - 1 AS k, q FROM v WHERE vec_id IS NOT NULL ORDER BY k LIMIT {k})",
    ]
    for t in range(rounds + 1):
        parts.append(
            f"a{t} AS MATERIALIZED (SELECT i, arg_min(k, struct_pack(d := d, k := k)) AS k, min(d) AS d FROM (SELECT i, k, list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, c{t} c) GROUP BY i)"
        )
        if t < rounds:
            parts.append(
                f"c{t + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.q, c.q) AS q FROM c{t} c LEFT JOIN (SELECT k, list(CAST(x // n - CASE WHEN x % n < 0 THEN 1 ELSE 0 END AS HUGEINT) ORDER BY j) AS q FROM "
                f"(SELECT k, j, sum(x) AS x, count(*) AS n FROM (SELECT a.k, generate_subscripts(v.q, 1) AS j, unnest(v.q) AS x FROM v JOIN a{t} a ON a.i = v.i) GROUP BY k, j) GROUP BY k) m ON m.k = c.k)"
            )
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT v.vec_id, CAST(a.k AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, "
        f"sha256(array_to_string(c.q, ',')) AS centroid_sha256 FROM v JOIN a{rounds} a ON a.i = v.i JOIN c{rounds} c ON c.k = a.k"
    )
