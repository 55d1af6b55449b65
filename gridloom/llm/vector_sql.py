"""SQL of the two operators on vectors: op11 in integers, op12 by all pairs."""

from __future__ import annotations


def clustering_sql(size: int = 64, k: int = 16, rounds: int = 3) -> str:
    """Assignments by squared distance, ties to the smaller number; means floored in integers."""
    parts = [
        f"v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS k, x AS c FROM v QUALIFY k < {k})",
    ]
    for r in range(rounds + 1):
        parts.append(f"d{r} AS (SELECT vec_id, x, k, list_sum(list_transform(range(1, {size + 1}), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS d FROM v, c{r})")
        parts.append(f"a{r} AS (SELECT vec_id, x, k, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1)")
        if r < rounds:
            parts.append(f"s{r} AS (SELECT k, i, sum(x[i]) AS s, count(*) AS n FROM a{r}, (SELECT unnest(range(1, {size + 1})) AS i) GROUP BY k, i)")
            parts.append(f"m{r} AS (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM s{r} GROUP BY k)")
            parts.append(f"c{r + 1} AS (SELECT k, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (k))")
    head = "WITH " + ",\n".join(parts)
    return f"""{head}
SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (k)"""


#: All pairs at 0.9 or more, then the smallest id reachable.
NEAR_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b WHERE a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
root AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN root USING (vec_id) LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a) USING (vec_id)
"""
