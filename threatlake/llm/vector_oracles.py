"""SQL for the two operators on vectors: their rounds, written out one after the other."""

from __future__ import annotations

_FINITE = "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_POINTS = "list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))"
# Floor division of whole numbers.
_FLOOR = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"


def clustering(clusters: int = 40, rounds: int = 5, dims: int = 64, salt: str = "2:") -> str:
    steps = [
        f"kept AS MATERIALIZED (SELECT vec_id, {_POINTS} AS v FROM embeddings WHERE len(embedding) = {dims} AND {_FINITE})",
        f"pts AS MATERIALIZED (SELECT vec_id, unnest(v) AS x, unnest(range(0, {dims})) AS i FROM kept)",
        f"first AS (SELECT row_number() OVER (ORDER BY h) - 1 AS k, v FROM (SELECT v, sha256('{salt}' || vec_id) AS h FROM kept)"
        f" ORDER BY k LIMIT {clusters})",
        f"c0 AS MATERIALIZED (SELECT k, unnest(v) AS y, unnest(range(0, {dims})) AS i FROM first)",
    ]
    for r in range(rounds + 1):
        steps += [
            f"d{r} AS (SELECT vec_id, k, CAST(sum((x - y) * (x - y)) AS BIGINT) AS d FROM pts JOIN c{r} USING (i) GROUP BY vec_id, k)",
            f"a{r} AS MATERIALIZED (SELECT vec_id, min({{'d': d, 'k': k}}) AS b FROM d{r} GROUP BY vec_id)",
        ]
        if r < rounds:
            steps += [
                f"s{r} AS (SELECT b.k AS k, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{r} JOIN pts USING (vec_id) GROUP BY 1, 2)",
                f"c{r + 1} AS MATERIALIZED (SELECT k, i, coalesce({_FLOOR}, y) AS y FROM c{r} LEFT JOIN s{r} USING (k, i))",
            ]
    last = rounds
    steps.append(
        f"h AS (SELECT k, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{last} GROUP BY k)"
    )
    return (
        f"WITH {', '.join(steps)} SELECT vec_id, CAST(b.k AS INTEGER) AS cluster, b.d AS distance,"
        " CAST(sum(b.d) OVER (PARTITION BY b.k) AS BIGINT) AS cluster_inertia,"
        f" CAST(sum(b.d) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a{last} JOIN h ON h.k = b.k"
    )


def codes(parts: int = 16, entries: int = 64, rounds: int = 2, dims: int = 64) -> str:
    width = dims // parts
    steps = [
        f"kept AS MATERIALIZED (SELECT vec_id, label, {_POINTS} AS v FROM embeddings WHERE embedding IS NOT NULL AND {_FINITE})",
        f"pts AS MATERIALIZED (SELECT vec_id, x, i // {width} AS p, i % {width} AS j"
        f" FROM (SELECT vec_id, unnest(v) AS x, unnest(range(0, {dims})) AS i FROM kept))",
        f"first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM kept ORDER BY vec_id LIMIT {entries})",
        "c0 AS MATERIALIZED (SELECT p, k, j, x AS y FROM pts JOIN first USING (vec_id))",
    ]
    for r in range(rounds + 1):
        steps += [
            f"d{r} AS (SELECT vec_id, p, k, CAST(sum((x - y) * (x - y)) AS BIGINT) AS d FROM pts JOIN c{r} USING (p, j)"
            " GROUP BY vec_id, p, k)",
            f"a{r} AS MATERIALIZED (SELECT vec_id, p, min({{'d': d, 'k': k}}) AS b FROM d{r} GROUP BY vec_id, p)",
        ]
        if r < rounds:
            steps += [
                f"s{r} AS (SELECT p, b.k AS k, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n"
                f" FROM a{r} JOIN pts USING (vec_id, p) GROUP BY 1, 2, 3)",
                f"c{r + 1} AS MATERIALIZED (SELECT p, k, j, coalesce({_FLOOR}, y) AS y FROM c{r} LEFT JOIN s{r} USING (p, k, j))",
            ]
    last = rounds
    steps += [
        f"h AS (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY p, k, j)) AS codebooks_sha256 FROM c{last})",
        "e AS (SELECT vec_id, string_agg(printf('%02x', b.k), '' ORDER BY p) AS code, CAST(sum(b.d) AS BIGINT) AS error"
        f" FROM a{last} GROUP BY vec_id)",
    ]
    return (
        f"WITH {', '.join(steps)} SELECT vec_id, code, error,"
        " CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256"
        " FROM e JOIN kept USING (vec_id), h"
    )
