"""Clustering of integer vectors around centroids, in columns only.

1. Vectors of exactly ``dims`` finite components become integers, floor(scale * x), and are written
   once with their squared length.
2. The first centroids are the vectors with the smallest hash of ``salt`` and their id.
3. A round is one read of the written vectors.  ``zip_with`` and ``aggregate`` give the squared
   distance to each centroid, which stands in the plan as a literal array, and ``array_min`` over
   (distance, number) picks the nearest, the smaller number on ties.  Sums per component and
   cluster are combined before the shuffle, so a cluster with most of the rows is no hot task; at
   most one row per cluster reaches the driver, where exact floor division gives the new centroids.

All arithmetic is on 64-bit integers.  A component beyond ``LARGEST_COMPONENT`` after scaling could
overflow them, so the job ends with an error there instead of a wrong distance.

Vectors that are null, of another length, or hold null or non-finite components are left out.  With
fewer vectors than clusters there are as many clusters as vectors; an empty table gives no rows.
Repeated rows count each by itself, and get equal results.  A null id sorts last among the hashes.
Other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from threatlake.llm.common import finite_vector, scaled_integers, written


@dataclass
class Clustering:
    assigned: DataFrame  # id, cluster, distance: written
    centroids: list[list[int]]

    def summary(self) -> DataFrame:
        """One row per cluster: its centroid and the distance summed over it and over all."""
        spark = self.assigned.sparkSession
        known = spark.createDataFrame(list(enumerate(self.centroids)), "cluster int, centroid array<bigint>")
        sums = self.assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
        total = self.assigned.agg(F.sum("distance")).first()[0]
        return known.join(sums, "cluster").withColumn("inertia", F.lit(total).cast("bigint"))

    def rows(self) -> DataFrame:
        """Every vector with its cluster's row; that side has one row per cluster."""
        return self.assigned.join(F.broadcast(self.summary()), "cluster")


def _array(values: list[int]) -> Column:
    return F.expr(f"array({', '.join(f'{v}L' for v in values)})")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("bigint"), lambda t, x: t + x)


def nearest(vector: Column, length: Column, centroids: list[list[int]]) -> Column:
    """struct<distance, cluster> of the nearest centroid; ``length`` is the vector's squared length."""

    def distance(c: list[int]) -> Column:
        return length + F.lit(sum(x * x for x in c)).cast("bigint") - 2 * _dot(vector, _array(c))

    found = [F.struct(distance(c).alias("distance"), F.lit(k).alias("cluster")) for k, c in enumerate(centroids)]
    return F.array_min(F.array(*found))


def _moved(vectors: DataFrame, centroids: list[list[int]], dims: int) -> list[list[int]]:
    picked = vectors.select(nearest(F.col("v"), F.col("length"), centroids)["cluster"].alias("cluster"), "v")
    sums = [F.sum(F.get("v", F.lit(i))).alias(f"s{i}") for i in range(dims)]
    out = list(centroids)
    for row in picked.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():
        # Python's // floors, on whole numbers of any size.
        out[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(dims)]
    return out


def cluster(
    table: DataFrame, clusters: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256,
    salt: str = "2:", id_col: str = "vec_id", vector_col: str = "embedding",
) -> Clustering:
    """Assign each vector to the nearest centroid after ``rounds`` of moving the centroids."""
    vector = F.col(vector_col)
    whole = F.size(vector) == dims
    kept = table.where(whole & finite_vector(vector)).select(id_col, scaled_integers(vector, scale).alias("v"))
    vectors = written(kept.withColumn("length", _dot(F.col("v"), F.col("v"))), "vectors")
    drawn = F.sha2(F.concat(F.lit(salt), F.col(id_col).cast("string")), 256)
    first = vectors.orderBy(drawn.asc_nulls_last(), "v").limit(clusters)
    centroids = [list(r["v"]) for r in first.select("v").collect()]
    if not centroids:
        return Clustering(vectors.select(id_col, F.lit(0).alias("cluster"), F.col("length").alias("distance")), [])
    for _ in range(rounds):
        centroids = _moved(vectors, centroids, dims)
    best = nearest(F.col("v"), F.col("length"), centroids)
    # The outer struct is read twice, so it is computed in a projection of its own.
    found = vectors.select(id_col, F.explode(F.array(best)).alias("best"))
    assigned = found.select(id_col, "best.cluster", "best.distance")
    return Clustering(written(assigned, "clusters"), centroids)
