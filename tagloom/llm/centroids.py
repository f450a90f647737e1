"""Integer k-means over vectors, in JVM expressions alone.

A vector is an array of integers. Its squared distance to a centroid is
``|x|² - 2 x·c + |c|²``; ``zip_with`` and ``aggregate`` take the products with
literal arrays, ``array_min`` of (distance, number) structs chooses the cluster,
and plain column sums by cluster, combined map-side, update the centroids. Only
the sums, clusters × components numbers, come to the driver.

Products are taken several centroids at a time: a literal array holds
``c1 + c2·2^b + c3·2^2b ...``, so that one sum of products carries the products
with all of them, and ``b`` is chosen from the largest component found in the
data, so that no lane can reach the next. Everything is exact.

Vectors are kept if they have exactly ``dims`` components, none null, NaN or
infinite; repeated rows count once each. No kept vector gives an empty result;
fewer vectors than clusters give as many clusters as vectors. Equal distances go
to the smaller cluster number. A null id is kept and assigned, but starts no
centroid. Components whose squared distances could pass 2^62 raise.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.session import store_table

SCALE = 256
_LANE_LIMIT = 62


@dataclass(frozen=True)
class Clustering:
    """``assigned`` (id, cluster, distance), stored; final ``centroids`` by number."""

    assigned: DataFrame
    centroids: list[list[int]]


def integer_vectors(table: DataFrame, dims: int, scale: int = SCALE, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x ARRAY<BIGINT>, norm): floor(scale × component) of the kept vectors."""
    value = F.col(vector)
    finite = F.forall(value, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    whole = table.where((F.size(value) == dims) & finite).select(
        F.col(vec_id).alias("vec_id"), F.transform(value, lambda v: F.floor(v.cast("double") * F.lit(float(scale)))).alias("x"))
    return whole.withColumn("norm", F.aggregate("x", F.lit(0).cast("long"), lambda s, v: s + v * v))


def first_centroids(vectors: DataFrame, clusters: int, salt: str = "2:") -> list[list[int]]:
    """The vectors whose salted ids hash lowest, in that order; ties by their components."""
    mark = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(mark.alias("mark"), "x").where(F.col("mark").isNotNull()).orderBy("mark", "x").limit(clusters).collect()
    return [list(r["x"]) for r in rows]


def _lanes(largest: int, dims: int) -> int:
    """Centroids that share a literal: sums of products must stay below half a lane."""
    bits = (dims * largest * largest).bit_length() + 2
    if 2 * bits > 2 * _LANE_LIMIT or 4 * dims * largest * largest >= 1 << _LANE_LIMIT:
        raise ValueError(f"components up to {largest} are beyond exact 64-bit distances")
    return max(1, _LANE_LIMIT // bits)


def nearest(x: str, norm: str, centroids: list[list[int]], largest: int) -> Column:
    """Struct (distance, cluster) of the nearest centroid; ``x`` and ``norm`` name columns.

    The expression is written as SQL text: it has a literal array per group of
    centroids, and building those column by column would take longer than a round.
    """
    dims = len(centroids[0])
    lanes = _lanes(largest, dims)
    bits = _LANE_LIMIT // lanes
    half, mask = 1 << (bits - 1), (1 << bits) - 1
    groups = []
    for start in range(0, len(centroids), lanes):
        group = centroids[start : start + lanes]
        packed = ", ".join(f"{sum(c[i] << (bits * lane) for lane, c in enumerate(group))}L" for i in range(dims))
        # With half a lane added to each, no lane is negative and none borrows.
        lift = sum(half << (bits * lane) for lane in range(len(group)))
        products = f"{lift}L + aggregate(zip_with({x}, array({packed}), (a, b) -> a * b), 0L, (s, v) -> s + v)"
        found = []
        for lane, c in enumerate(group):
            taken = f"shiftright(r, {bits * lane})" + (f" & {mask}L" if lane + 1 < len(group) else "")
            own = sum(v * v for v in c)
            found.append(f"named_struct('distance', {norm} - 2L * (({taken}) - {half}L) + {own}L, 'cluster', {start + lane})")
        groups.append(f"transform(array({products}), r -> array({', '.join(found)}))[0]")
    return F.expr(f"array_min(flatten(array({', '.join(groups)})))")


def cluster(vectors: DataFrame, clusters: int, rounds: int, salt: str = "2:") -> Clustering:
    """``rounds`` rounds of assigning and updating, then a last assignment.

    ``vectors`` is a stored result of ``integer_vectors``. Every round is one
    narrow pass and one aggregation to clusters × components sums; a centroid
    becomes the exact floor of sum / count, an empty one stays.
    """
    centroids = first_centroids(vectors, clusters, salt)
    if not centroids:
        empty = vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0)
        return Clustering(empty, [])
    dims = len(centroids[0])
    ends = F.array_max(F.transform("x", lambda v: F.abs(v)))
    largest = vectors.agg(F.max(ends)).first()[0]
    for _ in range(rounds):
        placed = vectors.select("x", nearest("x", "norm", centroids, largest)["cluster"].alias("cluster"))
        sums = placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.expr(f"sum(x[{i}]) AS s{i}") for i in range(dims)])
        for row in sums.collect():
            centroids[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(dims)]
    best = nearest("x", "norm", centroids, largest)
    last = vectors.select("vec_id", best.alias("best")).select("vec_id", "best.cluster", "best.distance")
    return Clustering(store_table(last, "clusters"), centroids)


def with_inertia(found: Clustering) -> DataFrame:
    """Every vector with its cluster's and the whole inertia and its centroid's digest.

    The joined table has one row per cluster, from the literal centroids.
    """
    spark = found.assigned.sparkSession
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(found.centroids)]
    named = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    wide = F.col("distance").cast("decimal(38,0)")
    sums = found.assigned.groupBy("cluster").agg(F.sum(wide).alias("cluster_inertia"))
    total = sums.agg(F.sum("cluster_inertia")).first()[0]
    by_cluster = sums.select("cluster", F.col("cluster_inertia").cast("long").alias("cluster_inertia")).join(named, "cluster")
    whole = F.lit(int(total or 0)).cast("long").alias("inertia")
    return found.assigned.join(F.broadcast(by_cluster), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", whole, "centroid_sha256")


def oracle_sql(clusters: int, rounds: int, dims: int, scale: int = SCALE, salt: str = "2:") -> str:
    """The same in SQL over the table ``embeddings``; one step a round."""
    steps = [f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, x, list_sum(list_transform(x, lambda v: v * v)) AS norm FROM (
        SELECT vec_id, list_transform(embedding, lambda v: CAST(floor({scale} * CAST(v AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
        WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = {dims}))""",
        f"""c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY mark, x) - 1 AS INTEGER) AS cluster, x AS c FROM (
        SELECT sha256('{salt}' || CAST(vec_id AS VARCHAR)) AS mark, x FROM kept WHERE vec_id IS NOT NULL ORDER BY mark, x LIMIT {clusters}))"""]
    near = """SELECT rid, min((d, cluster)) AS best FROM (SELECT k.rid, c.cluster, CAST(list_sum(list_transform(list_zip(k.x, c.c),
        lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM kept k, c{i} c) GROUP BY rid"""
    for i in range(rounds):
        steps.append(f"a{i} AS MATERIALIZED ({near.format(i=i)})")
        steps.append(f"""u{i} AS MATERIALIZED (SELECT cluster, list(v ORDER BY pos) AS c FROM (
            SELECT cluster, pos, CAST(CAST(s AS HUGEINT) // n - CASE WHEN s < 0 AND s % n <> 0 THEN 1 ELSE 0 END AS BIGINT) AS v FROM (
            SELECT cluster, pos, sum(v) AS s, count(*) AS n FROM (SELECT a.best[2] AS cluster, unnest(k.x) AS v, generate_subscripts(k.x, 1) AS pos
            FROM a{i} a JOIN kept k USING (rid)) GROUP BY cluster, pos)) GROUP BY cluster)""")
        steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(u.c, c.c) AS c FROM c{i} c LEFT JOIN u{i} u USING (cluster))")
    steps.append(f"a{rounds} AS MATERIALIZED ({near.format(i=rounds)})")
    steps.append(f"r AS (SELECT k.vec_id, a.best[2] AS cluster, a.best[1] AS distance FROM a{rounds} a JOIN kept k USING (rid))")
    return f"""WITH {', '.join(steps)} SELECT r.vec_id, r.cluster, r.distance,
        CAST(sum(r.distance) OVER (PARTITION BY r.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(r.distance) OVER () AS BIGINT) AS inertia,
        sha256(array_to_string(c.c, ',')) AS centroid_sha256 FROM r JOIN c{rounds} c USING (cluster)"""
