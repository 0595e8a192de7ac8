"""Operator 12, centroid clustering: exact nearest centroids by the threshold algorithm."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelia.llm.common import stored, table

CLUSTERS, ROUNDS, WIDTH, SCALE = 16, 3, 64, 64
#: Components beyond this would overflow a squared distance of WIDTH components.
LARGEST = 1 << 27
_NONE = 1 << 40


class SortedLists:
    """For each dimension the centroids in the order of their values there."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.order = np.argsort(centroids, axis=0, kind="stable")
        values = np.take_along_axis(centroids, self.order, axis=0)
        # one more entry on both sides: walking off a list meets a value that is never nearest
        self.values = np.pad(values, ((1, 1), (0, 0)), constant_values=((-_NONE, _NONE), (0, 0)))

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cluster, squared distance) of every vector; of equally near centroids the first.

        Every vector walks outward from its own value in one list after another. A centroid met
        for the first time is measured exactly. The distances from the value to the next entry of
        each list, squared and summed, bound all centroids not met yet from below; a vector is
        done when that sum is strictly above its best distance, or all centroids are met.
        """
        n, width = vectors.shape
        count = len(self.centroids)
        cluster, best = np.full(n, count), np.full(n, np.iinfo(np.int64).max)
        x = np.ascontiguousarray(vectors.T)
        right = np.stack([np.searchsorted(self.values[:, d], x[d]) for d in range(width)])
        left = right - 1
        frontier = np.stack([self._frontier(d, x[d], left[d], right[d]) for d in range(width)])
        bound = frontier.sum(axis=0)
        met = np.zeros((n, count), bool)
        rows = np.arange(n)  # those not done
        for step in range(count * width):
            d = step % width
            column, low, high = self.values[:, d], left[d, rows], right[d, rows]
            at = x[d, rows]
            down = at - column[low] <= column[high] - at
            candidate = self.order[np.where(down, low, high) - 1, d]
            low, high = low - down, high + ~down
            left[d, rows], right[d, rows] = low, high
            fresh = self._frontier(d, at, low, high)
            bound[rows] += fresh - frontier[d, rows]
            frontier[d, rows] = fresh
            new = ~met[rows, candidate]
            those, which = rows[new], candidate[new]
            met[those, which] = True
            apart = vectors[those] - self.centroids[which]
            distance = np.einsum("ij,ij->i", apart, apart)
            nearer = (distance < best[those]) | ((distance == best[those]) & (which < cluster[those]))
            best[those[nearer]], cluster[those[nearer]] = distance[nearer], which[nearer]
            rows = rows[(bound[rows] <= best[rows]) & ~met[rows].all(axis=1)]
            if not len(rows):
                break
        return cluster, best

    def _frontier(self, d: int, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Squared distance to the next entry on the nearer side. It counts only while a centroid
        is not met, and then one of the sides still has one."""
        gap = np.minimum(at - self.values[low, d], self.values[high, d] - at)
        return np.square(np.minimum(gap, 2 * LARGEST))


def usable(width: int = WIDTH) -> Column:
    """Vectors of exactly ``width`` components, none null or non-finite."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (F.size("embedding") == width) & ~bad


def integers(array: pa.Array, width: int) -> np.ndarray:
    """floor(SCALE * x) of every component, one row a vector."""
    raw = array.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    scaled = np.floor(SCALE * raw).reshape(-1, width)
    if len(scaled) and np.abs(scaled).max() > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST // SCALE}: squared distances would overflow")
    return scaled.astype(np.int64)


def first_centroids(kept: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors with the least digests of their ids; of equal ids the least vector first."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.select(digest.alias("h"), "embedding").orderBy(F.asc_nulls_last("h"), "embedding").limit(clusters).collect()
    return np.array([integers(pa.array([r.embedding], pa.list_(pa.float64())), len(r.embedding))[0] for r in rows])


def moved_centroids(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: each centroid becomes the floored mean of its vectors, an empty one stays.

    A task sums its vectors by cluster first, so a round shuffles one row for each task, cluster
    and component. The driver gets clusters x width sums."""
    clusters, width = centroids.shape

    def sums(batches):
        lists = SortedLists(centroids)
        total, count = np.zeros((clusters, width), np.int64), np.zeros(clusters, np.int64)
        for batch in batches:
            vectors = integers(batch.column(0), width)
            cluster, _ = lists.nearest(vectors)
            np.add.at(total, cluster, vectors)
            count += np.bincount(cluster, minlength=clusters)
        full = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(full, pa.int32()), pa.array(count[full], pa.int64()), pa.array(total[full].tolist(), pa.list_(pa.int64()))],
            names=["cluster", "n", "sums"],
        )

    parts = kept.select("embedding").mapInArrow(sums, "cluster int, n long, sums array<long>")
    found = (
        parts.select("cluster", "n", F.posexplode("sums").alias("d", "part"))
        .groupBy("cluster", "d")
        .agg(F.sum("part").alias("total"), F.sum("n").alias("n"))
        .collect()
    )
    after = centroids.copy()
    for r in found:
        after[r.cluster, r.d] = r.total // r.n
    return after


def cluster_vectors(
    vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, seed: int = 1
) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) of every usable vector, final centroids).

    Null vectors, those of another length and those with a null or non-finite component have no
    row. A vector with a null vec_id is clustered but is a first centroid only where others do
    not suffice. Repeated rows count as often as they occur; with fewer vectors than clusters
    there are fewer centroids; an empty table gives an empty result; other columns are not read.
    Components beyond LARGEST / SCALE raise an error. Centroids are the only state on the driver.
    """
    kept = vectors.filter(usable(width)).select("vec_id", "embedding")
    centroids = first_centroids(kept, clusters, seed)
    if not len(centroids):
        return kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    for _ in range(rounds):
        centroids = moved_centroids(kept, centroids)

    def assigned(batches):
        lists = SortedLists(centroids)
        for batch in batches:
            cluster, distance = lists.nearest(integers(batch.column(1), width))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"]
            )

    return kept.mapInArrow(assigned, "vec_id long, cluster int, distance long"), centroids


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = cluster_vectors(table(spark, sf_dir, "embeddings"))
    found = stored(found, "clusters")
    names = spark.createDataFrame([(k, centroid_digest(c)) for k, c in enumerate(centroids)], "cluster int, centroid_sha256 string")
    # at most CLUSTERS rows
    by_cluster = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    whole = F.sum("cluster_inertia").over(Window.partitionBy(F.lit(0)))
    facts = by_cluster.withColumn("inertia", whole).join(F.broadcast(names), "cluster")
    return found.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _round(k: int) -> str:
    """Assignment to the centroids c{k}, then the centroids c{k + 1}."""
    return f"""
a{k} AS ({_assignment(k)}),
m{k} AS (
  SELECT a.cluster, u.d, sum(u.q)::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{k} a JOIN u ON u.row = a.row GROUP BY ALL),
c{k + 1} AS (
  SELECT c.cluster, c.d, coalesce(((m.s - ((m.s % m.n) + m.n) % m.n) // m.n)::BIGINT, c.q) AS q
  FROM c{k} c LEFT JOIN m{k} m ON m.cluster = c.cluster AND m.d = c.d),"""


def _assignment(k: int) -> str:
    return f"""SELECT row, arg_min(cluster, (distance, cluster)) AS cluster, min(distance) AS distance FROM (
    SELECT u.row, c.cluster, sum((u.q - c.q) * (u.q - c.q))::BIGINT AS distance FROM u JOIN c{k} c ON c.d = u.d GROUP BY ALL) GROUP BY row"""


OP12_SQL = f"""
WITH kept AS (
  SELECT row_number() OVER () AS row, vec_id, embedding FROM embeddings
  WHERE len(embedding) = {WIDTH} AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
u AS (
  SELECT row, vec_id, d, floor({SCALE} * x::DOUBLE)::BIGINT AS q
  FROM (SELECT row, vec_id, unnest(embedding) AS x, unnest(range({WIDTH})) AS d FROM kept)),
f AS (
  SELECT row, row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, embedding) - 1 AS cluster FROM kept
  QUALIFY cluster < {CLUSTERS}),
c0 AS (SELECT f.cluster, u.d, u.q FROM f JOIN u ON u.row = f.row),{"".join(map(_round, range(ROUNDS)))}
z AS ({_assignment(ROUNDS)}),
g AS (SELECT cluster, sha256(string_agg(q::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY cluster)
SELECT kept.vec_id, z.cluster::INTEGER AS cluster, z.distance, (sum(z.distance) OVER (PARTITION BY z.cluster))::BIGINT AS cluster_inertia,
       (sum(z.distance) OVER ())::BIGINT AS inertia, g.centroid_sha256
FROM z JOIN kept ON kept.row = z.row JOIN g ON g.cluster = z.cluster
"""
