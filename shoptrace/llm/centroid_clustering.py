"""Centroid clustering with Orchard's search for the nearest centroid.

Vectors become integers, so distances and means are exact and independent of row order. For every centroid the others are listed by
their distance from it. A vector starts at the centroid it had in the round before and walks that centroid's list: a closer centroid
(or an equally close one of smaller number) is moved to at once and its own list is walked from the front; centroids seen before are
marked and skipped. A list is left where its entries lie strictly beyond twice the current distance, because by the triangle
inequality none of them can be as close. All rows of an Arrow batch walk together in numpy.

Each round reads the table the last round wrote, writes (vector, cluster, distance) and takes componentwise sums per cluster with
partial aggregation, so a cluster with most of the rows costs no more than others. Only the centroids (k x dims integers) go to the
driver and to the tasks. A round's table is released once the next is written.

Defined results: vectors that are NULL, have another number of components, or hold a NULL, NaN or infinite component are left out.
Components beyond +-2**26 after scaling count as that bound (their squared distances would not fit a long). Rows with a NULL vec_id
are clustered but cannot start a centroid before all others. Rows that tie for a start are taken by vector; repeated rows count each. With
fewer than k vectors there are fewer centroids; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoptrace.sources.tables import release, written

CENTROIDS, ROUNDS, DIMS, SCALE, SEED = 16, 3, 64, 64, "1"
BOUND = 1 << 26


def integer_vectors(vectors: DataFrame, dims: int, scale: int, *keep: str) -> DataFrame:
    """Columns vec_id, ``keep`` and v: floor(scale * x) of every component; only finite vectors with ``dims`` components."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))  # NaN sorts above infinity
    kept = vectors.where((F.size("embedding") == dims) & F.coalesce(whole, F.lit(False)))
    bounded = lambda x: F.greatest(F.lit(-float(BOUND)), F.least(F.lit(float(BOUND)), F.floor(x.cast("double") * scale).cast("double")))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), *keep, F.transform("embedding", lambda x: bounded(x).cast("int")).alias("v"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dims)


def neighbour_lists(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every centroid the others by distance (ties by number), and these squared distances."""
    k = len(centroids)
    gap = np.stack([((centroids - c) ** 2).sum(axis=1) for c in centroids])
    np.fill_diagonal(gap, -1)  # itself first, then cut off
    order = np.argsort(gap, axis=1, kind="stable")[:, 1:]
    return order, gap[np.arange(k)[:, None], order]


def nearest(v: np.ndarray, centroids: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each row (ties: smaller number), its squared distance, and how many distances were computed."""
    order, gap = neighbour_lists(centroids)
    here = start.astype(np.int64)
    best = ((v - centroids[here]) ** 2).sum(axis=1)
    seen = np.zeros((len(v), len(centroids)), bool)
    seen[np.arange(len(v)), here] = True
    place = np.zeros(len(v), np.int64)
    live, computed = np.arange(len(v)), len(v)
    while True:
        live = live[place[live] < len(centroids) - 1]
        live = live[gap[here[live], place[live]] <= 4 * best[live]]  # squared: twice the distance
        if not len(live):
            return here, best, computed
        other = order[here[live], place[live]]
        place[live] += 1
        fresh = ~seen[live, other]
        row, other = live[fresh], other[fresh]
        seen[row, other] = True
        computed += len(row)
        distance = ((v[row] - centroids[other]) ** 2).sum(axis=1)
        closer = (distance < best[row]) | ((distance == best[row]) & (other < here[row]))
        row, other = row[closer], other[closer]
        here[row], best[row], place[row] = other, distance[closer], 0


def assigned(table: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``table`` (vec_id, v, cluster) with the nearest cluster and its squared distance; the search starts at the given cluster."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column("v"), centroids.shape[1])
            found, distance, _ = nearest(v, centroids, batch.column("cluster").to_numpy())
            columns = [batch.column("vec_id"), batch.column("v"), pa.array(found.astype(np.int32)), pa.array(distance)]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "v", "cluster", "distance"])

    return table.select("vec_id", "v", "cluster").mapInArrow(search, "vec_id long, v array<int>, cluster int, distance long")


def starts(kept: DataFrame, k: int, seed: str) -> np.ndarray:
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.select(hashed.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k)
    return np.array([r.v for r in first.collect()], np.int64)


def means(table: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise floor of the mean of each cluster; a cluster without vectors keeps its centroid."""
    sums = [F.sum(F.get("v", F.lit(i))).alias(f"s{i}") for i in range(centroids.shape[1])]
    out = centroids.copy()
    for row in table.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums).collect():  # k rows at most
        out[row.cluster] = [s // row.n for s in row[2:]]
    return out


def cluster_vectors(
    vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: str = SEED
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, v, cluster, distance) after ``rounds`` rounds and a last assignment, and the final centroids."""
    spark = vectors.sparkSession
    table, path = written(integer_vectors(vectors, dims, scale).withColumn("cluster", F.lit(0)), "vectors")
    centroids = starts(table, k, seed)
    if not len(centroids):
        return table.select("vec_id", "v", "cluster", F.lit(None).cast("long").alias("distance")), centroids.reshape(0, dims)
    for number in range(rounds + 1):
        table, new = written(assigned(table, centroids), "clusters")
        release(spark, path)
        path = new
        if number < rounds:
            centroids = means(table, centroids)
    return table, centroids


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster_report(vectors: DataFrame, **settings) -> DataFrame:
    """Per vector: cluster, squared distance, inertia of its cluster and of all, digest of its final centroid."""
    table, centroids = cluster_vectors(vectors, **settings)
    inertia = {r.cluster: r.d for r in table.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows at most
    rows = [(c, d, sum(inertia.values()), centroid_digest(centroids[c])) for c, d in inertia.items()]
    per = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return table.join(F.broadcast(per), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _oracle() -> str:
    """The same rounds by comparing every vector with every centroid, unrolled."""
    ctes = [
        """kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings WHERE len(embedding) = 64
            AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        """v AS MATERIALIZED (SELECT r, vec_id, i, CAST(floor(64 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x
            FROM kept, (SELECT unnest(range(1, 65)) AS i) d)""",
        """first AS (SELECT r, CAST(row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)), vec_id) - 1 AS INTEGER) AS c
            FROM kept ORDER BY c LIMIT 16)""",
        "c0 AS MATERIALIZED (SELECT c, i, x FROM first JOIN v USING (r))",
    ]
    for n in range(ROUNDS + 1):
        ctes.append(f"""a{n} AS MATERIALIZED (SELECT r, vec_id, min(d) AS d, arg_min(c, (d, c)) AS c FROM (
            SELECT r, vec_id, c, CAST(sum((v.x - w.x) * (v.x - w.x)) AS BIGINT) AS d FROM v JOIN c{n} w USING (i) GROUP BY ALL) GROUP BY ALL)""")
        if n < ROUNDS:
            ctes.append(f"""c{n + 1} AS MATERIALIZED (SELECT o.c, o.i, coalesce(m.x, o.x) AS x FROM c{n} o LEFT JOIN (
                SELECT c, i, CAST(floor_mean AS BIGINT) AS x FROM (SELECT c, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS floor_mean
                FROM a{n} JOIN v USING (r) GROUP BY c, i)) m USING (c, i))""")
    return f"""WITH {", ".join(ctes)},
        digest AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY c)
        SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
            CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a{ROUNDS} JOIN digest USING (c)"""


ORACLE = _oracle()
