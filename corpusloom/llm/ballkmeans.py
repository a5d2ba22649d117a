"""Centroid clustering by ball k-means, exact in whole numbers.

A cluster is a ball: its centroid and a radius that reaches its farthest member. Of a member at distance d of its centroid,
another centroid can be as near only if it lies within 2 d of that centroid; so a ball's neighbours are the centroids within
twice its radius, its stable core is what lies within half the way to the nearest of them, and each annulus beyond is
compared with one neighbour more. Vectors lie in blocks of rows, packed as numbers with their clusters; a round is one pass
over the blocks, and only sums, counts and radii of clusters leave it.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.runtime import discard, ship, stored

#: Whole components up to this size have squared distances that a long holds, whatever the vectors (of 64 components).
LARGEST = 1 << 27
BLOCK = "ids array<long>, packed binary, clusters binary"


def usable(vectors: DataFrame, id_col: str, vector_col: str, size: int, scale: int) -> DataFrame:
    """(vec_id, whole array<long>) of the rows that take part: `size` components, none null or not finite.

    A component x becomes floor(scale * x), x as a double.
    """
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vector").isNotNull() & (F.size("vector") == size) & fine)
    held = F.raise_error(F.lit(f"components beyond {LARGEST} have distances that no long holds"))
    whole = F.transform("vector", lambda x: F.when(F.abs(x * scale) <= LARGEST, F.floor(x * scale)).otherwise(held.cast("long")))
    return rows.select("vec_id", whole.alias("whole"))


def first_centroids(rows: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k rows (or all, if fewer) of the smallest SHA-256 of `seed:vec_id`, in that order; rows without id come last."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    found = rows.orderBy(order.asc_nulls_last(), "whole").limit(k).collect()  # k rows
    return np.array([r.whole for r in found], np.int64)


def blocks(rows: DataFrame, size: int, most: int = 1024) -> DataFrame:
    """The rows packed into blocks of at most `most` vectors; no cluster is known yet, which is -1."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column(1).flatten().to_numpy().astype("<i4").reshape(-1, size)
            for at in range(0, len(values), most):
                part, none = values[at : at + most], np.full(len(values[at : at + most]), -1, "<i4")
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0).slice(at, most)], pa.list_(pa.int64())), pa.array([part.tobytes()], pa.binary()), pa.array([none.tobytes()], pa.binary())], names=["ids", "packed", "clusters"])

    return rows.mapInArrow(pack, BLOCK)


def squared(vectors: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    gap = vectors - centroid
    return np.einsum("ij,ij->i", gap, gap)


class Balls:
    """Centroids with, for each, its neighbours from near to far: those that its radius lets any member reach."""

    def __init__(self, centroids: np.ndarray, radii: list[int]):
        self.centroids, self.near = centroids, []
        for i, c in enumerate(centroids):
            apart = squared(centroids, c)
            apart[i] = np.iinfo(np.int64).max
            order = np.argsort(apart, kind="stable")
            within = [j for j in order.tolist() if j != i and int(apart[j]) <= 4 * radii[i] ** 2]
            self.near.append((np.array(within, np.int64), apart[within]))

    def nearest(self, vectors: np.ndarray, clusters: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(cluster, squared distance) of each vector, ties to the smaller number, and how many distances were found.

        Members of a ball are sorted into the core and the annuli by their own distance; the r-th nearest neighbour is
        compared with the members of the r-th annulus and those outside it.
        """
        best, distance, found = clusters.copy(), np.zeros(len(vectors), np.int64), 0
        for i in np.unique(clusters).tolist():
            if i < 0:  # not in any ball yet
                rows = np.flatnonzero(clusters < 0)
                all_of = np.stack([squared(vectors[rows], c) for c in self.centroids], axis=1)
                best[rows], distance[rows] = all_of.argmin(axis=1), all_of.min(axis=1)
                found += all_of.size
                continue
            rows = np.flatnonzero(clusters == i)
            own = squared(vectors[rows], self.centroids[i])
            (near, apart), won, least = self.near[i], np.full(len(rows), i), own.copy()
            annulus = np.searchsorted(apart, 4 * own, side="right")
            found += len(rows)
            for r in range(int(annulus.max(initial=0))):
                outside = np.flatnonzero(annulus > r)
                d, j = squared(vectors[rows[outside]], self.centroids[near[r]]), int(near[r])
                nearer = (d < least[outside]) | (d == least[outside]) & (j < won[outside])
                won[outside[nearer]], least[outside[nearer]] = j, d[nearer]
                found += len(outside)
            best[rows], distance[rows] = won, least
        return best, distance, found


def _assign(state: DataFrame, balls: Balls, size: int) -> DataFrame:
    """The blocks with new clusters, and of each: tally, one row a cluster of its sums, count, inertia and radius."""
    sent = state.sparkSession.sparkContext.broadcast((balls.centroids, balls.near))
    sums = pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("inertia", pa.int64()), ("radius", pa.int64()), ("sums", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Balls.__new__(Balls)
        own.centroids, own.near = sent.value
        for b in batches:
            clusters, tallies = [], []
            for packed, before in zip(b.column("packed").to_pylist(), b.column("clusters").to_pylist(), strict=True):
                vectors = np.frombuffer(packed, "<i4").reshape(-1, size).astype(np.int64)
                best, distance, _ = own.nearest(vectors, np.frombuffer(before, "<i4").astype(np.int64))
                tally = []
                for i in np.unique(best).tolist():
                    at = best == i
                    tally.append({"cluster": i, "n": int(at.sum()), "inertia": int(distance[at].sum()), "radius": int(distance[at].max()), "sums": vectors[at].sum(axis=0).tolist()})
                clusters.append(best.astype("<i4").tobytes())
                tallies.append(tally)
            yield pa.RecordBatch.from_arrays([b.column("ids"), b.column("packed"), pa.array(clusters, pa.binary()), pa.array(tallies, pa.list_(sums))], names=["ids", "packed", "clusters", "tally"])

    return state.select("ids", "packed", "clusters").mapInArrow(run, BLOCK + ", tally array<struct<cluster:int,n:long,inertia:long,radius:long,sums:array<long>>>")


def _merged(state: DataFrame, k: int, size: int) -> tuple[list[int], list[int], list[int], list[list[int]]]:
    """(count, inertia, largest squared distance, sums) of each cluster over all blocks: k * size numbers at the driver."""
    tally = state.select(F.explode("tally").alias("t")).select("t.*")
    parts = tally.select("cluster", F.posexplode(F.concat("sums", F.array("n", "inertia", "radius"))))
    n, inertia, radius, total = [0] * k, [0] * k, [0] * k, [[0] * size for _ in range(k)]
    for cluster, at, added, largest in parts.groupBy("cluster", "pos").agg(F.sum("col"), F.max("col")).collect():
        if at < size:
            total[cluster][at] = added
        elif at == size + 2:
            radius[cluster] = largest
        else:
            (n, inertia)[at - size][cluster] = added
    return n, inertia, radius, total


def root_up(x: int) -> int:
    """The smallest whole number whose square is at least x."""
    return isqrt(x - 1) + 1 if x > 0 else 0


def ball_kmeans(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", size: int = 64, scale: int = 1024, k: int = 8, rounds: int = 10, seed: str = "3") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part.

    `rounds` times every vector goes to its nearest centroid and every centroid that has vectors to the floor of their mean;
    then vectors are assigned once more. Distances are squared and exact. Vectors that are null, of another length than
    `size`, or hold null, NaN or infinite components take no part; a null id is an id like others, but no first centroid
    while there are ids; repeated rows count as often as they are there; columns besides the two are left behind. Fewer
    vectors than k give fewer clusters, an empty table an empty one; centroids that coincide leave the later ones empty.
    Components whose whole value exceeds 2^27 raise, because no long holds their distances.

    A round writes the blocks with their clusters and reads them once; the round before is then deleted. k * size numbers
    pass through the driver and are broadcast. Rounds that move no centroid any more are left out: they would repeat.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = usable(vectors, id_col, vector_col, size, scale)
    centroids = first_centroids(rows, k, seed)
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], out)
    k, radii = len(centroids), [0] * len(centroids)
    state = stored(blocks(rows, size), "ball-blocks")
    for _ in range(rounds):
        before, state = state, stored(_assign(state, Balls(centroids, radii), size), "ball-blocks")
        discard(before)
        n, _, widest, total = _merged(state, k, size)
        moved = np.array([[s // n[i] for s in total[i]] if n[i] else centroids[i].tolist() for i in range(k)], np.int64)
        # A member is no farther from the moved centroid than from the old one and the way between them.
        radii = [root_up(widest[i]) + root_up(int(squared(moved[i : i + 1], centroids[i])[0])) for i in range(k)]
        still, centroids = (moved == centroids).all(), moved
        if still:
            break
    before, state = state, stored(_assign(state, Balls(centroids, radii), size), "ball-blocks")
    discard(before)
    n, inertia, _, _ = _merged(state, k, size)
    digests = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    told = spark.createDataFrame([(i, inertia[i], sum(inertia), digests[i]) for i in range(k)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return members(state, centroids, size).join(F.broadcast(told), "cluster").select([c.split()[0] for c in out.split(", ")])  # k rows are sent


def members(state: DataFrame, centroids: np.ndarray, size: int) -> DataFrame:
    """(vec_id, cluster, distance) of every vector of the blocks, in the clusters that they hold."""
    sent = state.sparkSession.sparkContext.broadcast(centroids)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids").flatten()
            held = np.concatenate([np.zeros(0, "<i4"), *(np.frombuffer(x, "<i4") for x in b.column("clusters").to_pylist())])
            vectors = np.concatenate([np.zeros((0, size), "<i4"), *(np.frombuffer(x, "<i4").reshape(-1, size) for x in b.column("packed").to_pylist())]).astype(np.int64)
            gap = vectors - sent.value[held]
            yield pa.RecordBatch.from_arrays([ids, pa.array(held, pa.int32()), pa.array(np.einsum("ij,ij->i", gap, gap), pa.int64())], names=["vec_id", "cluster", "distance"])

    return state.select("ids", "packed", "clusters").mapInArrow(spread, "vec_id long, cluster int, distance long")


def kmeans_sql(k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, seed: str = "3", table: str = "embeddings", id_col: str = "vec_id", vector_col: str = "embedding") -> str:
    """DuckDB SQL of the same rows by plain k-means: every vector against every centroid in each round."""
    steps = [
        f"rows as materialized (select row_number() over () as row, {id_col} vec_id, list_transform({vector_col}, lambda x: floor({scale} * x::double)::bigint) v from {table} where len({vector_col}) = {size} and list_bool_and(list_transform({vector_col}, lambda x: x is not null and isfinite(x))))",
        "parts as materialized (select row, unnest(v) x, generate_subscripts(v, 1) i from rows)",
        f"c0 as materialized (select n as cluster, unnest(v) x, generate_subscripts(v, 1) i from (select (row_number() over (order by vec_id is null, sha256('{seed}:' || vec_id::varchar), v) - 1)::int n, v from rows) where n < {k})",
    ]
    for t in range(rounds + 1):
        steps.append(f"d{t} as materialized (select row, cluster, sum((p.x - c.x) * (p.x - c.x))::bigint distance from parts p join c{t} c using (i) group by row, cluster)")
        steps.append(f"a{t} as materialized (select row, (min(struct_pack(distance, cluster))).cluster as cluster, min(distance) distance from d{t} group by row)")
        if t < rounds:
            steps.append(f"c{t + 1} as materialized (select cluster, i, coalesce(m.x, c.x) x from c{t} c left join (select cluster, i, (sum(x) // count(*) - (sum(x) % count(*) < 0)::int)::bigint x from a{t} join parts using (row) group by cluster, i) m using (cluster, i))")
    steps.append(f"told as (select cluster, sha256(string_agg(x::varchar, ',' order by i)) centroid_sha256 from c{rounds} group by cluster)")
    return "with " + ",\n".join(steps) + f"\nselect vec_id, cluster, distance, (sum(distance) over (partition by cluster))::bigint cluster_inertia, (sum(distance) over ())::bigint inertia, centroid_sha256 from a{rounds} join rows using (row) join told using (cluster)"
