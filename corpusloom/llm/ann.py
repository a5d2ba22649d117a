"""Approximate nearest neighbours by inner product over balanced posting lists."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.sampling import place
from corpusloom.runtime import ship, stored


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector) of the distinct rows that take part: finite, not null, not all zero, of the commonest length.

    Rows of another length than most (ties: the longer) have no inner product with them and take no part either.
    Vectors of floats stay floats, all others become doubles, so every component is the original one.
    """
    kind = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast(kind).alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & fine & F.exists("vector", lambda x: x != 0))
    size = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("vector") == (size["n"] if size else 0)).distinct()


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a column of equally long vectors, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy().reshape(len(column), -1).astype(np.float64)


@dataclass
class Index:
    """Centroids in the space where the nearest vector is that of the largest inner product, and their graph.

    Vectors are divided by the longest one's length, then given one more component, sqrt(1 - |x|²), and a query, of
    length 1, gets 0; then all are equally long.
    """

    centroids: np.ndarray
    graph: np.ndarray
    longest: float
    entries: np.ndarray
    sample: np.ndarray
    sample_lists: np.ndarray | None = None

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Vectors in the centroids' space."""
        x = x / self.longest
        return np.concatenate((x, np.sqrt(np.maximum(0, 1 - (x**2).sum(axis=1, keepdims=True)))), axis=1)

    def search(self, x: np.ndarray, pool: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, squared distance) of the nearest centroids found for each row, nearest first.

        Best-first walk over the graph for all rows at once: each row expands its nearest centroid that it hasn't
        expanded, until none of its pool is left. A pool of all centroids needs no walk.
        """
        n, k = len(x), len(self.centroids)
        pool = min(pool, k)
        norms = (self.centroids**2).sum(axis=1)
        if pool >= k:
            d = norms - 2 * x @ self.centroids.T
            ids = np.argsort(d, axis=1, kind="stable")[:, :pool]
            return ids, np.take_along_axis(d, ids, axis=1) + (x**2).sum(axis=1, keepdims=True)
        far = lambda ids: norms[ids] - 2 * np.einsum("nmd,nd->nm", self.centroids[ids], x)
        start = np.broadcast_to(self.entries, (n, len(self.entries)))
        seen, done = np.zeros((n, k + 1), bool), np.zeros((n, k + 1), bool)
        np.put_along_axis(seen, start, True, axis=1)
        ids, d = self._best(start, far(start), pool)
        done[:, k] = True
        while True:
            open_ = ~np.take_along_axis(done, ids, axis=1)
            rows = np.flatnonzero(open_.any(axis=1))
            if not len(rows):
                break
            at = ids[rows, open_[rows].argmax(axis=1)]
            done[rows, at] = True
            near = self.graph[at]
            fresh = ~seen[rows[:, None], near]
            seen[rows[:, None], near] = True
            found = norms[near] - 2 * np.einsum("nmd,nd->nm", self.centroids[near], x[rows])
            found[~fresh] = np.inf
            both = np.concatenate((ids[rows], np.where(fresh, near, k)), axis=1), np.concatenate((d[rows], found), axis=1)
            ids[rows], d[rows] = self._best(*both, pool)
        return ids, d + (x**2).sum(axis=1, keepdims=True)

    def asking(self, x: np.ndarray) -> np.ndarray:
        """Query vectors in the centroids' space, as long as the indexed ones."""
        x = x / np.abs(x).max(axis=1, keepdims=True)
        return np.concatenate((x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((len(x), 1))), axis=1)

    def _best(self, ids: np.ndarray, d: np.ndarray, pool: int) -> tuple[np.ndarray, np.ndarray]:
        if ids.shape[1] < pool:
            gap = pool - ids.shape[1]
            ids = np.concatenate((ids, np.full((len(ids), gap), len(self.centroids))), axis=1)
            d = np.concatenate((d, np.full((len(d), gap), np.inf)), axis=1)
        order = np.argsort(d, axis=1, kind="stable")[:, :pool]
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(d, order, axis=1)


def clustered(x: np.ndarray, clusters: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """Centroids by k-means with balanced lists: a cluster of over twice the mean size is cut at its farthest half."""
    rng = np.random.default_rng(seed)
    clusters = max(1, min(clusters, len(x)))
    centroids = x[rng.choice(len(x), clusters, replace=False)]
    for _ in range(rounds):
        owner = np.concatenate([((centroids**2).sum(axis=1) - 2 * part @ centroids.T).argmin(axis=1) for part in np.array_split(x, len(x) // 4096 + 1)])
        sizes = np.bincount(owner, minlength=clusters)
        sums = np.zeros_like(centroids)
        np.add.at(sums, owner, x)
        centroids = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centroids)
        empty, heavy = np.flatnonzero(sizes == 0), np.flatnonzero(sizes > 2 * max(1, len(x) / clusters))
        heavy = heavy[np.argsort(-sizes[heavy])]
        for spare, big in zip([*empty, *np.argsort(sizes, kind="stable")[len(empty) : len(heavy)]], heavy, strict=False):
            own = x[owner == big]
            gone = ((own - centroids[big]) ** 2).sum(axis=1)
            half = gone > np.median(gone)
            if half.any():
                centroids[spare] = own[half].mean(axis=0)
                centroids[big] = own[~half].mean(axis=0)
    return centroids


def build_index(sample: np.ndarray, longest: float, clusters: int, pool: int = 16, degree: int = 24, seed: int = 11) -> Index:
    """Centroids of a sample, each linked to its nearest ones and to two random ones, and the nearest list of each sampled vector."""
    index = Index(np.zeros((0, 0)), np.zeros((0, 0), int), longest, np.zeros(0, int), sample)
    index.centroids = centroids = clustered(index.lifted(sample), clusters, seed=seed)
    rng, clusters = np.random.default_rng(seed), len(centroids)
    degree = min(degree, clusters - 1)
    index.graph = graph = np.zeros((clusters, degree + 2), np.int64)
    norms = (centroids**2).sum(axis=1)
    for at in range(0, clusters, 1024):
        d = norms - 2 * centroids[at : at + 1024] @ centroids.T
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        graph[at : at + 1024, :degree] = np.argsort(d, axis=1, kind="stable")[:, :degree]
    graph[:, degree:] = rng.integers(0, clusters, (clusters, 2))
    index.entries = np.unique(rng.integers(0, clusters, 8))
    index.sample_lists = np.concatenate([index.search(index.lifted(part), pool)[0][:, 0] for part in np.array_split(sample, len(sample) // 2048 + 1)])
    return index


def held_by(d: np.ndarray, copies: int, closure: float) -> np.ndarray:
    """Which of the lists, nearest first, a vector goes to: those within `closure` times the nearest distance, `copies` at most."""
    ok = d <= d[:, :1] * closure
    ok[:, copies:] = False
    return ok


def reached_by(d: np.ndarray, ratio: float, least: int) -> np.ndarray:
    """Which of the lists found, nearest first, a query reads.

    A list's excess is its distance less that of the nearest; it is read if its excess is at most `ratio` of the
    farthest's in the pool. Distances in many dimensions lie close together, but their excesses spread from 0 to 1.
    """
    return apart(d, least) <= ratio


def apart(d: np.ndarray, least: int) -> np.ndarray:
    """Each list's excess as a share of that of the pool's farthest list; 0 for the nearest `least` lists."""
    finite = np.where(np.isfinite(d), d, -np.inf)
    out = (d - d[:, :1]) / np.maximum(finite.max(axis=1, keepdims=True) - d[:, :1], 1e-12)
    out[:, :least] = np.where(np.isfinite(out[:, :least]), 0.0, out[:, :least])
    return out


def _posted(rows: DataFrame, index, pool: int, copies: int, closure: float) -> DataFrame:
    """(list, vec_id, vector): each row once for every list that it goes to."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for b in batches:
            if b.num_rows:
                ids, d = own.search(own.lifted(matrix(b.column(1))), pool)
                row, col = np.nonzero(held_by(np.sqrt(np.maximum(d, 0)), copies, closure) & (ids < len(own.centroids)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[row, col].astype(np.int64)), b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row))], names=["list", "vec_id", "vector"])

    return rows.select("vec_id", "vector").mapInArrow(of_batches, f"list long, vec_id long, vector {rows.schema['vector'].dataType.simpleString()}")


def _probed(rows: DataFrame, index, pool: int, ratio: float, least: int, k: int) -> DataFrame:
    """(list, vec_id, vector, floor): each query once for every list that it reads.

    floor is the k best score that the index's sampled vectors have in those lists: what scores less is not among the
    k best found.
    """

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                x = matrix(part.column(1))
                ids, d = own.search(own.asking(x), pool)
                read = reached_by(np.sqrt(np.maximum(d, 0)), ratio, least) & (ids < len(own.centroids))
                row, col = np.nonzero(read)
                lists = np.zeros((len(x), len(own.centroids)), bool)
                lists[row, ids[row, col]] = True
                scores = np.where(lists[:, own.sample_lists], x @ own.sample.T, -np.inf)
                floor = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(x), -np.inf)
                floor = np.where(floor > 0, floor * (1 - 1e-9), -np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(ids[row, col].astype(np.int64)), part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(floor[row])], names=["list", "vec_id", "vector", "floor"])

    return rows.select("vec_id", "vector").mapInArrow(of_batches, f"list long, vec_id long, vector {rows.schema['vector'].dataType.simpleString()}, floor double")


def _refined(posted: DataFrame, probed: DataFrame, lists: int, longest: float, list_size: int, part: int, closure: float, least: int, pairs: DataFrame | None, miss: float) -> tuple[DataFrame, DataFrame]:
    """Lists of over `part` rows cut into lists of their own, as often as there are such, so lists stay small at any size.

    Where that happens a query doesn't read all of its lists, so its floor no longer holds and is dropped.

    Each such list is clustered on a bounded sample of its own rows, in a task of its own; its rows and its queries then
    meet those centroids in cells of `part` rows, so a hot list is shared by tasks. A vector goes to its nearest list
    and, at a border, to the second; a query reads those that the ratio allows. The ratio is fitted by the true
    neighbours `pairs` (query, vec_id) of the trial queries: half of the share `miss` of those held in lists that are
    cut may be lost, then half of the rest, and so on. No centroid of theirs leaves the tables. The new lists of a list
    are numbered from 4 * `lists` + 256 times its number on, so no two lists of any depth share one.
    """
    most, name = 256, posted.schema["vector"].dataType.simpleString()
    lift = lambda x: Index(None, None, longest, None, None).lifted(x)
    ask = lambda x: Index(None, None, longest, None, None).asking(x)

    def fit(rows: pa.Table) -> pa.Table:
        found = clustered(lift(matrix(rows.column("vector"))), int(rows.column("subs")[0].as_py()), rounds=5)
        return pa.table({"list": pa.array([rows.column("list")[0].as_py()] * len(found), pa.int64()), "centroid": pa.array(list(found), pa.list_(pa.float64()))})

    def spread(queries: bool, ratio: float):
        def of_cell(rows: pa.Table, centroids: pa.Table) -> pa.Table:
            kept = [c for c in rows.column_names if c != "salt"]
            if not len(rows) or not len(centroids):
                empty = rows.select(kept).slice(0, 0)
                return empty.append_column("apart", pa.array([], pa.float64())) if queries else empty
            centers = matrix(centroids.column("centroid"))
            x = (ask if queries else lift)(matrix(rows.column("vector")))
            d = (centers**2).sum(axis=1) - 2 * x @ centers.T + (x**2).sum(axis=1, keepdims=True)
            ids = np.argsort(d, axis=1, kind="stable")
            near = np.sqrt(np.maximum(np.take_along_axis(d, ids, axis=1), 0))
            row, col = np.nonzero(reached_by(near, ratio, least) if queries else held_by(near, 2, closure))
            out = rows.select(kept).take(pa.array(row))
            if queries:
                out = out.append_column("apart", pa.array(apart(near, least)[row, col]))
            numbers = 4 * lists + rows.column("list").to_numpy()[row] * most + ids[row, col]
            return out.set_column(out.column_names.index("list"), "list", pa.array(numbers))

        return of_cell

    done: list[tuple[DataFrame, DataFrame]] = []
    while True:
        sizes = stored(posted.groupBy("list").agg(F.count("*").alias("n")).where(F.col("n") > part), "long-lists")
        if sizes.isEmpty():
            break
        sizes = sizes.select("list", "n", F.least(F.lit(most - 1), F.ceil(F.col("n") / list_size)).cast("int").alias("subs"), F.ceil(F.col("n") / part).cast("int").alias("salts"))
        done.append((posted.join(sizes, "list", "left_anti"), probed.join(sizes, "list", "left_anti")))
        long = posted.join(sizes, "list")
        chosen = long.where(F.pmod(F.xxhash64("vec_id", F.lit("list")), F.lit(1 << 30)) < F.col("subs") * 16 / F.col("n") * (1 << 30))
        centers = chosen.select("list", "subs", "vector").groupBy("list").applyInArrow(fit, "list long, centroid array<double>")
        centers = stored(centers, "list-centroids").join(sizes.select("list", "salts"), "list").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("list", "salt", "centroid")
        shape = f"list long, vec_id long, vector {name}"
        cell = F.pmod(F.xxhash64("vec_id", F.lit("cell")), F.col("salts")).cast("int").alias("salt")
        split = lambda rows, queries, ratio, own, made: rows.select("list", cell, "vec_id", "vector", *own).groupBy("list", "salt").cogroup(centers.groupBy("list", "salt")).applyInArrow(spread(queries, ratio), ", ".join([shape, *(f"{e} double" for e in made)]))
        posted, asking, miss, ratio = stored(split(long, False, 1.0, [], []), "postings"), probed.join(sizes, "list"), miss / 2, 1.0
        if pairs is not None:
            tried = split(asking.join(pairs.select(F.col("query").alias("vec_id")).distinct(), "vec_id", "left_semi"), True, 1.0, [], ["apart"]).select("list", F.col("vec_id").alias("query"), "apart")
            holding = posted.select("list", "vec_id").join(pairs.select("vec_id").distinct(), "vec_id", "left_semi")
            far = sorted(r[0] for r in tried.join(holding, "list").join(pairs, ["query", "vec_id"]).groupBy("query", "vec_id").agg(F.min("apart")).select("min(apart)").collect())  # trials * k at most
            ratio = min(1.0, far[min(len(far) - 1, int(np.ceil(len(far) * (1 - miss))))] * (1 + 1e-9) + 1e-12) if far else 1.0
        probed = stored(split(asking, True, ratio, ["floor"], ["floor", "apart"]).drop("apart"), "probes")
    for rows, queries in done:
        posted, probed = posted.union(rows), probed.union(queries)
    return posted, probed.withColumn("floor", F.lit(float("-inf"))) if done else probed


def _matched(k: int):
    """The k best of one part of a list for each of its queries, in double precision, but for those below its floor;
    equal scores by smaller id."""

    def of_group(queries: pa.Table, found: pa.Table) -> pa.Table:
        names = ["query", "vec_id", "score"]
        q, v, floor = queries.column("vec_id").to_numpy(), found.column("vec_id").to_numpy(), queries.column("floor").to_numpy()
        if not len(q) or not len(v):
            return pa.table({"query": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        order = np.argsort(v, kind="stable")
        v, x, y = v[order], matrix(found.column("vector"))[order], matrix(queries.column("vector"))
        parts = []
        for at in range(0, len(q), 256):
            scores = y[at : at + 256] @ x.T
            low = floor[at : at + 256, None]
            if scores.shape[1] > k:
                low = np.maximum(low, np.partition(scores, -k, axis=1)[:, [-k]])
            rows, cols = np.nonzero(scores >= low)
            exact = (y[at + rows] * x[cols]).sum(axis=1)
            best = np.lexsort((cols, -exact, rows))
            rows, cols, exact = rows[best], cols[best], exact[best]
            rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
            rows, cols, exact = (a[rank < k] for a in (rows, cols, exact))
            parts.append((q[at + rows], v[cols], exact))
        return pa.table({n: np.concatenate([p[i] for p in parts]) for i, n in enumerate(names)})

    return of_group


def _exact(classes: DataFrame, own: np.ndarray, queries: np.ndarray, k: int) -> list:
    """(query, vec_id) of the k best classes but itself for each query, by brute force; `own` are the queries' classes.

    Each task keeps k rows a query, so few queries are asked.
    """
    held = classes.sparkSession.sparkContext.broadcast((own, queries))

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, y = held.value
        ids, scores = np.full((len(y), k), -1, np.int64), np.full((len(y), k), -np.inf)
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column(0).to_numpy()
            found = y @ matrix(b.column(1)).T
            found[mine[:, None] == v] = -np.inf
            ids, scores = np.concatenate((ids, np.broadcast_to(v, found.shape)), axis=1), np.concatenate((scores, found), axis=1)
            top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            ids, scores = np.take_along_axis(ids, top, axis=1), np.take_along_axis(scores, top, axis=1)
        row, col = np.nonzero(scores > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), pa.array(ids[row, col]), pa.array(scores[row, col])], names=["query", "vec_id", "score"])

    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    top = classes.select("vec_id", "vector").mapInArrow(of_batches, "query int, vec_id long, score double")
    return top.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).select("query", "vec_id").collect()


def tuned(index: Index, queries: np.ndarray, wanted: list[tuple[int, list[int]]], pool: int, least: int, recall: float) -> tuple[int, float]:
    """(pool, ratio) with which the queries find `recall` of their true neighbours and read as few lists as that allows.

    `wanted` has (query, lists that hold it) for each neighbour. The pool doubles until the lists found hold enough of
    them, at the latest with all lists; the ratio is then the smallest that still reads as many.
    """
    need = max(1, int(np.ceil(recall * len(wanted))))
    while True:
        ids, d = index.search(index.asking(queries), pool)
        far = np.full((len(queries), len(index.centroids) + 1), np.inf)
        np.put_along_axis(far, ids, apart(np.sqrt(np.maximum(d, 0)), least), axis=1)
        far[:, -1] = np.inf
        reached = np.sort([far[q, lists].min() for q, lists in wanted])[need - 1]
        if reached < 0.9 or pool >= len(index.centroids):
            return pool, min(1.0, float(reached) * (1 + 1e-9) + 1e-12)
        pool *= 2


def nearest(
    vectors: DataFrame, is_query: F.Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", list_size: int = 64, sample: int = 20_000, most_lists: int = 2500,
    copies: int = 4, closure: float = 1.15, pool: int = 16, least: int = 4, part: int = 2048, recall: float = 0.94, trials: int = 200,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product found for each query row but itself.

    Equal vectors are one class from the start: for any query, its k nearest hold at most the k + 1 smallest ids of a
    class, so those are all that a class keeps, and no copy is lost. The index is fitted on about `sample` classes;
    every class goes to its nearest list and to up to `copies` - 1 more that are within `closure` times its distance.
    Lists hold about `list_size` classes; beyond `most_lists` of them, lists of over `part` are cut again. A query looks
    for its nearest `pool` lists and reads those that the ratio of their excess distances allows (reached_by);
    pool and ratio are fitted so that `trials` vectors, held against brute force over all classes, find `recall` of their
    neighbours; they are no queries, unless all vectors are. Lists and queries of a list are dealt to parts of at most about `part` rows, so a hot list is
    shared by tasks. Fewer candidates than k are all returned if found; an empty table, or one without usable rows,
    gives no rows. A vec_id with several vectors is a candidate with each, repeated rows are one; ids null take no part.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = stored(usable(vectors.where(F.col(f"`{id_col}`").isNotNull()), id_col, vector_col), "vectors")
    by_id = Window.partitionBy("vector").orderBy("vec_id")
    members = rows.withColumn("n", F.row_number().over(by_id)).where(F.col("n") <= k + 1)
    members = stored(members.groupBy("vector").agg(F.min("vec_id").alias("class"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "vector-classes")
    if not members.groupBy("class").count().where("count > 1").isEmpty():  # several vectors of one id: places tell their classes apart
        members = place(members, [F.col("class"), F.xxhash64("vector"), F.col("vector")]).withColumn("class", F.col("place")).drop("place")
    most = F.array_max(F.transform("vector", lambda x: F.abs(x.cast("double"))))
    length = F.element_at(F.transform(F.array(most), lambda m: m * F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + (x / m) * (x / m)))), 1)
    facts = members.agg(F.count("*").alias("n"), F.max(length).alias("long")).first()
    out = "query_id long, rank int, vec_id long, score double"
    if not facts["n"]:
        return spark.createDataFrame([], out)
    share = min(1.0, sample / facts["n"])
    chosen = members.where(F.pmod(F.xxhash64("class", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30))).select("vector") if share < 1 else members.select("vector")
    fit = matrix(chosen.toArrow().column("vector"))  # bounded by `sample`
    clusters = int(min(most_lists, max(1, facts["n"] // list_size), max(1, len(fit) // 8)))
    longest = float(facts["long"])
    index = spark.sparkContext.broadcast(build_index(fit, longest, clusters, max(16, copies)))
    classes = members.select(F.col("class").alias("vec_id"), "vector")
    asked = rows.where(is_query).join(members.select("vector", "class"), "vector").select(F.col("vec_id").alias("query_id"), "class")
    asked = stored(asked, "queries")
    own_classes = asked.select(F.col("class").alias("vec_id")).distinct()
    trying = classes.join(own_classes, "vec_id", "left_anti").orderBy(F.xxhash64("vec_id", F.lit("trial")), "vec_id").limit(trials)
    if trying.isEmpty():  # every vector is a query
        trying = classes.orderBy(F.xxhash64("vec_id", F.lit("trial")), "vec_id").limit(trials)
    trying = stored(trying, "trials")
    asking = classes.join(own_classes.union(trying.select("vec_id")).distinct(), "vec_id")
    posted = stored(_posted(classes, index, max(16, copies), copies, closure), "postings")
    trial, ratio, pairs = trying.collect(), 1.0, None
    long = facts["n"] > part and not posted.groupBy("list").count().where(F.col("count") > part).isEmpty()
    miss = (1 - recall) / 2 if long else 1 - recall
    if trial:
        own, tried = np.array([r.vec_id for r in trial]), np.array([r.vector for r in trial], np.float64)
        true = _exact(classes, own, tried, k)
        at: dict = {}
        for r in posted.select("vec_id", "list").where(F.col("vec_id").isin(sorted({r.vec_id for r in true}))).collect():
            at.setdefault(r.vec_id, []).append(r["list"])
        if true:
            pool, ratio = tuned(index.value, tried, [(r.query, at[r.vec_id]) for r in true], pool, least, 1 - miss)
            pairs = spark.createDataFrame([(int(own[r.query]), r.vec_id) for r in true], "query long, vec_id long")
    probed = stored(_probed(asking, index, pool, ratio, least, k + 1), "probes")
    if long:
        posted, probed = _refined(posted, probed, most_lists, longest, list_size, part, closure, least, pairs, miss)
    parts_of = lambda df, name: df.groupBy("list").agg(F.ceil(F.count("*") / part).cast("int").alias(name))
    parts = parts_of(posted, "v_parts").join(parts_of(probed, "q_parts"), "list")
    spread = lambda df, own, other, *more: df.join(parts, "list").select("list", F.pmod(F.xxhash64("vec_id"), F.col(own)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other), "vec_id", "vector", *more)
    cells = ["list", "v_parts", "q_parts"]
    left, right = spread(probed, "q_parts", "v_parts", "floor"), spread(posted, "v_parts", "q_parts")
    matched = left.groupBy(*cells).cogroup(right.groupBy(*cells)).applyInArrow(_matched(k + 1), "query long, vec_id long, score double")
    matched = matched.groupBy("query", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    matched = matched.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n")
    ids = members.select(F.col("class").alias("vec_id"), "ids")
    expanded = matched.join(ids, "vec_id").select("query", "score", F.explode("ids").alias("vec_id"))
    expanded = expanded.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).select(F.col("query").alias("class"), "vec_id", "score")
    final = asked.join(expanded, "class").where("vec_id <> query_id")
    ranked = final.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "class").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
