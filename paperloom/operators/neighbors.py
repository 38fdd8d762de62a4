"""Nearest neighbours and all-pairs scores on dense vectors.

Vectors are packed into tiles of at most ``TILE`` rows; a matrix product scores a pair of tiles inside a
task and only its reduction leaves it (the best k per query, or sums). No row pair is ever emitted.

A query set proven small travels with the task; a larger one meets the corpus by an equi-join on
``(cell, salt)``. The number of salts grows with the rows of a cell, so a cell that holds a third of the
corpus is spread over many tasks.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from paperloom.functions.vectors import l2_normalize
from paperloom.operators.features import sparse_columns, times_matrix
from paperloom.operators.windows import assign_dense_ids, topk_per_query
from paperloom.staging import broadcast_if_small, stage

TILE = 1024
ROWS_PER_SALT = 64 * TILE
MAX_QUERIES = 20_000
MAX_QUERY_VALUES = 4_000_000  # values of a query set that may travel with every task (32 MB)
MAX_CENTROID_VALUES = 16_000_000
KEPT_QUERIES = 4 * 64 * TILE  # whose best a task holds before it hands them on
LEAST_PER_SALT = 16 * TILE  # up to four salts are cut from fewer rows, so that a small table has several tasks

_HIT = "query_id long, id long, dist double"


def _matrix(column: pa.ListArray, width: int | None = None) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype("float64", copy=False)
    rows = len(column)
    return values.reshape(rows, width or (len(values) // rows if rows else 0))


def unit_vectors(df: DataFrame, key: str, vec: str, *extra: str) -> DataFrame:
    """``(id, vec)`` with unit vectors; zero vectors have no direction and are left out."""
    out = df.select(F.col(key).cast("long").alias("id"), l2_normalize(F.col(vec)).alias("vec"), *extra)
    return out.filter(F.col("vec").isNotNull())


class _Best:
    """The k smallest (distance to 6 decimals, id) per query seen so far in a task."""

    def __init__(self, k: int):
        self.k, self.kept = k, {}

    def add(self, queries: np.ndarray, ids: np.ndarray, dist: np.ndarray) -> None:
        # Whole tiles are cut to what can still be among the best; only queries that this leaves something are looked at one by one.
        limit = np.array([self.kept[q][0][-1] if q in self.kept and len(self.kept[q][0]) == self.k else np.inf for q in queries.tolist()])
        fresh = np.flatnonzero(np.isinf(limit))
        if len(ids) > self.k and len(fresh):
            limit[fresh] = np.round(np.partition(dist[fresh], self.k - 1, axis=1)[:, self.k - 1], 6)
        rows, places = np.nonzero(dist <= limit[:, None] + 1e-6)
        near = dist[rows, places]
        ranks = np.round(near, 6)
        usable = np.isfinite(ranks) & (ranks <= limit[rows])
        rows, near, ranks, found = rows[usable], near[usable], ranks[usable], ids[places[usable]]
        edges = np.concatenate([[0], np.flatnonzero(np.diff(rows)) + 1, [len(rows)]]) if len(rows) else np.zeros(1, int)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            query = int(queries[rows[a]])
            r, d, i = ranks[a:b], near[a:b], found[a:b]
            if query in self.kept:
                r, d, i = (np.concatenate(pair) for pair in zip(self.kept[query], (r, d, i)))
            order = np.lexsort((i, r))[: self.k]
            self.kept[query] = (r[order], d[order], i[order])

    def batch(self) -> pa.RecordBatch:
        queries = [np.full(len(d), q) for q, (_, d, _) in self.kept.items()]
        parts = list(self.kept.values())

        def joined(arrays, kind):
            return pa.array(np.concatenate(arrays) if arrays else np.empty(0, kind), kind)

        return pa.RecordBatch.from_arrays(
            [joined(queries, "int64"), joined([i for *_, i in parts], "int64"),
             joined([d for _, d, _ in parts], "float64")],
            names=["query_id", "id", "dist"],
        )


def _angular(queries: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    cos = queries @ corpus.T
    return np.sqrt(np.maximum(2.0 * (1.0 - cos), 0.0))


def _small_matrix(df: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Ids and vectors of a side with at most ``limit`` values, else None."""
    head = df.select(F.size("vec").alias("n")).first()
    if head is None:
        return np.empty(0, "int64"), np.empty((0, 0))
    rows = limit // max(head.n, 1)
    table = df.select("id", "vec").limit(rows + 1).toArrow()
    if table.num_rows > rows:
        return None
    table = table.combine_chunks()
    return table["id"].to_numpy(), _matrix(table["vec"].combine_chunks(), head.n)


def pack_tiles(df: DataFrame, tile: int = TILE) -> DataFrame:
    """``(cell, salt, id, vec)`` rows to tiles ``(cell, salt, ids, vecs)``, within each partition."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[tuple[int, int], list] = {}

        def emit(group):
            ids = np.concatenate([i for i, _ in waiting[group]])
            vecs = np.concatenate([v for _, v in waiting[group]])
            del waiting[group]
            for at in range(0, len(ids), tile):
                yield pa.RecordBatch.from_pylist([{
                    "cell": group[0], "salt": group[1], "ids": ids[at:at + tile], "vecs": vecs[at:at + tile].ravel(),
                }], schema=arrow)

        arrow = pa.schema([
            ("cell", pa.int32()), ("salt", pa.int32()), ("ids", pa.list_(pa.int64())), ("vecs", pa.list_(pa.float64())),
        ])
        for batch in batches:
            if batch.num_rows == 0:
                continue
            groups = np.stack([batch.column("cell").to_numpy(), batch.column("salt").to_numpy()], axis=1)
            ids, vecs = batch.column("id").to_numpy(), _matrix(batch.column("vec"))
            kinds, place = np.unique(groups, axis=0, return_inverse=True)
            for number, group in enumerate(kinds.tolist()):
                mine = place.ravel() == number
                group = tuple(group)
                waiting.setdefault(group, []).append((ids[mine], vecs[mine]))
                if sum(len(i) for i, _ in waiting[group]) >= tile:
                    yield from emit(group)
        for group in list(waiting):
            yield from emit(group)

    if "salt" not in df.columns:
        df = df.withColumn("salt", F.lit(0))
    return df.select("cell", "salt", "id", "vec").mapInArrow(pack, "cell int, salt int, ids array<long>, vecs array<double>")


def _tile_pairs(left: DataFrame, right: DataFrame, salts: DataFrame) -> DataFrame:
    """Every left tile next to every right tile of its cell.

    ``salts`` holds ``(cell, n_left, n_right)``. Rows are dealt to salts by their id before they are packed,
    so a task that is run again builds the same tiles; each pair of a left and a right salt is one key, and
    the work of a large cell is shared out on both sides.
    """
    def dealt(df: DataFrame, side: str, other: str) -> DataFrame:
        salted = df.join(F.broadcast(salts), "cell").withColumn("salt", F.pmod(F.xxhash64("id"), F.col(f"n_{side}")).cast("int"))
        tiles = pack_tiles(salted)
        tiles = tiles.join(F.broadcast(salts), "cell").withColumnRenamed("salt", f"{side}_salt")
        copies = F.explode(F.sequence(F.lit(0), F.col(f"n_{other}") - 1)).alias(f"{other}_salt")
        return tiles.select("cell", f"{side}_salt", copies, F.col("ids").alias(f"{side[0]}_ids"), F.col("vecs").alias(f"{side[0]}_vecs"))

    return dealt(left, "left", "right").join(dealt(right, "right", "left"), ["cell", "left_salt", "right_salt"])


def _one_cell(df: DataFrame) -> DataFrame:
    return df.withColumn("cell", F.lit(0))


def _salts(left: DataFrame, right: DataFrame) -> DataFrame:
    """Salts of each cell from the ``(cell, n)`` sizes of both sides."""
    number = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / ROWS_PER_SALT)).cast("int")
    both = left.select("cell", F.col("n").alias("l")).join(right.select("cell", F.col("n").alias("r")), "cell")
    return both.select("cell", number("l").alias("n_left"), number("r").alias("n_right"))


def _sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("cell").agg(F.count("*").alias("n"))


def _tile_topk(pairs: DataFrame, k: int, skip_self: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(k)  # of all batches: what each kept for itself would grow with the pairs of tiles
        for batch in batches:
            columns = [batch.column(c) for c in ("l_ids", "l_vecs", "r_ids", "r_vecs")]
            for row in range(batch.num_rows):
                l_ids, l_vecs, r_ids, r_vecs = (c[row].values.to_numpy(zero_copy_only=False) for c in columns)
                dist = _angular(l_vecs.reshape(len(l_ids), -1), r_vecs.reshape(len(r_ids), -1))
                if skip_self:
                    dist[l_ids[:, None] == r_ids[None, :]] = np.inf
                best.add(l_ids, r_ids, dist)
            if len(best.kept) > KEPT_QUERIES:
                yield best.batch()
                best = _Best(k)
        yield best.batch()

    return pairs.select("l_ids", "l_vecs", "r_ids", "r_vecs").mapInArrow(run, _HIT)


def _dealt_tiles(left: DataFrame, right: DataFrame, left_sizes: DataFrame, right_sizes: DataFrame) -> DataFrame:
    """Tiles of both sides, dealt by ``(cell, l_salt, r_salt)`` and sorted so that the right ones of a key come first.

    Every left row shares one key with every right row of its cell. Rows are dealt to salts by their id, so a task that is run
    again builds the same groups. A tile reaches a key once, where a join would repeat it for each tile of the other side.
    """
    number = lambda n: F.greatest(F.least(F.ceil(F.col(n) / LEAST_PER_SALT), F.lit(4)), F.ceil(F.col(n) / ROWS_PER_SALT)).cast("int")
    both = left_sizes.select("cell", F.col("n").alias("l")).join(right_sizes.select("cell", F.col("n").alias("r")), "cell")
    salts = both.select("cell", number("l").alias("n_l"), number("r").alias("n_r"))

    def tiles(df: DataFrame, own: str, other: str) -> DataFrame:
        salted = df.join(F.broadcast(salts), "cell").withColumn("salt", F.pmod(F.xxhash64("id"), F.col(f"n_{own}")).cast("int"))
        packed = pack_tiles(salted).join(F.broadcast(salts), "cell").withColumnRenamed("salt", f"{own}_salt")
        copies = F.explode(F.sequence(F.lit(0), F.col(f"n_{other}") - 1)).alias(f"{other}_salt")
        return packed.select("*", copies).select("cell", "l_salt", "r_salt", F.lit(own == "l").alias("asks"), "ids", "vecs")

    dealt = tiles(left, "l", "r").unionByName(tiles(right, "r", "l"))
    return dealt.repartition("cell", "l_salt", "r_salt").sortWithinPartitions("cell", "l_salt", "r_salt", "asks")


def _dealt_topk(dealt: DataFrame, k: int, skip_self: bool) -> DataFrame:
    """The k nearest right rows of every left row in each key of ``_dealt_tiles``; the right side of one key is held at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, key, waiting, held = _Best(k), None, [], []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("cell", "l_salt", "r_salt"))))
            asks = batch.column("asks").to_pylist()
            for row in range(batch.num_rows):
                if keys[row] != key:
                    key, waiting, held = keys[row], [], []
                ids, vecs = (batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in ("ids", "vecs"))
                vecs = vecs.reshape(len(ids), -1)
                if not asks[row]:
                    waiting.append((ids.copy(), vecs.copy()))  # the batch itself goes
                    if sum(len(i) for i, _ in waiting) >= 4 * TILE:
                        held.append(tuple(map(np.concatenate, zip(*waiting))))
                        waiting = []
                    continue
                if waiting:
                    held.append(tuple(map(np.concatenate, zip(*waiting))))
                    waiting = []
                for r_ids, right in held:
                    for at in range(0, len(r_ids), 4 * TILE):
                        dist = _angular(vecs, right[at:at + 4 * TILE])
                        if skip_self:
                            dist[ids[:, None] == r_ids[None, at:at + 4 * TILE]] = np.inf
                        best.add(ids, r_ids[at:at + 4 * TILE], dist)
                if len(best.kept) > KEPT_QUERIES:
                    yield best.batch()
                    best = _Best(k)
        yield best.batch()

    return dealt.mapInArrow(run, _HIT)


def _scan_topk(corpus: DataFrame, q_ids: np.ndarray, q_vecs: np.ndarray, k: int, skip_self: bool) -> DataFrame:
    """One pass over the corpus with the queries in every task; k rows per query leave a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(k)
        for batch in batches:
            if batch.num_rows == 0 or len(q_ids) == 0:
                continue
            ids, vecs = batch.column("id").to_numpy(), _matrix(batch.column("vec"), q_vecs.shape[1])
            for r in range(0, len(ids), TILE):
                for q in range(0, len(q_ids), TILE):
                    dist = _angular(q_vecs[q:q + TILE], vecs[r:r + TILE])
                    if skip_self:
                        dist[q_ids[q:q + TILE, None] == ids[None, r:r + TILE]] = np.inf
                    best.add(q_ids[q:q + TILE], ids[r:r + TILE], dist)
        yield best.batch()

    return corpus.select("id", "vec").mapInArrow(run, _HIT)


def knn_exact(
    queries: DataFrame, corpus: DataFrame, k: int = 10, *, query_key: str = "id", key: str = "id",
    query_vec: str = "vec", vec: str = "vec", skip_self: bool = False,
) -> DataFrame:
    """Exact top-k by angular distance: ``(query_id, id, dist, rank)``."""
    asked = unit_vectors(queries, query_key, query_vec)
    stored = unit_vectors(corpus, key, vec)
    small = _small_matrix(asked, MAX_QUERY_VALUES)
    if small is not None:
        return topk_per_query(_scan_topk(stored, *small, k, skip_self), k)
    left, right = _one_cell(asked), _one_cell(stored)
    pairs = _tile_pairs(left, right, _salts(_sizes(left), _sizes(right)))
    return topk_per_query(_tile_topk(pairs, k, skip_self), k)


def knn_sparse(queries: DataFrame, corpus: DataFrame, k: int = 10) -> DataFrame | None:
    """Exact top-k over ``(id, features)`` with sparse unit vectors, or None for too large a query set.

    The corpus is scanned once where it lies, and k rows per query leave a task. Rows that share no
    feature with a query are not ranked for it.
    """
    asked = sparse_columns(queries, "features", F.col("id"))
    size = asked.agg(F.count("*").alias("n"), F.sum(F.size("indices")).alias("entries")).first()
    if size.n > MAX_QUERIES or (size.entries or 0) > MAX_QUERY_VALUES:
        return None
    asked = asked.toArrow().combine_chunks()
    ids = asked["id"].to_numpy()
    sizes = np.array([len(v) for v in asked["indices"].to_pylist()], "int64")
    flat = asked["indices"].combine_chunks().flatten().to_numpy() if len(ids) else np.empty(0, "int32")
    used, position = np.unique(flat, return_inverse=True)
    if len(used) * len(ids) > MAX_QUERY_VALUES:
        return None
    weights = np.zeros((len(used) + 1, len(ids)))  # the last row stands for features of no query
    if len(flat):
        weights[position, np.repeat(np.arange(len(ids)), sizes)] = asked["values"].combine_chunks().flatten().to_numpy()
    shared = corpus.sparkSession.sparkContext.broadcast((ids, used, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, features, q = shared.value
        best, step = _Best(k), max(1, 8_000_000 // max(q.shape[1], 1))
        for batch in batches:
            if batch.num_rows == 0 or len(features) == 0:
                continue
            lists = batch.column("indices")
            counts = lists.value_lengths().to_numpy()
            entries, values = lists.flatten().to_numpy(), batch.column("values").flatten().to_numpy()
            at = np.minimum(np.searchsorted(features, entries), len(features) - 1)
            known = features[at] == entries
            owner = np.repeat(np.arange(len(counts)), counts)[known]
            at, values, counts = at[known], values[known], np.bincount(owner, minlength=len(counts))
            ends = np.cumsum(counts)
            row = 0
            while row < len(counts):
                begin = ends[row] - counts[row]
                stop = max(row + 1, int(np.searchsorted(ends, begin + step, side="right")))
                part = slice(begin, ends[stop - 1])
                cos = times_matrix(at[part], values[part], counts[row:stop], q).T
                dist = np.where(cos > 0, np.sqrt(np.maximum(2.0 * (1.0 - cos), 0.0)), np.inf)
                best.add(q_ids, batch.column("id").to_numpy()[row:stop], dist)
                row = stop
        yield best.batch()

    hits = sparse_columns(corpus, "features", F.col("id").cast("long").alias("id")).mapInArrow(run, _HIT)
    return topk_per_query(hits, k)


def knn_graph(df: DataFrame, k: int = 10, *, key: str = "id", vec: str = "vec", index: "CellIndex | None" = None,
              nprobe: int = 8) -> DataFrame:
    """The k nearest other points of every point; exact, or within the probed cells of an index."""
    if index is None:
        return knn_exact(df, df, k, query_key=key, key=key, query_vec=vec, vec=vec, skip_self=True)
    return index.search(df, k, nprobe, query_key=key, query_vec=vec, skip_self=True)


class CellIndex:
    """Approximate search: unit vectors assigned to k-means cells, queries probe the nearest cells.

    ``centroids`` is ``(forest, cell, centroid, n)`` and ``cells`` is ``(forest, cell, id, vec)``; several
    forests are independent restarts that raise recall.
    """

    def __init__(self, centroids: DataFrame, cells: DataFrame):
        self.centroids, self.cells = centroids, cells

    @classmethod
    def build(
        cls, corpus: DataFrame, cells: int, *, key: str = "id", vec: str = "vec", restarts: int = 1,
        seed: int = 42, max_iter: int = 20,
    ) -> "CellIndex":
        stored = stage(unit_vectors(corpus, key, vec), "unit")
        spark = corpus.sparkSession
        points = stored.withColumn("features", array_to_vector("vec"))
        assigned, centers = None, []
        for forest in range(restarts):
            model = KMeans(k=cells, seed=seed + forest, maxIter=max_iter).fit(points)
            centers += [(forest, c, [float(x) for x in v]) for c, v in enumerate(model.clusterCenters())]
            mine = model.transform(points).select(
                F.lit(forest).alias("forest"), F.col("prediction").alias("cell"), "id", "vec"
            )
            assigned = mine if assigned is None else assigned.unionByName(mine)
        assigned = stage(assigned, "cells")
        sizes = assigned.groupBy("forest", "cell").agg(F.count("*").alias("n"))
        centroids = spark.createDataFrame(centers, "forest int, cell int, centroid array<double>")
        return cls(stage(centroids.join(sizes, ["forest", "cell"]), "centroids"), assigned)

    def save(self, path: str) -> None:
        self.centroids.withColumn("version", F.lit(0)).coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
        cells = self.cells.repartition("forest", "cell", F.pmod(F.xxhash64("id"), F.lit(32)))
        cells.write.mode("overwrite").partitionBy("forest", "cell").parquet(f"{path}/cells")

    @classmethod
    def load(cls, spark, path: str) -> "CellIndex":
        centroids = spark.read.parquet(f"{path}/centroids")
        last = centroids.agg(F.max("version").alias("last")).first().last
        return cls(centroids.where(F.col("version") == F.lit(last)).drop("version"), spark.read.parquet(f"{path}/cells"))

    @classmethod
    def append_centroids(cls, spark, path: str, rows: list[tuple]) -> None:
        """A new version of the centres ``(forest, cell, centroid, n)`` of a saved index, as one file."""
        last = spark.read.parquet(f"{path}/centroids").agg(F.max("version").alias("last")).first().last
        table = spark.createDataFrame(rows, "forest int, cell int, centroid array<double>, n long")
        table.withColumn("version", F.lit(last + 1)).coalesce(1).write.mode("append").parquet(f"{path}/centroids")

    def probes(self, queries: DataFrame, k: int, nprobe: int, forest: int) -> DataFrame:
        """Nearest ``nprobe`` cells per query ``(id, vec, cells)``; more while they hold fewer than k rows."""
        table = self.centroids.filter(F.col("forest") == forest)
        if (table.agg(F.sum(F.size("centroid"))).first()[0] or 0) > MAX_CENTROID_VALUES:
            raise ValueError("too many cells: the centroid table must stay small")
        rows = table.orderBy("cell").toArrow().combine_chunks()
        if rows.num_rows == 0:
            return queries.select("id", "vec", F.array().cast("array<int>").alias("cells"))
        centers = _matrix(rows["centroid"].combine_chunks())
        cell_ids, sizes = rows["cell"].to_numpy(), rows["n"].to_numpy()
        half = (centers**2).sum(axis=1) / 2

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                near = np.argsort(half - _matrix(batch.column("vec")) @ centers.T, axis=1, kind="stable")
                enough = (np.cumsum(sizes[near], axis=1) < k + 1).sum(axis=1) + 1
                probed = [
                    cell_ids[order[: max(nprobe, n)]] for order, n in zip(near, enough)
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("vec"), pa.array(probed, pa.list_(pa.int32()))],
                    names=["id", "vec", "cells"],
                )

        return queries.select("id", "vec").mapInArrow(run, "id long, vec array<double>, cells array<int>")

    def search(
        self, queries: DataFrame, k: int = 10, nprobe: int = 8, *, query_key: str = "id",
        query_vec: str = "vec", skip_self: bool = False,
    ) -> DataFrame:
        """Top-k within the probed cells: ``(query_id, id, dist, rank)``."""
        asked = unit_vectors(queries, query_key, query_vec)
        hits = None
        for row in self.centroids.select("forest").distinct().orderBy("forest").collect():
            probed = stage(self.probes(asked, k, nprobe, row.forest), "probes")
            # The probed cells are few at most; naming them prunes the partitions of a saved index.
            wanted = [r.cell for r in probed.select(F.explode("cells").alias("cell")).distinct().collect()]
            stored = self.cells.filter((F.col("forest") == row.forest) & F.col("cell").isin(wanted))
            sizes = self.centroids.filter(F.col("forest") == row.forest).select("cell", "n")
            by_cell = probed.select("id", "vec", F.explode("cells").alias("cell"))
            found = _dealt_topk(_dealt_tiles(by_cell, stored, _sizes(by_cell), sizes), k, skip_self)
            hits = found if hits is None else hits.unionByName(found)
        hits = hits.groupBy("query_id", "id").agg(F.min("dist").alias("dist"))
        return topk_per_query(hits, k)

    def candidate_share(self, queries: DataFrame, k: int, nprobe: int, *, query_key: str = "id",
                        query_vec: str = "vec", forest: int = 0) -> float:
        """Mean share of the corpus that the probed cells of a query hold."""
        asked = self.probes(unit_vectors(queries, query_key, query_vec), k, nprobe, forest)
        sizes = self.centroids.filter(F.col("forest") == forest).select("cell", "n")
        total = sizes.agg(F.sum("n")).first()[0]
        asked = asked.select("id", F.explode("cells").alias("cell"))
        per_query = asked.join(F.broadcast(sizes), "cell").groupBy("id").agg(F.sum("n").alias("n"))
        return per_query.agg(F.avg("n")).first()[0] / total


def knn_approx(
    queries: DataFrame, corpus: DataFrame, k: int = 10, cells: int = 64, nprobe: int = 8, restarts: int = 1,
    **keys: str,
) -> DataFrame:
    """Build a cell index over the corpus and search it."""
    index = CellIndex.build(
        corpus, cells, key=keys.get("key", "id"), vec=keys.get("vec", "vec"), restarts=restarts
    )
    return index.search(
        queries, k, nprobe, query_key=keys.get("query_key", "id"), query_vec=keys.get("query_vec", "vec")
    )


def _all_tile_pairs(df: DataFrame, key: str, vec: str, keep_zero: bool) -> DataFrame:
    if keep_zero:
        points = df.select(F.col(key).cast("long").alias("id"), F.col(vec).alias("vec"))
    else:
        points = unit_vectors(df, key, vec)
    points = _one_cell(points)
    sizes = _sizes(points)
    return _tile_pairs(points, points, _salts(sizes, sizes))


def _reduce_tiles(pairs: DataFrame, schema: str, reduce_tile: Callable) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c) for c in ("l_ids", "l_vecs", "r_ids", "r_vecs")]
            for row in range(batch.num_rows):
                l_ids, l_vecs, r_ids, r_vecs = (c[row].values.to_numpy(zero_copy_only=False) for c in columns)
                yield reduce_tile(
                    l_ids, l_vecs.reshape(len(l_ids), -1), r_ids, r_vecs.reshape(len(r_ids), -1)
                )

    return pairs.select("l_ids", "l_vecs", "r_ids", "r_vecs").mapInArrow(run, schema)


def pairwise_cosine(df: DataFrame, key: str, vec: str) -> DataFrame:
    """Row summary of the full cosine matrix, self-pairs included: count, mean, minimum, maximum.

    The matrix exists only tile by tile inside the tasks. Zero vectors have no cosine and are left out.
    """
    def summary(l_ids, left, r_ids, right):
        cos = left @ right.T
        return pa.RecordBatch.from_arrays(
            [pa.array(l_ids), pa.array(np.full(len(l_ids), len(r_ids), "int64")), pa.array(cos.sum(axis=1)),
             pa.array(cos.min(axis=1)), pa.array(cos.max(axis=1))],
            names=["id", "n", "total", "low", "high"],
        )

    parts = _reduce_tiles(
        _all_tile_pairs(df, key, vec, keep_zero=False),
        "id long, n long, total double, low double, high double", summary,
    )
    rows = parts.groupBy("id").agg(
        F.sum("n").alias("n_pairs"), F.sum("total").alias("_total"),
        F.min("low").alias("min_cos"), F.max("high").alias("max_cos"),
    )
    return rows.select(
        F.col("id").alias(key), "n_pairs", (F.col("_total") / F.col("n_pairs")).alias("mean_cos"),
        "min_cos", "max_cos",
    )


def silhouette(df: DataFrame, key: str, vec: str, label: str, metric: str = "euclidean") -> DataFrame:
    """Mean silhouette; a point alone in its label scores 0.

    ``euclidean`` compares every pair of points. ``squaredEuclidean`` and ``cosine`` need one sum per label
    and are linear in the points.
    """
    if metric != "euclidean":
        return _linear_silhouette(df, vec, label, metric)
    labels = df.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"))
    points = df.select(
        F.col(key).cast("long").alias("id"), F.transform(vec, lambda x: x.cast("double")).alias("vec"),
        F.col(label).alias("label"),
    )
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"))
    # A tile of the right side holds one label, so each tile pair reduces to one sum per left point.
    codes = assign_dense_ids(sizes, ["label"], "cell").withColumn("cell", F.col("cell").cast("int"))
    salts = max(1, -(-labels.count() // ROWS_PER_SALT))
    salt = F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    right = pack_tiles(points.join(broadcast_if_small(codes), "label").select("cell", "id", "vec").withColumn("salt", salt))
    left = pack_tiles(_one_cell(points).withColumn("salt", salt))
    right = right.select("cell", F.col("salt").alias("r_salt"), every.alias("l_salt"), F.col("ids").alias("r_ids"), F.col("vecs").alias("r_vecs"))
    left = left.select(F.col("salt").alias("l_salt"), every.alias("r_salt"), F.col("ids").alias("l_ids"), F.col("vecs").alias("l_vecs"))
    pairs = left.join(right, ["l_salt", "r_salt"])

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c) for c in ("l_ids", "l_vecs", "r_ids", "r_vecs")]
            for row in range(batch.num_rows):
                l_ids, l_vecs, r_ids, r_vecs = (c[row].values.to_numpy(zero_copy_only=False) for c in columns)
                left_m, right_m = l_vecs.reshape(len(l_ids), -1), r_vecs.reshape(len(r_ids), -1)
                square = (left_m**2).sum(1)[:, None] + (right_m**2).sum(1)[None, :] - 2 * left_m @ right_m.T
                square[l_ids[:, None] == r_ids[None, :]] = 0.0
                total = np.sqrt(np.maximum(square, 0.0)).sum(axis=1)
                cell = np.full(len(l_ids), batch.column("cell")[row].as_py(), "int32")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(l_ids), pa.array(cell), pa.array(total)], names=["id", "cell", "total"]
                )

    sums = pairs.select("cell", "l_ids", "l_vecs", "r_ids", "r_vecs").mapInArrow(
        distances, "id long, cell int, total double"
    ).groupBy("id", "cell").agg(F.sum("total").alias("total"))
    other = codes.select("cell", F.col("label").alias("other"), F.col("n").alias("n_other"))
    scored = sums.join(broadcast_if_small(other), "cell").join(labels, "id")
    own = F.col("label") == F.col("other")
    per_point = scored.groupBy("id").agg(
        F.max(F.when(own, F.col("n_other"))).alias("n_own"),
        F.max(F.when(own & (F.col("n_other") > 1), F.col("total") / (F.col("n_other") - 1))).alias("a"),
        F.min(F.when(~own, F.col("total") / F.col("n_other"))).alias("b"),
    )
    widest = F.greatest("a", "b")
    score = F.when((F.col("n_own") == 1) | (widest == 0), F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / widest)
    return per_point.agg(F.avg(score).alias("silhouette"))


def _linear_silhouette(df: DataFrame, vec: str, label: str, metric: str) -> DataFrame:
    """By Spark's evaluator, which keeps a vector of sums for each label."""
    v = F.transform(vec, lambda x: x.cast("double"))
    codes = assign_dense_ids(df.select(label).distinct(), [label], "prediction")
    points = df.select(F.col(label), (l2_normalize(v) if metric == "cosine" else v).alias("v")).where("v is not null").join(codes, label)
    points = points.select(array_to_vector("v").alias("features"), F.col("prediction").cast("double").alias("prediction"))
    score = ClusteringEvaluator(distanceMeasure=metric).evaluate(points)
    return df.sparkSession.range(1).select(F.lit(float(score)).alias("silhouette"))
