"""Pairs of near vectors by exact tile products of quantised components.

Unit vectors are rounded to 8-bit integers with one scale each. The rounding error of a vector has a known
length, so a product of two quantised vectors bounds the cosine from both sides; only pairs that may reach
the threshold are computed again in double precision. Tiles of a fixed number of vectors meet in an equi-join
on pairs of tile numbers, and a task holds two tiles at a time. Within a pair of tiles the links become counts
and a spanning forest, so a group of near vectors never leaves a task as pairs.

Nulls and odd rows: a vector that is null, empty, zero, or holds a null or a component that isn't finite links
with nothing, nor do vectors of different lengths; rows that share an id are one vertex, whose links add up
over its rows without those between them; a null id keeps its row and links with nothing; an empty table gives
an empty result; other columns are not read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from paperloom.llm.graph import components
from paperloom.staging import stage

THRESHOLD = 0.95
#: Vectors of a tile, rows of a block within it, dimensions whose integer products single precision holds.
TILE, BLOCK, EXACT_DIMS = 4096, 512, 1024


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Integers (as single precision), scale and rounding error of unit rows."""
    scale = np.maximum(np.abs(unit).max(axis=1), 1e-300) / 127.0
    whole = np.rint(unit / scale[:, None])
    return whole.astype(np.float32), scale, np.linalg.norm(unit - whole * scale[:, None], axis=1)


def near_pairs(one: np.ndarray, two: np.ndarray, threshold: float = THRESHOLD):
    """Indices ``(i, j)`` with cosine of at least ``threshold``, block by block.

    With rounding errors e and f and quantised lengths |q|, |r|: ``|x.y - q.r| <= e |r| + f`` for unit x, y.
    """
    unit = [x / np.linalg.norm(x, axis=1)[:, None] for x in (one, two)]
    (q, s, e), (r, t, f) = quantised(unit[0]), quantised(unit[1])
    length = np.linalg.norm(r * t[:, None], axis=1)
    for at in range(0, len(q), BLOCK):
        product = np.zeros((len(q[at : at + BLOCK]), len(r)), np.float32 if q.shape[1] <= EXACT_DIMS else np.float64)
        for d in range(0, q.shape[1], EXACT_DIMS):
            product += q[at : at + BLOCK, d : d + EXACT_DIMS] @ r[:, d : d + EXACT_DIMS].T
        own = slice(at, at + BLOCK)
        least = threshold - e[own].max(initial=0) * length.max(initial=0) - f.max(initial=0) - 1e-6
        # A cheap bound for the block first, then each pair's own.
        i, j = np.nonzero(product >= (least / s[own])[:, None] / t.max(initial=1e-300) if least > 0 else np.ones_like(product, bool))
        value = product[i, j].astype(float) * s[own][i] * t[j]
        open_ = value + e[own][i] * length[j] + f[j] + 1e-9 >= threshold
        i, j = i[open_] + at, j[open_]
        for part in range(0, len(i), 200_000):
            a, b = i[part : part + 200_000], j[part : part + 200_000]
            good = np.einsum("ij,ij->i", unit[0][a], unit[1][b]) >= threshold
            yield a[good], b[good]


def forest(pairs: np.ndarray, size: int) -> np.ndarray:
    """``label`` of every vertex 0..size-1: the smallest that it reaches over ``pairs``."""
    label = np.arange(size)
    while len(pairs):
        low = np.minimum(label[pairs[:, 0]], label[pairs[:, 1]])
        before = label.copy()
        for side in (0, 1):
            np.minimum.at(label, label[pairs[:, side]], low)
            np.minimum.at(label, pairs[:, side], low)
        label = label[label]
        if (label == before).all():
            break
    return label


FOUND = "vec_id long, links long, root long"


def tile_links(tiles: DataFrame, threshold: float = THRESHOLD, kind: str = "float") -> DataFrame:
    """Link counts and forest links of ``tiles(tile, n_tiles, ids, size, vectors)`` against each other."""
    left = tiles.select(F.col("tile").alias("i"), F.col("ids").alias("a_ids"), F.col("vectors").alias("a"), "size", F.explode(F.expr("sequence(tile, n_tiles - 1)")).alias("j"))
    right = tiles.select(F.col("tile").alias("tj"), F.col("size").alias("other"), F.col("ids").alias("b_ids"), F.col("vectors").alias("b"))
    met = left.repartition("i", "j").join(right, (left["j"] == right["tj"]) & (left["size"] == right["other"]))

    def run(batches):
        for batch in batches:
            for k in range(len(batch)):
                i, j, size = (batch.column(c)[k].as_py() for c in ("i", "j", "size"))
                ids = [np.frombuffer(batch.column(c)[k].as_buffer(), np.int64) for c in ("a_ids", "b_ids")]
                one, two = (np.frombuffer(batch.column(c)[k].as_buffer(), np.float32 if kind == "float" else np.float64).reshape(-1, size).astype(float) for c in ("a", "b"))
                both = np.unique(np.concatenate(ids))
                place = [np.searchsorted(both, x) for x in ids]
                links, edges = np.zeros(len(both), np.int64), [np.zeros((0, 2), np.int64)]
                for a, b in near_pairs(one, two, threshold):
                    a, b = place[0][a], place[1][b]
                    a, b = a[a != b], b[a != b]
                    links += np.bincount(a, minlength=len(both))
                    if i != j:
                        links += np.bincount(b, minlength=len(both))
                    label = forest(np.concatenate([*edges, np.stack([a, b], axis=1)]), len(both))
                    moved = np.flatnonzero(label != np.arange(len(both)))
                    edges = [np.stack([moved, label[moved]], axis=1)]
                label = forest(edges[0], len(both))
                some = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(both[some]), pa.array(links[some]), pa.array(both[label[some]])], names=["vec_id", "links", "root"])

    return met.select("i", "j", "size", "a_ids", "b_ids", "a", "b").mapInArrow(run, FOUND)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vectors(vec_id, embedding)``."""
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("v"))
    sound = (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    usable = stage(rows.where("vec_id is not null and v is not null").where(sound).withColumn("size", F.size("v")), "vectors")
    sizes = usable.groupBy("size").agg(F.expr(f"cast(ceil(count(*) / {tile}) as int)").alias("n_tiles"))
    dealt = usable.join(F.broadcast(sizes.limit(100_000)), "size") if sizes.limit(100_001).count() <= 100_000 else usable.join(sizes, "size")
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.col("n_tiles")).cast("int"))

    def tiled(key, table):
        ids = table.column("vec_id").to_numpy()
        values = table.column("v").combine_chunks().flatten().to_numpy().astype(np.float32 if kind == "float" else np.float64)
        size, tile_, n_tiles = (table.column(c)[0] for c in ("size", "tile", "n_tiles"))
        return pa.table({"size": [size.as_py()], "tile": [tile_.as_py()], "n_tiles": [n_tiles.as_py()], "ids": [ids.tobytes()], "vectors": [values.tobytes()]}, schema=pa.schema([("size", pa.int32()), ("tile", pa.int32()), ("n_tiles", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary())]))

    tiles = stage(dealt.groupBy("size", "tile").applyInArrow(tiled, "size int, tile int, n_tiles int, ids binary, vectors binary"), "tiles")
    found = stage(tile_links(tiles, threshold, kind), "near")
    counted = found.groupBy("vec_id").agg(F.sum("links").alias("n_links"))
    joined = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")).where("a <> b"))
    out = rows.select("vec_id").join(counted, "vec_id", "left").join(joined.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
