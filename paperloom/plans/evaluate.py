"""Embedding papers, and measuring how well an encoder separates document categories."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from paperloom.functions import text
from paperloom.functions.vectors import vector_to_csv
from paperloom.operators import aggregates, clusters, features, neighbors, projections
from paperloom.operators.descent import descend
from paperloom.operators.layout import spectral_layout
from paperloom.operators.windows import assign_dense_ids
from paperloom.sources.readers import read_markdown_dir
from paperloom.sources.sinks import write_scores_json
from paperloom.sources.store import update_by_key
from paperloom.staging import stage

Encoder = Callable[[DataFrame, str], DataFrame]


def embed_papers(papers: DataFrame, encoder: Encoder = features.encode_text) -> DataFrame:
    """New content of the papers table with ``abstract_embedding`` as comma-separated text."""
    encoded = encoder(papers.select("bibcode", "abstract"), "abstract")
    updates = encoded.select("bibcode", vector_to_csv(F.col("embedding")).alias("abstract_embedding"))
    return update_by_key(papers, updates, "bibcode", ["abstract_embedding"])


def chunk_documents(docs: DataFrame, chunker: Callable[[Column], Column], normalize: bool = False) -> DataFrame:
    """``(file, text)`` markdown documents to ``(file, chunk_ix, chunk, category, label)``."""
    plain = text.markdown_to_text(F.col("text"))
    plain = text.normalize_tokens(plain) if normalize else plain
    labelled = docs.select("file", plain.alias("plain"), text.category_from_name(F.col("file")).alias("category"))
    chunks = labelled.select("file", "category", F.posexplode(chunker(F.col("plain"))).alias("chunk_ix", "chunk"))
    return aggregates.label_encode(chunks, "category")


def evaluate_embeddings(
    docs: DataFrame, chunking: int | str | Callable[[Column], Column] = 100, encoder: Encoder = features.encode_text,
    normalize: bool = False, neighbors_k: int = 10, metric: str = "squaredEuclidean", graph: str = "cells", cells: int = 64, nprobe: int = 8,
) -> dict[str, DataFrame | Callable[[], DataFrame]]:
    """Scores, category similarities, projections, neighbour edges of the encoded chunks and the layout of these.

    The work is linear in the chunks. All pairs are compared on request: ``metric="euclidean"`` for the silhouette,
    ``graph="exact"`` for the neighbours, which are looked for in the cells of an index; ``graph="descent"`` needs none. ``layout`` is a callable that
    makes the layout, since it takes many passes over the edges.
    """
    chunks = chunk_documents(docs, text.chunker(chunking), normalize)
    points = encoder(chunks, "chunk").filter(F.col("embedding").isNotNull())
    points = stage(assign_dense_ids(stage(points, "chunks"), ["file", "chunk_ix"]), "points")
    scores = [
        neighbors.silhouette(points, "id", "embedding", "label", metric),
        clusters.davies_bouldin(points, "embedding", "label"),
        clusters.calinski_harabasz(points, "embedding", "label"),
    ]
    if graph == "descent":
        edges = descend(points, neighbors_k, key="id", vec="embedding")[0]
    else:
        index = neighbors.CellIndex.build(points, cells, key="id", vec="embedding") if graph == "cells" else None
        edges = neighbors.knn_graph(points, neighbors_k, key="id", vec="embedding", index=index, nprobe=nprobe)
    edges = stage(edges, "neighbours")
    return {
        "points": points,
        "scores": points.sparkSession.range(1).select(*[s.scalar().alias(s.columns[0]) for s in scores]),
        "category_cosine": clusters.category_cosine_matrix(points, "embedding", "category"),
        "in_out": clusters.in_out_similarity(points, "embedding", "category"),
        "pca": projections.pca_2d(points, "id", "embedding"),
        "lda": projections.lda_2d(points, "id", "embedding", "label"),
        "neighbors": edges,
        "layout": lambda: spectral_layout(edges),
    }


def evaluate_folder(spark: SparkSession, folder: str, scores_path: str, **options) -> dict[str, DataFrame]:
    """Evaluate the markdown files of a folder and write the scores as JSON."""
    results = evaluate_embeddings(read_markdown_dir(spark, folder), **options)
    write_scores_json(results["scores"], scores_path)
    return results
