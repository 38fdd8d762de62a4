"""From papers to a search index, and from query texts to ranked papers and suggestions."""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from paperloom.functions import predicates, text
from paperloom.functions.vectors import angular_distance
from paperloom.operators import aggregates, features, neighbors, projections, relations, suggestions
from paperloom.operators.backoff import BackoffModel
from paperloom.operators.windows import assign_dense_ids, topk_per_query
from paperloom.sources.models import SearchIndex
from paperloom.staging import stage

SearchFunction = Callable[[DataFrame, int], DataFrame]


def similar_documents(queries: DataFrame, corpus: DataFrame, query_key: str, key: str, column: str = "text",
                      k: int = 10, max_features: int = 2**14) -> DataFrame:
    """Top-k documents by TF-IDF cosine, among those that share a term: ``(query_id, id, dist, rank)``.

    A small query set is scored where the documents lie. A larger one meets them term by term, and one
    partial score per (query, document) of a task is shuffled.
    """
    tokens = corpus.select(F.col(key).alias("id"), text.tfidf_tokens(F.col(column)).alias("tokens"))
    model = features.TfidfModel.from_table(aggregates.idf_table(tokens, max_features))
    asked = queries.select(F.col(query_key).alias("id"), text.tfidf_tokens(F.col(column)).alias("tokens"))
    found = neighbors.knn_sparse(model.transform(asked), model.transform(tokens), k)
    if found is not None:
        return found
    wanted = model.weights(asked, "id").select("term", F.col("id").alias("query_id"), F.col("weight").alias("q"))
    scores = (
        model.weights(tokens, "id").join(wanted, "term")
        .groupBy("query_id", "id").agg(F.sum(F.col("weight") * F.col("q")).alias("cos"))
    )
    return topk_per_query(scores.select("query_id", "id", angular_distance(F.col("cos")).alias("dist")), k)


def processed_text(papers: DataFrame, stop_words: Sequence[str] | None = None) -> DataFrame:
    """Fill in ``abstract_processed`` where it is missing."""
    done = F.when(
        predicates.unprocessed(F.col("abstract_processed")),
        text.normalize_tokens(F.coalesce("abstract", F.lit("")), stop_words),
    ).otherwise(F.col("abstract_processed"))
    return papers.withColumn("abstract_processed", done)


def build_index(papers: DataFrame, cells: int = 64, max_features: int = 2**14, variance: float = 0.6,
                components: int | None = None, restarts: int = 1,
                stop_words: Sequence[str] | None = None) -> SearchIndex:
    """Number the papers densely, learn vocabulary and projection, assign the vectors to cells."""
    # Numbering comes first: range partitioning samples its input, which must be cheap to scan twice.
    numbered = stage(processed_text(assign_dense_ids(papers, ["bibcode"]), stop_words), "papers")
    tokens = numbered.select("id", text.tfidf_tokens(F.col("abstract_processed")).alias("tokens"))
    tfidf = features.TfidfModel.from_table(aggregates.idf_table(tokens, max_features))
    weighted = stage(tfidf.transform(tokens).select("id", "features"), "features")
    pca = projections.fit_pca(weighted, "features", variance, components)
    vectors = projections.project(weighted, pca, "id", "features")
    return SearchIndex(tfidf, pca, neighbors.CellIndex.build(vectors, cells, restarts=restarts), numbered)


def embed_queries(queries: DataFrame, index: SearchIndex, query: Column | None = None, key: str = "query_id",
                  stop_words: Sequence[str] | None = None) -> DataFrame:
    """Query texts through the steps of the index: ``(key, vec)``."""
    query = F.col("query") if query is None else query
    tokens = queries.select(key, text.tfidf_tokens(text.normalize_tokens(query, stop_words)).alias("tokens"))
    return projections.project(index.tfidf.transform(tokens), index.pca, key, "features")


def search_function(index: SearchIndex, nprobe: int = 8, exact: bool = False,
                    stop_words: Sequence[str] | None = None) -> SearchFunction:
    """A callable ``(queries, k) -> hits`` over an index."""
    def search(queries: DataFrame, k: int) -> DataFrame:
        asked = embed_queries(queries, index, stop_words=stop_words)
        if exact:
            one_forest = index.cells.cells.filter("forest = 0")
            return neighbors.knn_exact(asked, one_forest, k, query_key="query_id")
        return index.cells.search(asked, k, nprobe, query_key="query_id")

    return search


def semantic_search(queries: DataFrame, papers: DataFrame, search: SearchFunction, k: int = 10) -> DataFrame:
    """Ranked papers per query: ``(query_id, rank, dist, id, bibcode, title, abstract)``."""
    hits = stage(search(queries, k), "hits")  # few rows, whose number decides the join with the papers
    found = relations.lookup_ids(hits, papers.select("id", "bibcode", "title", "abstract"))
    return found.select("query_id", "rank", "dist", "id", "bibcode", "title", "abstract")


def recommend(prompts: DataFrame, papers: DataFrame, search: SearchFunction, model: BackoffModel, n: int = 6,
              k: int = 10, context_chars: int = 200) -> tuple[DataFrame, DataFrame]:
    """Text suggestions from the end of each prompt, and papers similar to the whole prompt.

    ``model`` knows the tokens of :func:`tfidf_tokens`, which also split the prompts.
    """
    tail = text.tfidf_tokens(text.trim_context_chars(F.col("prompt"), context_chars))
    suggested = suggestions.suggest_next(prompts, model, tail, n)
    asked = prompts.select(F.col("prompt_id").alias("query_id"), F.col("prompt").alias("query"))
    return suggested, semantic_search(asked, papers, search, k)
