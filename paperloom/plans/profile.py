"""Publication, year and word statistics of the on-topic papers."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from paperloom.functions import fixed, predicates
from paperloom.operators import aggregates, relations


def on_topic(papers: DataFrame, words: Sequence[str] = fixed.PROFILE_OFF_TOPIC_WORDS) -> DataFrame:
    full = papers.filter(predicates.non_blank(F.col("title"), F.col("abstract")))
    return relations.drop_off_topic(full, ["title", "abstract"], words)


def profile_corpus(papers: DataFrame, words: Sequence[str] = fixed.PROFILE_OFF_TOPIC_WORDS,
                   n_publications: int = 15, n_words: int = 200, threshold: float = 30.0) -> dict[str, DataFrame]:
    """The statistics by name; each is one aggregation over a pruned scan of the papers."""
    kept = on_topic(papers, words)
    title = aggregates.title_words(F.col("title"))
    return {
        "publications": aggregates.top_publications(kept, n_publications),
        "years": aggregates.year_histogram(kept),
        "year_stats": aggregates.year_stats(kept),
        "words": aggregates.word_frequencies(kept, title, n_words),
        "bigrams": aggregates.bigram_collocations(kept, title, threshold),
    }
