"""Counts, histograms, vocabularies and word statistics."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from paperloom.functions import fixed, predicates, text
from paperloom.operators.windows import assign_dense_ids
from paperloom.staging import stage


#: Words whose counts travel with the tasks that score pairs: 16 bytes each.
_FREQUENT = 200_000


def count_rows(df: DataFrame, column: str) -> DataFrame:
    """All rows, and rows whose ``column`` is not empty (null counts as empty)."""
    return df.agg(
        F.count("*").alias("n_rows"), F.count_if(F.col(column) != "").alias("n_filled")
    )


def corpus_counts(df: DataFrame, kept: Column) -> DataFrame:
    return df.agg(F.count("*").alias("n_read"), F.count_if(kept).alias("n_kept"))


def top_publications(df: DataFrame, n: int = 15, pub: str = "pub") -> DataFrame:
    counts = df.groupBy(pub).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), pub).limit(n)


def year_histogram(df: DataFrame, year: str = "year") -> DataFrame:
    """Unit bins from the first to the last year; the last bin is closed, so it takes both end years.

    Data is reduced to one row per year first; everything after that works on the year table.
    """
    years = df.filter(F.col(year).isNotNull()).groupBy(F.col(year).alias("_y")).agg(F.count("*").alias("_n"))
    folded = years.select(
        F.least("_y", F.max("_y").over(Window.partitionBy()) - 1).alias("bin"), "_n",
        F.min("_y").over(Window.partitionBy()).alias("_lo"), F.max("_y").over(Window.partitionBy()).alias("_hi"),
    ).filter("_hi > _lo")
    bounds = folded.agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")).filter("_hi is not null")
    bins = bounds.select(F.explode(F.sequence(F.col("_lo"), F.col("_hi") - 1)).alias("bin"))
    counts = folded.groupBy("bin").agg(F.sum("_n").alias("_n"))
    return bins.join(counts, "bin", "left").select("bin", F.coalesce("_n", F.lit(0)).alias("n"))


def year_stats(df: DataFrame, year: str = "year") -> DataFrame:
    mean, std = F.avg(year), F.stddev_pop(year)
    return df.agg(
        F.count(year).alias("n"), mean.alias("mean"), std.alias("std"),
        F.min(year).alias("min_year"), F.max(year).alias("max_year"),
        (mean - 3 * std).alias("lower_bound"),
    )


def title_words(title: Column, noise: Sequence[str] = fixed.TITLE_NOISE) -> Column:
    """Words of a title between single spaces, without the noise words."""
    return predicates.drop_tokens_containing(F.split(title, " "), noise)


def word_frequencies(df: DataFrame, words: Column, n: int = 200) -> DataFrame:
    """Most frequent words with their count and their share of the largest count."""
    counts = df.select(F.explode(words).alias("word")).filter("word != ''")
    top = counts.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(n)
    return top.withColumn("relative", F.col("n") / F.max("n").over(Window.partitionBy()))


def _log_likelihood(k: Column, n: Column, p: Column) -> Column:
    tiny = F.lit(1e-10)
    return F.log(F.greatest(p, tiny)) * k + F.log(F.greatest(1 - p, tiny)) * (n - k)


def _word_number(word: Column, seed: int) -> Column:
    return F.xxhash64(word, F.lit(seed))


def _clear_seed(words: DataFrame) -> int:
    """The first seed that gives all distinct words of a staged table numbers of their own."""
    n, seed = words.count(), 0
    while words.select(_word_number(F.col("word"), seed).alias("id")).distinct().count() < n:
        seed += 1
    return seed


def _dunning(pair: Column, first: Column, second: Column, total: Column) -> Column:
    c12, c1, c2, n = (c.cast("double") for c in (pair, first, second, total))
    p, p1, p2 = c2 / n, c12 / c1, (c2 - c12) / F.greatest(n - c1, F.lit(1e-10))
    ratio = (
        _log_likelihood(c12, c1, p) + _log_likelihood(c2 - c12, n - c1, p)
        - _log_likelihood(c12, c1, p1) - _log_likelihood(c2 - c12, n - c1, p2)
    )
    return F.when((n <= c1) | (n <= c2), F.lit(0.0)).otherwise(-2 * ratio)


def bigram_collocations(df: DataFrame, words: Column, threshold: float = 30.0) -> DataFrame:
    """Adjacent word pairs whose Dunning log-likelihood score exceeds the threshold.

    Pairs are counted, joined and scored by numbers of words, which no two words share; only pairs above the threshold get their
    words back. The counts of the most frequent words travel with the tasks: a pair of two of them that is below the threshold is not joined.
    """
    tokens = df.select(F.filter(words, lambda w: w != "").alias("w"))
    unigrams = tokens.select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    unigrams = stage(unigrams, "unigrams")
    total = unigrams.agg(F.sum("n").alias("total")).scalar()
    seed = _clear_seed(unigrams)
    numbered = unigrams.select(_word_number(F.col("word"), seed).alias("id"), "word", "n")
    room = F.greatest(F.size("w") - 1, F.lit(0))
    pairs = F.arrays_zip(F.slice("w", F.lit(1), room).alias("a"), F.slice("w", F.lit(2), room).alias("b"))
    bigrams = (
        tokens.select(F.transform("w", lambda w: _word_number(w, seed)).alias("w")).select(F.inline(pairs).alias("a", "b"))
        .groupBy("a", "b").agg(F.count("*").alias("n_pair"))
    )
    frequent = numbered.select("id", "n").orderBy(F.desc("n")).limit(_FREQUENT)
    for word in ("a", "b"):
        bigrams = bigrams.join(F.broadcast(frequent.select(F.col("id").alias(word), F.col("n").alias(f"_n_{word}"))), word, "left")
    early = _dunning(F.col("n_pair"), F.col("_n_a"), F.col("_n_b"), total)
    open_pairs = bigrams.filter(F.col("_n_a").isNull() | F.col("_n_b").isNull() | (early > threshold)).select("a", "b", "n_pair")
    score = _dunning(F.col("n_pair"), F.col("n_first"), F.col("n_second"), total)
    return (
        open_pairs.join(numbered.select(F.col("id").alias("a"), F.col("n").alias("n_first")), "a")
        .join(numbered.select(F.col("id").alias("b"), F.col("n").alias("n_second")), "b")
        .withColumn("score", score).filter(F.col("score") > threshold)
        .join(numbered.select(F.col("id").alias("a"), F.col("word").alias("first")), "a")
        .join(numbered.select(F.col("id").alias("b"), F.col("word").alias("second")), "b")
        .select("first", "second", "n_pair", "n_first", "n_second", "score")
    )


def term_counts(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Corpus frequency and document frequency of every term.

    Each row emits its tokens and, marked, its distinct tokens, so one aggregation with map-side
    combining yields both counts; (document, term) pairs are never shuffled.
    """
    every = F.transform(tokens, lambda t: F.struct(t.alias("term"), F.lit(1).alias("tf"), F.lit(0).alias("df")))
    once = F.transform(
        F.array_distinct(tokens), lambda t: F.struct(t.alias("term"), F.lit(0).alias("tf"), F.lit(1).alias("df"))
    )
    return (
        docs.select(F.inline(F.concat(every, once)))
        .groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    )


def term_vocabulary(docs: DataFrame, max_features: int = 2**14, tokens: str = "tokens") -> DataFrame:
    """The most frequent terms of the corpus; ties go to the smaller term."""
    return term_counts(docs, tokens).orderBy(F.desc("tf"), "term").limit(max_features)


def idf_table(docs: DataFrame, max_features: int = 2**14, tokens: str = "tokens") -> DataFrame:
    """Vocabulary with smooth inverse document frequency."""
    n_docs = docs.agg(F.count("*").alias("n")).scalar()
    idf = F.log((1 + n_docs) / (1 + F.col("df"))) + 1
    return term_vocabulary(docs, max_features, tokens).withColumn("idf", idf)


def label_encode(df: DataFrame, column: str, label: str = "label") -> DataFrame:
    """Integer label per category, by the sorted order of the distinct categories."""
    codes = assign_dense_ids(df.select(column).distinct(), [column], label)
    return df.join(codes.withColumn(label, F.col(label).cast("int")), column)


def ngrams(tokens: Column, n: int) -> Column:
    """Consecutive runs of ``n`` tokens."""
    return text.bind(tokens, lambda t: F.when(
        F.size(t) >= n,
        F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.slice(t, i, F.lit(n))),
    ))


def ngram_counts(df: DataFrame, tokens: Column, n: int = 2) -> DataFrame:
    """How often each token follows each context of ``n - 1`` tokens, and its share."""
    room = F.greatest(F.size("w") - (n - 1), F.lit(0))
    names = [f"_{i}" for i in range(n)]
    grams = F.arrays_zip(*[F.slice("w", F.lit(i + 1), room).alias(c) for i, c in enumerate(names)])
    context = F.concat_ws(" ", *names[:-1]).alias("context")
    counts = (
        df.select(tokens.alias("w")).select(F.inline(grams).alias(*names)).select(context, F.col(names[-1]).alias("next"))
        .groupBy("context", "next").agg(F.count("*").alias("n"))
    )
    total = F.sum("n").over(Window.partitionBy("context"))
    return counts.select("context", "next", "n", (F.col("n") / total).alias("share"))
