"""Lemmas of words that a lemma table lacks, by what its pairs do to the ends of words.

A pair of word and lemma is an edit: letters cut from the end, letters put in their place. For every ending up to a length,
the edit that most words with this ending take is kept; a word takes the edit of its longest known ending.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from paperloom.operators.relations import lemma_lookup
from paperloom.staging import broadcast_if_small, stage

#: Longest ending, fewest words that an ending's edit must serve, share of the ending's words that it must serve.
LONGEST, LEAST_WORDS, LEAST_SHARE = 6, 2, 0.3
#: Letters of the word that an edit leaves.
LEAST_STEM = 2


def _common(a: Column, b: Column) -> Column:
    """Number of equal letters at the beginning."""
    reach = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(0), reach), lambda n: F.substr(a, F.lit(1), n) == F.substr(b, F.lit(1), n))
    return F.array_max(same)


def _endings(word: Column, least: Column, longest: int) -> Column:
    sizes = F.filter(F.sequence(F.lit(1), F.lit(longest)), lambda n: (n >= least) & (n <= F.length(word)))
    return F.transform(sizes, lambda n: F.struct(n.alias("size"), F.right(word, n).alias("ending")))


def fit_endings(lemmas: DataFrame, longest: int = LONGEST, least_words: int = LEAST_WORDS, least_share: float = LEAST_SHARE) -> DataFrame:
    """``ending, cut, add, n`` from ``lemmas(token, lemma)``; ties go to the shorter cut, then the first letters in order."""
    pairs = lemmas.where("token is not null and lemma is not null and token <> ''").select("token", "lemma").distinct()
    edits = pairs.withColumn("kept", _common(F.col("token"), F.col("lemma"))).where(F.col("kept") >= LEAST_STEM)
    edits = edits.select("token", (F.length("token") - F.col("kept")).alias("cut"), F.substr("lemma", F.col("kept") + 1).alias("add"))
    rows = edits.select(F.inline(_endings(F.col("token"), F.greatest("cut", F.lit(1)), longest)).alias("size", "ending"), "cut", "add")
    counts = rows.groupBy("ending", "cut", "add").agg(F.count("*").alias("n"))
    # Endings are counted over all words that have them, also those whose edit reaches further back.
    every = pairs.select(F.inline(_endings(F.col("token"), F.lit(1), longest)).alias("size", "ending")).groupBy("ending").agg(F.count("*").alias("total"))
    best = Window.partitionBy("ending").orderBy(F.desc("n"), "cut", "add")
    kept = counts.withColumn("place", F.row_number().over(best)).where("place = 1").join(every, "ending")
    return kept.where((F.col("n") >= least_words) & (F.col("n") >= least_share * F.col("total"))).select("ending", "cut", "add", "n")


def lemmatise(words: DataFrame, endings: DataFrame, token: str = "token", longest: int = LONGEST) -> DataFrame:
    """``token, guess`` for distinct words; a word without a known ending, or too short for its edit, stays as it is."""
    rows = words.select(F.col(token).alias("token")).where("token is not null").distinct()
    asked = rows.select("token", F.inline(_endings(F.col("token"), F.lit(1), longest)).alias("size", "ending"))
    met = asked.join(broadcast_if_small(endings.select("ending", "cut", "add")), "ending")
    met = met.where(F.length("token") - F.col("cut") >= LEAST_STEM)
    top = met.groupBy("token").agg(F.max_by(F.struct("cut", "add"), "size").alias("edit"))
    edited = F.concat(F.left("token", F.length("token") - F.col("edit.cut")), F.col("edit.add"))
    return rows.join(top, "token", "left").select("token", F.coalesce(edited, "token").alias("guess"))


def lemmatise_tokens(tokens: DataFrame, lemmas: DataFrame, endings: DataFrame, token: str = "token") -> DataFrame:
    """``tokens`` with ``lemma``: from the table where it has the word, else by its ending. Endings meet each distinct word once."""
    unseen = tokens.select(token).distinct().join(lemmas.select(F.col("token").alias(token)), token, "left_anti")
    guessed = stage(lemmatise(unseen, endings, token), "guesses").select("token", F.col("guess").alias("lemma"))
    known = lemmas.select("token", "lemma").dropDuplicates(["token"])
    return lemma_lookup(tokens, known.unionByName(guessed), token)
