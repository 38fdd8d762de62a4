"""Sentence boundaries learnt from a corpus: which words with a period are abbreviations, which words begin sentences.

The scores are log-likelihood ratios of corpus counts. A type is an abbreviation when it nearly always carries its
period, is short and holds more periods; a word begins sentences when it follows sure boundaries more often than chance; two words that
stand around a period more often than chance belong together. What is learnt is applied to a column, row by row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from paperloom.functions import text
from paperloom.staging import broadcast_if_small, stage

#: Least scores of abbreviations, sentence starters and pairs around a period; most entries of each list.
ABBREVIATION, STARTER, PAIR, MOST = 0.3, 30.0, 7.88, 20_000
#: A character that no text holds marks boundaries.
_MARK = chr(0xFDD0)
_OPEN, _CLOSE = r"^[(\[{\"'“‘«]+", r"[)\]}\"'”’»,;:]+$"


def words(c: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def bare(word: Column) -> Column:
    """Lower case, without brackets and quotes around it."""
    return F.regexp_replace(F.regexp_replace(F.lower(word), _OPEN, ""), _CLOSE, "")


def _type(word: Column) -> Column:
    return F.regexp_replace(bare(word), r"\.$", "")


def _capital(word: Column) -> Column:
    return F.regexp_replace(word, _OPEN, "").rlike(r"^\p{Lu}")


def _parts(c: Column) -> Column:
    """A text up to and from each place where a sentence may end."""
    return F.split(c, r"(?<=[.!?])(?=\s)")


def _last(part: Column) -> Column:
    return F.regexp_extract(part, r"(\S+)$", 1)


def _following(part: Column) -> Column:
    return F.regexp_extract(part, r"^\s+(\S+)", 1)


def _ratio(both: Column, first: Column, second: Column, total: Column) -> Column:
    """Log-likelihood ratio of two words next to each other, 0 when they meet no more often than chance."""
    def fit(k: Column, n: Column, p: Column) -> Column:
        p = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
        return k * F.log(p) + (n - k) * F.log(1 - p)

    both, first, second, total = (x.cast("double") for x in (both, first, second, total))
    rest = F.greatest(total - first, F.lit(1e-9))
    p, p1, p2 = second / total, both / first, F.greatest(second - both, F.lit(0.0)) / rest
    score = -2 * (fit(both, first, p) + fit(second - both, rest, p) - fit(both, first, p1) - fit(second - both, rest, p2))
    return F.when(both / first > p, score).otherwise(0.0)


def abbreviation_scores(df: DataFrame, column: Column) -> DataFrame:
    """``type, with_period, without, score`` for every word that occurs with a period at its end."""
    token = df.select(F.explode(words(column)).alias("w")).select(bare(F.col("w")).alias("w")).where("w <> ''")
    period = F.endswith("w", F.lit(".")) & ~F.endswith("w", F.lit("..")) & (F.length("w") > 1)
    counts = token.select(F.when(period, F.expr("left(w, length(w) - 1)")).otherwise(F.col("w")).alias("type"), period.alias("period"))
    counts = stage(counts.groupBy("type").agg(F.count(F.when(F.col("period"), 1)).alias("with_period"), F.count(F.when(~F.col("period"), 1)).alias("without")), "types")
    total = counts.agg(F.sum("with_period").alias("k"), F.sum(F.col("with_period") + F.col("without")).alias("n"))
    share = total.select(F.col("k") / F.col("n")).scalar()
    k, n = F.col("with_period").cast("double"), (F.col("with_period") + F.col("without")).cast("double")
    p = F.least(F.greatest(share, F.lit(1e-12)), F.lit(1 - 1e-12))
    fit = lambda p: k * F.log(p) + (n - k) * F.log(1 - p)
    periods = F.length("type") - F.length(F.replace("type", F.lit("."), F.lit("")))
    letters = F.length("type") - periods
    score = -2 * (fit(p) - fit(F.lit(0.99))) * F.exp(-letters.cast("double")) * (periods + 1) * F.pow(letters.cast("double"), -F.col("without").cast("double"))
    named = counts.where(F.col("with_period") > 0).where(F.col("type").rlike(r"\p{L}") & ~F.col("type").rlike(r"\d"))
    return named.select("type", "with_period", "without", score.alias("score"))


@dataclass
class SentenceModel:
    """Abbreviations, words that begin sentences, and pairs ``first second`` with no boundary between."""

    abbreviations: list[str]
    starters: list[str]
    pairs: list[str]

    def chunks(self, c: Column) -> Column:
        """The sentences of a text. A period after an abbreviation ends one only before a capitalised word that begins
        sentences, and not within a known pair."""
        parts = _parts(c)

        def ends(p: Column, i: Column) -> Column:
            word, next_ = _last(p), _following(F.get(parts, i + 1))
            type_, next_type = _type(word), _type(next_)
            short = F.endswith(word, F.lit(".")) & type_.isin(self.abbreviations or [""]) & (type_ != "")
            start = _capital(next_) & next_type.isin(self.starters or [""]) & ~F.concat_ws(" ", type_, next_type).isin(self.pairs or [""])
            return ~short | start

        final = F.size(parts) - 1
        marked = F.transform(parts, lambda p, i: F.when((i < final) & ends(p, i), F.concat(p, F.lit(_MARK))).otherwise(p))
        return F.split(F.array_join(marked, ""), _MARK + r"\s*")


@dataclass
class SentenceTables:
    """What a model holds, as tables of any size: ``abbreviations(type)``, ``starters(type)``, ``pairs(first, second)``."""

    abbreviations: DataFrame
    starters: DataFrame
    pairs: DataFrame


def learn_sentences(df: DataFrame, column: str, abbreviation: float = ABBREVIATION, starter: float = STARTER, pair: float = PAIR) -> SentenceTables:
    """Learn from the texts of ``column``; the lists grow with the vocabulary and stay tables."""
    c = F.col(column)
    scores = abbreviation_scores(df, c)
    abbreviations = stage(scores.where(F.col("score") >= abbreviation).select("type"), "abbreviations")
    neighbours = df.select(words(c).alias("w")).select(F.inline(F.arrays_zip(
        F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))).alias("a"), F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))).alias("b"))).alias("a", "b"))
    told = neighbours.select(
        _type(F.col("a")).alias("a"), _type(F.col("b")).alias("b"), F.endswith("a", F.lit(".")).alias("period"), F.col("a").rlike(r"[!?]$").alias("ends"),
    ).groupBy("a", "b", "period", "ends").agg(F.count("*").alias("n"))
    short = broadcast_if_small(abbreviations.select(F.col("type").alias("a"), F.lit(True).alias("short")))
    sure = (F.col("period") & F.col("short").isNull()) | F.col("ends")
    told = stage(told.join(short, "a", "left").select("a", "b", "period", sure.alias("sure"), F.col("short").isNotNull().alias("short"), "n"), "neighbours")
    total = told.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("sure"), F.col("n"))).alias("sure")).first()
    every, sure = F.lit(total.n or 0), F.lit(total.sure or 0)
    types = stage(told.groupBy("b").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("sure"), F.col("n")).otherwise(0)).alias("k")), "types")
    begins = types.where("k > 0").where(_ratio(F.col("k"), sure, F.col("n"), every) >= starter).where(F.col("b").rlike(r"^\p{L}"))
    starters = stage(begins.select(F.col("b").alias("type")), "starters")
    both = told.where("period and short").groupBy("a", "b").agg(F.sum("n").alias("both")).where("both > 1")
    firsts = told.where("period and short").groupBy("a").agg(F.sum("n").alias("first"))
    around = both.join(firsts, "a").join(types.select("b", F.col("n").alias("second")), "b")
    around = around.where(_ratio(F.col("both"), F.col("first"), F.col("second"), every) >= pair)
    around = around.join(broadcast_if_small(starters.select(F.col("type").alias("b"))), "b", "left_anti")
    return SentenceTables(abbreviations, starters, stage(around.select(F.col("a").alias("first"), F.col("b").alias("second")), "pairs"))


def fit_sentences(df: DataFrame, column: str, abbreviation: float = ABBREVIATION, starter: float = STARTER, pair: float = PAIR) -> SentenceModel:
    """What :func:`learn_sentences` learns as a model for one expression. More than ``MOST`` entries of a list are refused."""
    found = learn_sentences(df, column, abbreviation, starter, pair)
    return SentenceModel(
        _listed(found.abbreviations.select(F.col("type").alias("entry"))), _listed(found.starters.select(F.col("type").alias("entry"))),
        _listed(found.pairs.select(F.concat_ws(" ", "first", "second").alias("entry"))),
    )


def split_sentences(df: DataFrame, column: str, found: SentenceTables, output: str = "sentences") -> DataFrame:
    """``df`` with the sentences of each text, as :meth:`SentenceModel.chunks` finds them, for lists of any size.

    Only periods after abbreviations meet the other lists. The places where no sentence ends are a function of the text, so they
    come back by its hash, one row for each different text that has any.
    """
    c = F.col(column)
    final = lambda parts: F.size(parts) - 1
    ask = lambda parts: F.transform(F.filter(F.sequence(F.lit(0), final(parts)), lambda i: (i < final(parts)) & F.endswith(_last(F.get(parts, i)), F.lit("."))),
                                    lambda i: F.struct(i.alias("i"), _last(F.get(parts, i)).alias("word"), _following(F.get(parts, i + 1)).alias("next")))
    periods = df.where(c.isNotNull()).select(F.sha2(c, 256).alias("_text"), F.inline(text.bind(_parts(c), ask)))
    periods = periods.select("_text", "i", _type(F.col("word")).alias("first"), _type(F.col("next")).alias("second"), _capital(F.col("next")).alias("capital")).where("first <> ''")
    doubtful = stage(periods.join(broadcast_if_small(found.abbreviations.select(F.col("type").alias("first"))), "first", "left_semi").distinct(), "doubtful")
    starts = doubtful.where("capital").join(broadcast_if_small(found.starters.select(F.col("type").alias("second"))), "second", "left_semi")
    starts = starts.join(broadcast_if_small(found.pairs), ["first", "second"], "left_anti")
    held = doubtful.join(starts.select("_text", "i"), ["_text", "i"], "left_anti").groupBy("_text").agg(F.collect_list("i").alias("_held"))
    held = stage(held, "held")
    met = df.withColumn("_text", F.sha2(c, 256)).join(broadcast_if_small(held), "_text", "left")

    def cut(both: Column) -> Column:
        parts, ends = both["parts"], both["ends"]
        begin = lambda j: F.coalesce(F.try_element_at(ends, j) + 1, F.lit(0))  # noqa: E731  after the end before
        sentence = lambda e, j: F.array_join(F.slice(parts, F.when(j > 0, begin(j)).otherwise(0) + 1, e - F.when(j > 0, begin(j)).otherwise(0) + 1), "")
        return F.transform(ends, lambda e, j: F.when(j > 0, F.regexp_replace(sentence(e, j), r"^\s+", "")).otherwise(sentence(e, j)))

    ends = lambda parts: F.array_except(F.sequence(F.lit(0), final(parts)), F.coalesce("_held", F.array().cast("array<int>")))
    whole = text.bind(text.bind(_parts(c), lambda parts: F.struct(parts.alias("parts"), ends(parts).alias("ends"))), cut)
    return met.withColumn(output, F.when(c.isNotNull(), whole)).drop("_text", "_held")


def _listed(entries: DataFrame) -> list[str]:
    found = [r.entry for r in entries.distinct().orderBy("entry").limit(MOST + 1).collect()]
    if len(found) > MOST:
        raise ValueError(f"more than {MOST} entries: the corpus is no running text, or the least score is too low")
    return found


def learnt_chunker(model: SentenceModel):
    """For the places that take a chunking expression."""
    return model.chunks


