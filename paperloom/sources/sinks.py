"""Writers: text corpus, score files, JSON rows."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from paperloom.functions import text


def corpus_line(c: Column) -> Column:
    """A sample as one line: line breaks become spaces, outer white space goes."""
    return text.strip(F.regexp_replace(c, r"[\r\n]+", " "))


def write_text_corpus(df: DataFrame, path: str, column: str = "value") -> None:
    df.select(corpus_line(F.col(column)).alias("value")).write.text(path)


def write_scores_json(scores: DataFrame, path: str) -> None:
    """One JSON object per row, metric name to value."""
    scores.write.json(path)


def rows_to_json(keys: Sequence[str]) -> Column:
    """Row as JSON in the given key order, nulls included."""
    return F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
