"""Curated training text, and article bodies for the papers table."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from paperloom.functions import fixed, predicates, text
from paperloom.operators import relations
from paperloom.sources.sinks import write_text_corpus
from paperloom.sources.store import delete_where, update_by_key


def curated_papers(papers: DataFrame, words: Sequence[str] = fixed.OFF_TOPIC_WORDS) -> DataFrame:
    """Papers that stay: with title and abstract, and without an off-topic word anywhere."""
    full = papers.filter(predicates.non_blank(F.col("title"), F.col("abstract")))
    return relations.drop_off_topic(full, ["title", "abstract", "text"], words)


def curate_corpus(papers: DataFrame, words: Sequence[str] = fixed.OFF_TOPIC_WORDS, safe: bool = False,
                  min_bytes: int = 100) -> DataFrame:
    """Clean corpus samples in column ``value``: abstracts, and full texts that are long enough."""
    # The cleaned samples leave a generator, so the filters on them are not evaluated below it again.
    filled = F.filter(relations.samples(), lambda s: s != "")
    cleaned = F.transform(filled, lambda s: text.corpus_sample(s, safe))
    rows = curated_papers(papers, words).select(*papers.columns, F.inline(cleaned))
    return rows.filter(F.col("spaced") & (F.col("n_bytes") > min_bytes)).drop("n_bytes", "spaced")


def curate_to_files(papers: DataFrame, corpus_path: str, papers_path: str, words: Sequence[str] = fixed.OFF_TOPIC_WORDS,
                    safe: bool = False, min_bytes: int = 100) -> dict[str, int]:
    """The whole job: write the lines of the corpus and the papers without the off-topic ones; return counts.

    ``read`` papers, ``deleted`` ones (title and abstract, but off topic), ``kept`` ones that gave samples.
    """
    off_topic = predicates.non_blank(F.col("title"), F.col("abstract")) & predicates.contains_any(
        [F.col(c) for c in ("title", "abstract", "text")], words)
    delete_where(papers, off_topic).write.parquet(papers_path)
    write_text_corpus(curate_corpus(papers, words, safe, min_bytes), corpus_path)
    read, deleted = papers.agg(F.count("*"), F.count(F.when(off_topic, 1))).first()
    return {"read": read, "deleted": deleted, "kept": curated_papers(papers, words).count()}


def extract_bodies(papers: DataFrame, texts: DataFrame, words: Sequence[str] = fixed.BODY_OFF_TOPIC_WORDS) -> DataFrame:
    """New content of the papers table with the main section of the supplied texts filled in.

    ``texts(bibcode, body)`` holds extracted article text; only unprocessed papers of supported journals are
    touched.
    """
    todo = relations.journals_only(papers).filter(
        predicates.unprocessed(F.col("text")) & predicates.non_blank(F.col("title"), F.col("abstract"))
    )
    todo = relations.drop_off_topic(todo, ["title", "abstract"], words)
    bodies = todo.select("bibcode", "pub").join(texts, "bibcode")
    body = text.cleanup_pdf_text(text.journal_body(F.col("body"), F.col("pub")))
    return update_by_key(papers, bodies.select("bibcode", body.alias("text")), "bibcode", ["text"])
