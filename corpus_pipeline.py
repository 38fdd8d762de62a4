"""From raw documents to packed training sequences, in stages that each read what the one before kept.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes it as Parquet in the shared
folder and reads it back for the next. All but the last return the columns of documents.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from paperloom.llm import languages, packing, repeats, secrets, shingle_join
from paperloom.llm.queries import vocabulary
from paperloom.shipping import ship
from paperloom.staging import discarding, stage

#: Texts whose language is less certain than this go, and those without a letter.
LEAST_SCORE = 0.35
#: Text of a task that compares passages, and memory of a packing task, beside what executors hold from the stages before.
LEAN_BATCH = 3_000_000
LEAN = {"slice_bytes": 6_000_000, "kept_words": 200_000, "kept_pieces": 250_000}


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; it learns from the rows that op3 may learn from."""
    model = languages.fit(docs, ~languages.held_out(F.col("doc_id")))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "text")
    judged = languages.predict(whole, model).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return judged.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    return shingle_join.keep_first(docs)


def _sized(docs: DataFrame) -> DataFrame:
    """``docs`` whose ``n_chars``, where there is one, follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without words of passages that also start earlier; texts of nothing else go."""
    return _sized(repeats.remove(docs, batch_bytes=LEAN_BATCH))


def redacted_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a mark in the place of every secret."""
    return _sized(secrets.redact(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 4096 tokens."""
    return packing.pack(packing.encode_pieces(docs, vocabulary("word_bpe_49k.json").decode(), **LEAN))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("redacted_secrets", redacted_secrets),
    ("packed", packed),
]

#: Language, novelty of secrets and token ids can't be computed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        with discarding(spark) as keep:  # what the stage itself has staged goes when its result is written
            docs = keep(stage(step(spark, docs, sf_dir), f"pipeline-{name}"))
    return docs


QUERIES = {"pipeline": run}
SQL = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
