"""The operators with production parameters over their whole tables."""

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from paperloom.llm import byte_bpe, exact_copies, fertility, host_trust, languages, licenses, near_vectors, packing, periodic_runs, repeats, secrets, shingle_join, whitening
from paperloom.shipping import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, table: str, sql: str | None = None):
    def register(build):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return build(spark.read.parquet(f"{folder}/{table}.parquet"))

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return build

    return register


def vocabulary(name: str) -> bytes:
    """A file of the public vocabularies; the driver reads it and ships it, at most a few MB."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


def token_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@query("op2_secrets", "documents")
def op2_secrets(docs: DataFrame) -> DataFrame:
    return secrets.find_secrets(docs)


@query("op3_languages", "documents")
def op3_languages(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text", "lang")
    out = languages.held_out(F.col("doc_id"))
    model = languages.fit(docs, ~out)
    return languages.predict(docs.select("doc_id", "text"), model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


@query("op4_fertility", "documents")
def op4_fertility(docs: DataFrame) -> DataFrame:
    return fertility.judge(fertility.measure(docs, vocabulary("piece_bpe_32k.model")))


@query("op6_packing", "documents")
def op6_packing(docs: DataFrame) -> DataFrame:
    return packing.pack(packing.encode_pieces(docs, vocabulary("word_bpe_49k.json").decode(), lasting=True))


@query("op7_byte_bpe", "documents")
def op7_byte_bpe(docs: DataFrame) -> DataFrame:
    return byte_bpe.encode(docs, vocabulary("byte_bpe_multi_50k.tiktoken").decode(), token_pattern(), digest=True)


@query("op5_shingle_join", "documents")
def op5_shingle_join(docs: DataFrame) -> DataFrame:
    return shingle_join.near_duplicates(docs)


@query("op10_repeats", "documents")
def op10_repeats(docs: DataFrame) -> DataFrame:
    return repeats.digest(docs)


@query("op1_near_vectors", "embeddings")
def op1_near_vectors(vectors: DataFrame) -> DataFrame:
    return near_vectors.near_duplicates(vectors)


@query("op8_host_trust", "pages", host_trust.judge_sql())
def op8_host_trust(pages: DataFrame) -> DataFrame:
    return host_trust.judge(pages.select("page_id", "url", "html"))


@query("op9_licenses", "documents", licenses.licenses_sql())
def op9_licenses(docs: DataFrame) -> DataFrame:
    return licenses.find_licenses(docs)


@query("op11_exact_copies", "documents")
def op11_exact_copies(docs: DataFrame) -> DataFrame:
    return exact_copies.group_copies(docs)


@query("op12_whitening", "embeddings")
def op12_whitening(vectors: DataFrame) -> DataFrame:
    return whitening.whiten(vectors)


def periodic_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of the fixed rule: in a tenth of the documents, those from a place on repeat with a period."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    start = g % n
    period = 1 + (n - start) // (3 + g % 8)
    return words[:start] + [words[start + i % period] for i in range(n - start)]


@query("op13_periodic_runs", "documents")
def op13_periodic_runs(docs: DataFrame) -> DataFrame:
    return periodic_runs.digest(docs, periodic_tail)
