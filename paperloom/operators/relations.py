"""Row selection, joins, sorts and unions on the papers table."""

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from paperloom.functions import fixed, lists, predicates, text
from paperloom.operators.windows import dedup_first
from paperloom.sources.store import absent_rows
from paperloom.staging import BROADCAST_BYTES, broadcast_if_small, stage

#: Tokens that a task looks up together, whatever the length of texts.
TOKEN_SLICE = 500_000


# --- filters -----------------------------------------------------------------------------------

def query_where(df: DataFrame, *preds: Column, order: Sequence[str], count: int = 10) -> DataFrame:
    """First ``count`` rows, by ``order``, that satisfy every predicate."""
    kept = df.filter(reduce(lambda a, b: a & b, preds)) if preds else df
    return kept.orderBy(*order).limit(count)


def drop_off_topic(df: DataFrame, cols: Sequence[str], words: Sequence[str]) -> DataFrame:
    return df.filter(~predicates.contains_any([F.col(c) for c in cols], words))


def drop_null_abstract(df: DataFrame) -> DataFrame:
    """Null test only; an empty abstract stays."""
    return df.filter(F.col("abstract").isNotNull())


# --- joins -------------------------------------------------------------------------------------

def exists_by_key(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_semi")


def absent_by_key(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_anti")


def lookup_ids(hits: DataFrame, papers: DataFrame, key: str = "id") -> DataFrame:
    """Stored rows of the neighbours, with query, rank and distance kept."""
    return papers.join(broadcast_if_small(hits), key)


def join_by_position(hits: DataFrame, entries: DataFrame, position: str = "id") -> DataFrame:
    """Entries at the given positions; the position is the dense id, never the physical row order."""
    return entries.join(broadcast_if_small(hits), position)


def expand_references(
    seeds: DataFrame, edges: DataFrame, papers: DataFrame, store: DataFrame, category: str,
    key: str = "bibcode",
) -> DataFrame:
    """Papers cited by the seeds, one hop, with an abstract and not stored yet.

    ``edges`` holds ``(citing, cited)``. Cited keys are made distinct before they meet the papers, so a
    paper that everybody cites costs one row.
    """
    cited = (
        edges.join(seeds.select(F.col(key).alias("citing")), "citing", "left_semi")
        .select(F.col("cited").alias(key)).distinct()
    )
    found = drop_null_abstract(papers.join(cited, key, "left_semi"))
    return absent_rows(found, store, key, [key]).withColumn("categories", F.lit(category))


def token_embedding_lookup(tokens: DataFrame, table: DataFrame, token: str = "token_id") -> DataFrame:
    """Static embedding row of every token."""
    return tokens.join(broadcast_if_small(table), token)


def lemma_lookup(tokens: DataFrame, lemmas: DataFrame, token: str = "token") -> DataFrame:
    """Lemma of every token, the token itself when the table has none."""
    pairs = lemmas.select(F.col("token").alias(token), F.col("lemma").alias("_lemma"))
    joined = tokens.join(broadcast_if_small(pairs), token, "left")
    return joined.withColumn("lemma", F.coalesce("_lemma", token)).drop("_lemma")


def _shared_lemmas(lemmas: DataFrame) -> dict[str, list[str]] | None:
    """Lemmas, in order, of every token of a table that is small enough for a broadcast, else None."""
    lemma = text.strip(F.lower(F.coalesce("lemma", "token")))
    table = lemmas.where("token is not null").groupBy("token").agg(F.array_sort(F.collect_list(lemma)).alias("lemmas"))
    table = stage(table, "lemmas")
    size = table.agg(F.sum(48 + F.octet_length("token") + F.octet_length(F.array_join("lemmas", " "))).alias("n")).first().n or 0
    return {r.token: r.lemmas for r in table.collect()} if size <= BROADCAST_BYTES else None


def _lemmas_of_row(df: DataFrame, column: str, known: dict[str, list[str]]) -> DataFrame:
    """``df`` with the lemmas of its tokens in ``_lemmas``, in place: the table travels with the tasks."""
    shared = df.sparkSession.sparkContext.broadcast(known)
    names = df.columns
    out = T.StructType(df.schema.fields + [T.StructField("_lemmas", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for batch in batches:
            for part in lists.slices(batch, "_tokens", TOKEN_SLICE):
                lemma = lists.replaced(part.column("_tokens"), lambda w: found.get(w) or [w], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), lemma], names=[*names, "_lemmas"])

    return df.withColumn("_tokens", text.raw_tokens(F.col(column))).mapInArrow(run, out)


def _joined_lemmas(df: DataFrame, key: str, column: str, lemmas: DataFrame, stop_words: Sequence[str]) -> DataFrame:
    """``(key, processed)`` by a join on tokens; the rows of a key are one group."""
    tokens = df.select(key, F.posexplode(text.raw_tokens(F.col(column))).alias("pos", "token"))
    lemma = text.strip(F.lower("lemma"))
    kept = lemma_lookup(tokens, lemmas).select(key, "pos", lemma.alias("lemma"))
    kept = kept.filter(text.keep_token(F.col("lemma"), stop_words))
    joined = kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "lemma"))).alias("_t"))
    return joined.select(key, F.array_join(F.transform("_t", lambda t: t["lemma"]), " ").alias("processed"))


def normalize_with_lemmas(
    df: DataFrame, key: str, column: str, lemmas: DataFrame, stop_words: Sequence[str] | None = None
) -> DataFrame:
    """Token normalisation of a text column through a lemma table; one group per text.

    A lemma table that is small travels with the tasks, and texts stay where they are; only the texts of a repeated key are
    brought together. A larger table meets the tokens by a join.
    """
    stop_words = text.default_stop_words() if stop_words is None else stop_words
    known = _shared_lemmas(lemmas)
    if known is None:
        joined = _joined_lemmas(df, key, column, lemmas, stop_words)
        return df.join(joined, key, "left").withColumn("processed", F.coalesce("processed", F.lit("")))
    kept = F.filter(F.transform("_lemmas", lambda w: text.strip(F.lower(w))), lambda w: text.keep_token(w, stop_words))
    own = F.when(F.col(key).isNotNull(), F.array_join(kept, " "))
    others = [c for c in df.columns if c != key]
    alone = _lemmas_of_row(df, column, known).select(key, *others, F.coalesce(own, F.lit("")).alias("processed"))
    repeated = stage(df.groupBy(key).agg(F.count("*").alias("_n")).where((F.col("_n") > 1) & F.col(key).isNotNull()).select(key), "repeated")
    if repeated.isEmpty():
        return alone
    group = stage(_joined_lemmas(df.join(broadcast_if_small(repeated), key, "left_semi"), key, column, lemmas, stop_words), "groups")
    both = alone.join(broadcast_if_small(group.withColumnRenamed("processed", "_group")), key, "left")
    return both.withColumn("processed", F.coalesce("_group", "processed")).drop("_group")


# --- sorts -------------------------------------------------------------------------------------

def search_sort(
    df: DataFrame, by: str = "score", key: str = "bibcode", max_pages: int = 15, page_size: int = 50
) -> DataFrame:
    """Best results first, capped at the requested pages."""
    return df.orderBy(F.desc_nulls_last(by), key).limit(max_pages * page_size)


def newest_first(df: DataFrame, year: str = "year", key: str = "bibcode") -> DataFrame:
    return df.orderBy(F.desc_nulls_last(year), key)


# --- unions ------------------------------------------------------------------------------------

def samples(min_length: int = 100) -> Column:
    """The abstract, and the full text where it is longer than ``min_length``, as an array."""
    long_text = F.when(predicates.min_chars(F.col("text"), min_length), F.col("text"))
    return F.array_compact(F.array("abstract", long_text))


def union_samples(df: DataFrame, min_length: int = 100) -> DataFrame:
    """One row per sample of every paper."""
    return df.withColumn("value", F.explode(samples(min_length)))


def union_ingest(seed: DataFrame, refs: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Search results, then references; the first row of a key wins."""
    both = seed.withColumn("_source", F.lit(0)).unionByName(refs.withColumn("_source", F.lit(1)))
    return dedup_first(both, [key], ["_source", *order]).drop("_source")


def format_search_result(df: DataFrame, query: str) -> DataFrame:
    """Scalar columns of a search response: first element of lists, whole year, query as category."""
    lists = {f.name for f in df.schema.fields if f.dataType.typeName() == "array"}

    def scalar(name: str) -> Column:
        c = F.try_element_at(name, F.lit(1)) if name in lists else F.col(name)
        return c.cast("string").alias(name)

    plain = [scalar(c) for c in ("bibcode", "title", "abstract", "pub")]
    rest = [F.col(c) for c in df.columns if c not in {"bibcode", "title", "abstract", "pub", "year", "keyword"}]
    return df.select(
        *plain, F.col("year").try_cast("int").alias("year"), F.lit(query).alias("categories"), *rest
    )


def journals_only(df: DataFrame, journals: Sequence[str] = fixed.JOURNALS) -> DataFrame:
    return df.filter(predicates.pub_in(F.col("pub"), journals))
