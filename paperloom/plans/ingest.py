"""Filling the papers table: from a metadata dump, and from search results with their references."""

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from paperloom import schema
from paperloom.functions import fixed, predicates, text
from paperloom.operators import relations
from paperloom.sources import readers, store


def _as_papers(df: DataFrame) -> DataFrame:
    """All columns of the papers table, missing ones null."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.PAPERS.fields
    ])


def metadata_to_papers(df: DataFrame, mapping: Mapping[str, str] = fixed.CATEGORY_NAMES,
                       strict: bool = False) -> DataFrame:
    """Metadata records to paper rows; records without an allowed category are dropped."""
    names = text.map_categories(F.col("categories"), mapping)
    return df.select(
        F.col("id").alias("bibcode"),
        text.clean_text(F.col("title")).alias("title"),
        text.clean_text(F.col("abstract")).alias("abstract"),
        F.col("journal-ref").alias("pub"),
        text.derive_year(F.col("journal-ref"), F.col("versions"), strict).alias("year"),
        names.alias("_names"),
        *[c for c in df.columns if c.startswith("_")],
    ).filter(F.size("_names") > 0).withColumn("categories", text.category_string(F.col("_names"))).drop("_names")


def input_order() -> list[Column]:
    """Line order of a text-based scan: file, split, row within the split."""
    return [
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_row"),
    ]


def new_papers(dump: DataFrame, stored: DataFrame, mapping: Mapping[str, str] = fixed.CATEGORY_NAMES,
               strict: bool = False) -> DataFrame:
    """Rows of a dump that the table lacks; the first line of a repeated key wins."""
    lines = dump.select("*", *input_order())
    rows = metadata_to_papers(lines, mapping, strict)
    fresh = store.absent_rows(rows, stored, "bibcode", ["_file", "_split", "_row"])
    return _as_papers(fresh.withColumn("id", F.col("_row")))


def ingest_jsonl(spark: SparkSession, path: str, store_path: str,
                 mapping: Mapping[str, str] = fixed.CATEGORY_NAMES, strict: bool = False) -> None:
    """Append the new papers of a dump to the table at ``store_path``, which must exist.

    Ids follow the line order with gaps; building an index numbers the papers densely.
    """
    stored = spark.read.schema(schema.PAPERS).parquet(store_path)
    store.append_papers(new_papers(readers.read_papers_jsonl(spark, path), stored, mapping, strict), store_path)


def ingest_search(results: DataFrame, edges: DataFrame, responses: DataFrame, stored: DataFrame, query: str,
                  loose: bool = False) -> DataFrame:
    """New rows from a search and from the references of the newly found papers.

    ``results`` and ``responses`` are search responses: the hits, and the papers that the citation table
    ``edges(citing, cited)`` may point to.
    """
    hits = relations.drop_null_abstract(relations.format_search_result(results, query))
    hits = hits.filter(predicates.query_in_text(F.col("abstract"), query, loose))
    seeds = _as_papers(store.absent_rows(hits, stored, "bibcode", ["bibcode"]))
    known = stored.select("bibcode").unionByName(seeds.select("bibcode"))
    cited = relations.expand_references(
        seeds, edges, relations.format_search_result(responses, query), known, query
    )
    return relations.union_ingest(seeds, _as_papers(cited), "bibcode", ["bibcode"])
