"""Scans: metadata dumps, flat text, markdown folders, SQL tables."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from paperloom import schema


def read_papers_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per line; a malformed line fails the job."""
    return spark.read.schema(schema.METADATA_JSON).option("mode", "FAILFAST").json(path)


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Flat corpus, one sample per line, in column ``value``."""
    return spark.read.text(path)


def read_markdown_dir(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """Every markdown file of a folder as one row ``(file, text)``, ordered by name."""
    # The text source takes three times as long to open a file.
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(F.col("_metadata.file_name").alias("file"), F.col("content").cast("string").alias("text")).orderBy("file")


def read_papers_jdbc(
    spark: SparkSession, url: str, table: str, columns: Sequence[str],
    properties: dict[str, str] | None = None, partition_column: str | None = None,
    partitions: int = 1,
) -> DataFrame:
    """Table scan with a column list; a numeric partition column splits it into parallel range scans."""
    properties = properties or {}
    if partition_column is None:
        return spark.read.jdbc(url, table, properties=properties).select(*columns)
    bounds = (
        spark.read.jdbc(url, table, properties=properties)
        .agg(F.min(partition_column).alias("lo"), F.max(partition_column).alias("hi")).first()
    )
    if bounds.lo is None:
        return spark.read.jdbc(url, table, properties=properties).select(*columns)
    scan = spark.read.jdbc(
        url, table, column=partition_column, lowerBound=bounds.lo, upperBound=bounds.hi + 1,
        numPartitions=partitions, properties=properties,
    )
    return scan.select(*columns)


def jdbc_url(dialect: str, dbname: str, endpoint: str = "", port: str = "") -> str:
    """Address of a SQLite file or of a PostgreSQL database."""
    if dialect == "sqlite":
        return f"jdbc:sqlite:{dbname}"
    if dialect == "postgresql":
        return f"jdbc:postgresql://{endpoint}:{port}/{dbname}"
    raise ValueError(f"unknown dialect {dialect}")


def scan_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns)
