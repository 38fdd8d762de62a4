"""Registration of queries and small builders for their SQL counterparts."""

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from paperloom.shipping import ship
from paperloom.staging import shared_dir, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The parquet tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """A table for work that is heavy per row: a file of one split is dealt to all cores."""
        return spread(getattr(self, name))


def scratch_path(t: Tables, name: str) -> str:
    """A new folder for the files a query writes and reads back."""
    return f"{shared_dir(t.spark)}/paperloom/{name}-{uuid.uuid4().hex}"


def query(name: str, sql: str | None = None):
    """Register ``build(tables) -> DataFrame`` under ``name``."""
    def register(build: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return build(Tables(spark, folder))

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return build

    return register


def lit(s: str) -> str:
    """SQL expression for a string; control and format characters by number."""
    parts, plain = [], ""
    for c in s:
        if c.isprintable():
            plain += c.replace("'", "''")
        else:
            if plain:
                parts.append(f"'{plain}'")
                plain = ""
            parts.append(f"chr({ord(c)})")
    if plain or not parts:
        parts.append(f"'{plain}'")
    return "(" + " || ".join(parts) + ")" if len(parts) > 1 else parts[0]


def replaces(expr: str, rules: Sequence[tuple[str, str]]) -> str:
    for old, new in rules:
        expr = f"replace({expr}, {lit(old)}, {lit(new)})"
    return expr


def regexes(expr: str, rules: Sequence[tuple[str, str]]) -> str:
    for pattern, new in rules:
        expr = f"regexp_replace({expr}, {lit(pattern)}, {lit(new)}, 'g')"
    return expr


def between(expr: str, marker: str) -> str:
    return f"CASE WHEN contains({expr}, {lit(marker)}) THEN split_part({expr}, {lit(marker)}, 2) ELSE {expr} END"


def staged(source: str, steps: Sequence[str], keys: str) -> str:
    """A chain of expressions over one column ``c``; step i sees the result of step i-1."""
    sql = source
    for step in steps:
        sql = f"SELECT {keys}, {step} AS c FROM ({sql})"
    return sql
