import pytest

from tests.compare import session


@pytest.fixture(scope="session")
def spark():
    return session(8, 8)


@pytest.fixture
def column(spark):
    """Apply a Column function to a list of values."""
    from pyspark.sql import functions as F

    def apply(build, values, kind="string"):
        rows = [(i, v) for i, v in enumerate(values)]
        df = spark.createDataFrame(rows, f"i int, c {kind}")
        return [r.out for r in df.select("i", build(F.col("c")).alias("out")).orderBy("i").collect()]

    return apply
