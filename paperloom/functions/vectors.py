"""Vector arithmetic on array columns, without UDFs."""

from pyspark.sql import Column, functions as F

from paperloom.functions.text import bind


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, eps: float = 1e-6) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(eps))


def l2_normalize(v: Column) -> Column:
    """Unit vector; null for a zero vector."""
    return bind(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)))


def angular_distance(cos: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(2.0) * (F.lit(1.0) - cos), F.lit(0.0)))


def vector_to_csv(v: Column) -> Column:
    """Comma-joined values in fixed notation with six decimals."""
    return F.array_join(F.transform(v, lambda x: x.cast("decimal(18,6)").cast("string")), ",")


def csv_to_vector(s: Column) -> Column:
    return F.transform(F.split(s, ","), lambda x: x.cast("float"))
