"""Documents to vectors: TF-IDF, hashing and pluggable encoders, pooling."""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel, ElementwiseProduct, HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from paperloom.functions import text
from paperloom.functions.vectors import l2_normalize

MAX_VOCABULARY = 1 << 20
#: Rows and values of a dense part of sparse rows (32 MB).
BLOCK_ROWS, BLOCK_VALUES = 256, 4_194_304


def sparse_columns(df: DataFrame, column: str, *extra: Column) -> DataFrame:
    """``(indices, values)`` of an ml vector column; a dense vector lists every index."""
    v = F.unwrap_udt(column)
    every = F.sequence(F.lit(0), F.size(v["values"]) - 1)
    return df.select(*extra, F.coalesce(v["indices"], every).alias("indices"), v["values"].alias("values"))


def dense_blocks(indices: np.ndarray, values: np.ndarray, sizes: np.ndarray, width: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Sparse rows of ``width`` features, given as concatenated entries, as ``(rows, features, dense part over these features)``.

    A product with a dense part is one of whole matrices, many times faster than entry by entry; a part holds ``BLOCK_VALUES`` at most.
    """
    ends, place = np.cumsum(sizes), np.zeros(width, "int64")
    step = max(1, min(BLOCK_ROWS, BLOCK_VALUES // max(width, 1)))
    for at in range(0, len(sizes), step):
        own = sizes[at:at + step]
        first, last = ends[at] - own[0], ends[at + len(own) - 1]
        if first == last:
            continue
        met = np.zeros(width, bool)
        met[indices[first:last]] = True
        features = np.flatnonzero(met)
        place[features] = np.arange(len(features))
        part = np.zeros((len(own), len(features)))
        part[np.repeat(np.arange(len(own)), own), place[indices[first:last]]] = values[first:last]
        yield slice(at, at + len(own)), features, part


def times_matrix(indices: np.ndarray, values: np.ndarray, sizes: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Product of sparse rows, given as concatenated entries, with a dense matrix."""
    out = np.zeros((len(sizes), m.shape[1]))
    for rows, features, part in dense_blocks(indices, values, sizes, len(m)):
        out[rows] = part @ m[features]
    return out


class TfidfModel:
    """A vocabulary and its inverse document frequencies."""

    def __init__(self, terms: list[str], idf: list[float], counter: CountVectorizerModel | None = None):
        self.terms, self.idf, self._counter = terms, idf, counter

    @classmethod
    def from_table(cls, idf: DataFrame) -> "TfidfModel":
        """Read a vocabulary table; its size is the feature count, which is bounded."""
        rows = idf.orderBy(F.desc("tf"), "term").select("term", "idf").limit(MAX_VOCABULARY + 1).collect()
        if len(rows) > MAX_VOCABULARY:
            raise ValueError(f"a vocabulary holds at most {MAX_VOCABULARY} terms")
        return cls([r.term for r in rows], [r.idf for r in rows])

    def counter(self, spark: SparkSession) -> CountVectorizerModel:
        """A term counter over exactly this vocabulary, fitted on the vocabulary itself.

        The features follow the order of the counter, so terms and frequencies are put in that order.
        """
        if self._counter is None:
            listed = spark.createDataFrame([(self.terms,)], "terms array<string>")
            fitted = CountVectorizer(inputCol="terms", outputCol="_tf", vocabSize=max(len(self.terms), 1)).fit(listed)
            weight = dict(zip(self.terms, self.idf))
            self.terms = list(fitted.vocabulary)
            self.idf = [weight[t] for t in self.terms]
            self._counter = fitted
        return self._counter

    def transform(self, docs: DataFrame, tokens: str = "tokens", output: str = "features") -> DataFrame:
        """Unit TF-IDF vector per row as a sparse vector column. Row-local: nothing is shuffled."""
        counter = self.counter(docs.sparkSession).copy({self._counter.inputCol: tokens})
        scaled = ElementwiseProduct(scalingVec=Vectors.dense(self.idf), inputCol="_tf", outputCol="_weighted")
        unit = Normalizer(p=2.0, inputCol="_weighted", outputCol=output)
        return unit.transform(scaled.transform(counter.transform(docs))).drop("_tf", "_weighted")

    def weights(self, docs: DataFrame, key: str, tokens: str = "tokens") -> DataFrame:
        """Long form ``(key, term, weight)``."""
        vector = F.unwrap_udt("features")
        entries = F.arrays_zip(vector["indices"].alias("i"), vector["values"].alias("w"))
        long = self.transform(docs, tokens).select(key, F.inline(entries).alias("i", "weight"))
        spark = docs.sparkSession
        names = spark.createDataFrame(list(enumerate(self.terms)), "i int, term string")
        return long.join(F.broadcast(names), "i").select(key, "term", "weight")


def tfidf(docs: DataFrame, idf: DataFrame, key: str, tokens: str = "tokens") -> DataFrame:
    """Raw counts times smooth idf, unit length per document, over the vocabulary table."""
    return TfidfModel.from_table(idf).weights(docs, key, tokens)


def sum_vectors(vec: Column) -> Column:
    """Element-wise sum of array vectors, with partial aggregation."""
    return vector_to_array(Summarizer.sum(array_to_vector(vec)))


def mean_vectors(vec: Column) -> Column:
    return vector_to_array(Summarizer.mean(array_to_vector(vec)))


def mean_pool(tokens: DataFrame, text_col: str, vec: str, mask: str) -> DataFrame:
    """Masked mean of the token vectors of each text."""
    masked = F.transform(vec, lambda x: x.cast("double") * F.col(mask))
    pooled = tokens.select(text_col, masked.alias("_v"), F.col(mask).cast("double").alias("_m"))
    pooled = pooled.groupBy(text_col).agg(sum_vectors(F.col("_v")).alias("_s"), F.sum("_m").alias("_n"))
    count = F.greatest("_n", F.lit(1e-9))
    return pooled.select(text_col, F.transform("_s", lambda x: x / count).alias("embedding"))


def cls_pool(tokens: DataFrame, text_col: str, pos: str, vec: str) -> DataFrame:
    """Vector of the first token of each text."""
    return tokens.groupBy(text_col).agg(F.min_by(vec, pos).alias("embedding"))


def hashing_encode(df: DataFrame, column: str, dim: int = 256, output: str = "embedding") -> DataFrame:
    """Weight-free encoder: signed token hashing to ``dim`` values, unit length.

    Tokens hash to ``2 * dim`` buckets; the upper half counts negatively. Texts without tokens give null.
    """
    tokens = df.withColumn("_tokens", text.tfidf_tokens(F.coalesce(column, F.lit(""))))
    hashed = HashingTF(numFeatures=2 * dim, inputCol="_tokens", outputCol="_tf").transform(tokens)
    buckets = hashed.withColumn("_b", vector_to_array("_tf"))
    signed = F.zip_with(
        F.slice("_b", 1, dim), F.slice("_b", dim + 1, dim), lambda plus, minus: plus - minus
    )
    return buckets.withColumn(output, l2_normalize(signed)).drop("_tokens", "_tf", "_b")


def encode_text(
    df: DataFrame, column: str, make_encoder: Callable[[], Callable[[list[str]], np.ndarray]] | None = None,
    batch: int = 128, output: str = "embedding", dim: int = 256,
) -> DataFrame:
    """Text to fixed-size vectors.

    ``make_encoder`` builds, once per Python worker task, a callable from a list of texts to a matrix;
    without it the native hashing encoder runs.
    """
    if make_encoder is None:
        return hashing_encode(df, column, dim, output)
    out = T.StructType(df.schema.fields + [T.StructField(output, T.ArrayType(T.DoubleType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = make_encoder()
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start:start + batch]
                vectors = np.asarray(encoder(part[column].fillna("").tolist()), dtype="float64")
                yield part.assign(**{output: list(vectors)})

    return df.mapInPandas(run, out)
