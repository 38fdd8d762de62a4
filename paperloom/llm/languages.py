"""Language of a text: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies cover every row that may be learnt from. The weights are trained on a sample whose
expected size per language is a parameter, by the proximal follow-the-regularised-leader rule with
elastic-net penalties, in shards whose weights are averaged; a temperature fitted on rows that no shard saw
calibrates the scores.

Nulls and odd rows: a null text or one without a letter is ``und`` with score 0; rows with a null language
are predicted but not learnt from; without anything to learn from, everything is ``und``; repeated rows get
the same answer; equal scores go to the first language in order; other columns are not read.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from paperloom.llm.words import frugal
from paperloom.staging import share, stage

#: Hash buckets of n-grams, longest n-gram.
BUCKETS, LONGEST = 1 << 14, 3
#: Expected number of training texts for each language, shards, passes, largest number of languages.
SAMPLE, SHARDS, PASSES, MOST_LANGUAGES = 600, 4, 3, 1000
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-3
CHUNK = 1 << 20

_letter: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _letter
    if _letter is None:
        _letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letter


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Buckets of the text's character n-grams and their counts; None without a letter."""
    if not text:
        return None
    total = np.zeros(BUCKETS, np.int64)
    tail, found = np.zeros(1, np.uint32), False
    for at in range(0, len(text), CHUNK):
        codes = np.frombuffer(text[at : at + CHUNK].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = _letters()[codes]
        found = found or bool(is_letter.any())
        codes = np.concatenate([tail, np.where(is_letter, codes, np.uint32(0))])
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
        codes = codes[keep]
        last = at + CHUNK >= len(text)
        if last and codes[-1]:
            codes = np.append(codes, np.uint32(0))
        grams, skip = np.zeros(len(codes), np.uint32), 0 if at == 0 else len(tail)
        for n in range(1, LONGEST + 1):
            # an n-gram is counted in the chunk that holds its last character
            size = len(codes) - n + 1
            if size <= 0:
                break
            grams = grams[:size] * np.uint32(0x01000193) + (codes[n - 1 :] + np.uint32(n)) * np.uint32(0x9E3779B1)
            own = grams[max(0, skip - n + 1) :]
            mixed = (own ^ (own >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            total += np.bincount((mixed >> np.uint32(18)).astype(np.int64), minlength=BUCKETS)
        tail = codes[-(LONGEST - 1) :]
    if not found:
        return None
    at = np.flatnonzero(total)
    return at, total[at]


def _features(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    counted = gram_counts(text)
    if counted is None:
        return None
    at, counts = counted
    values = (1 + np.log(counts)) * idf[at]
    return at, values / (np.sqrt((values**2).sum()) or 1.0)


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train_ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int, passes: int = PASSES) -> np.ndarray:
    """Weights (buckets x classes) after ``passes`` over ``(class, buckets, values)`` rows."""
    z, n = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes))

    def weights(z, n):
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(passes):
        for label, at, values in rows:
            w = weights(z[at], n[at])
            error = _softmax(values @ w)
            error[label] -= 1.0
            g = values[:, None] * error[None, :]
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * w
            n[at] = grown
    return weights(z, n)


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden section over its logarithm.

    As n rows can't tell certainty from a chance of error of 1 / (n + 2), the labels are softened by that.
    """
    n, classes = logits.shape
    if not n or classes < 2:
        return 1.0
    target = np.full((n, classes), 1 / (n + 2) / (classes - 1))
    target[np.arange(n), labels] = (n + 1) / (n + 2)
    loss = lambda t: -(target * np.log(np.maximum(_softmax(logits / np.exp(t)), 1e-300))).sum(axis=1).mean()
    low, high, ratio = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, learn: Column, sample: int = SAMPLE) -> LanguageModel | None:
    """Learn from the rows of ``docs(doc_id, text, lang)`` where ``learn`` holds and lang isn't null."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), learn.alias("learn")).where("learn and lang is not null and text is not null")

    def frequencies(batches):
        found, number = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for text in batch.column("text"):
                counted = gram_counts(text.as_py())
                if counted is not None:
                    found[counted[0]] += 1
                    number += 1
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(found[at], number), pa.int64())], names=["bucket", "n"])

    counted = rows.select("text").mapInArrow(frugal(frequencies), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # a row for each bucket at most
    df = np.zeros(BUCKETS)
    number = 0
    for r in counted:
        if r["bucket"] < 0:
            number = r["n"]
        else:
            df[r["bucket"]] = r["n"]
    idf = np.log((1 + number) / (1 + df)) + 1

    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if not sizes:
        return None
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = sorted(sizes)
    index = {x: i for i, x in enumerate(languages)}
    portion = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, sample / sizes[k]))])
    fate = F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1_000_000)) / 1_000_000
    chosen = rows.where(fate < portion[F.col("lang")]).withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(SHARDS + 1)).cast("int"))

    def featured(batches):
        for batch in batches:
            shards, labels, ats, values = [], [], [], []
            for shard, lang, text in zip(batch.column("shard").to_pylist(), batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                own = _features(text.as_py(), idf)
                if own is not None:
                    shards.append(shard)
                    labels.append(index[lang])
                    ats.append(own[0].astype(np.int32).tobytes())
                    values.append(own[1].astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(labels, pa.int32()), pa.array(ats, pa.binary()), pa.array(values, pa.binary())], names=["shard", "label", "at", "value"])

    samples = stage(chosen.select("shard", "lang", "text").mapInArrow(frugal(featured), "shard int, label int, at binary, value binary"), "language-sample")

    def unpacked(table: pa.Table):
        return [(k, np.frombuffer(a, np.int32), np.frombuffer(v, np.float32).astype(float)) for k, a, v in zip(*(table.column(c).to_pylist() for c in ("label", "at", "value")), strict=True)]

    def shard_weights(key, table):
        own = unpacked(table)
        order = np.random.default_rng(7).permutation(len(own))
        w = train_ftrl([own[i] for i in order], len(languages))
        return pa.table({"w": pa.array([w.astype(np.float32).tobytes()], pa.binary())})

    trained = [np.frombuffer(bytes(r["w"]), np.float32) for r in samples.where(F.col("shard") < SHARDS).groupBy("shard").applyInArrow(shard_weights, "w binary").collect()]  # SHARDS rows
    if not trained:  # so few rows that all fell into the calibration share
        trained = [np.frombuffer(bytes(r["w"]), np.float32) for r in samples.groupBy(F.lit(0)).applyInArrow(shard_weights, "w binary").collect()]
    if not trained:
        return None
    weights = np.mean(trained, axis=0).reshape(BUCKETS, len(languages))
    shared = share(docs.sparkSession, weights)

    def logits(batches):
        for batch in batches:
            own = unpacked(pa.Table.from_batches([batch]))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in own], pa.int32()), pa.array([(v @ shared.value[a]).tolist() for _, a, v in own], pa.list_(pa.float64()))], names=["label", "logits"])

    unseen = samples.where(F.col("shard") == SHARDS).mapInArrow(logits, "label int, logits array<double>").collect()  # bounded by the sample
    scores = np.array([r["logits"] for r in unseen]).reshape(len(unseen), len(languages))
    return LanguageModel(languages, idf, weights, fit_temperature(scores, np.array([r["label"] for r in unseen], int)))


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; only the text is looked at."""
    plain = [c for c in docs.columns if c not in ("lang_pred", "score")]
    if model is None:
        return docs.select(*plain, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = share(docs.sparkSession, (model.languages, model.idf, model.weights, model.temperature))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in plain]).alias("row"), F.col("text").cast("string").alias("text"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, idf, weights, temperature = shared.value
        for batch in batches:
            found, scores = [], []
            for text in batch.column("text"):
                own = _features(text.as_py(), idf)
                if own is None:
                    found.append("und")
                    scores.append(0.0)
                else:
                    p = _softmax(own[1] @ weights[own[0]] / temperature)
                    best = int(p.argmax())
                    found.append(languages[best])
                    scores.append(float(p[best]))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=["row", "lang_pred", "score"])

    judged = row.mapInArrow(frugal(judge), T.StructType([row.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    return judged.select(*[F.col(f"row.`{c}`").alias(c) for c in plain], "lang_pred", "score")
