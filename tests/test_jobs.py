"""Index, search, recommendation and evaluation from end to end."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.operators import features
from paperloom.plans import evaluate, ingest, search
from paperloom.queries.language import backoff_model
from paperloom.queries.base import Tables
from paperloom.queries.flows import papers
from paperloom.sources import models
from paperloom.staging import shared_dir
from paperloom.streaming.search import stream_search, stream_search_changed

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def index(spark):
    return search.build_index(papers(Tables(spark, FOLDER)), cells=8, max_features=512)


@pytest.fixture(scope="module")
def asked(spark):
    return spark.read.parquet(f"{FOLDER}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def ranked(df):
    return [(r.query_id, r.rank, r.bibcode) for r in df.orderBy("query_id", "rank").collect()]


def test_index_numbers_papers_densely(index):
    ids = [r.id for r in index.papers.orderBy("bibcode").collect()]
    assert ids == list(range(200))
    assert index.cells.centroids.agg(F.sum("n")).first()[0] == 200


def test_search_after_reload(spark, index, asked, tmp_path):
    models.save_model(index, str(tmp_path))
    loaded = models.load_model(spark, str(tmp_path))
    exact = ranked(search.semantic_search(asked, loaded.papers, search.search_function(loaded, exact=True), 7))
    every = ranked(search.semantic_search(asked, index.papers, search.search_function(index, nprobe=8), 7))
    assert exact == every and len(exact) == 40 * 7


def test_a_paper_finds_itself(spark, index):
    asked = index.papers.filter("length(abstract) > 200").select(F.col("id").alias("query_id"), F.col("abstract").alias("query"))
    best = search.search_function(index, nprobe=2)(asked, 1).collect()
    texts = {r.id: r.abstract for r in index.papers.collect()}
    assert all(texts[r.id] == texts[r.query_id] or r.dist < 1e-3 for r in best)


def test_stored_tokens_are_kept(spark):
    df = spark.createDataFrame([("a", "The Red Fox", "done"), ("b", "The Red Fox", ""), ("c", None, None)],
                               "bibcode string, abstract string, abstract_processed string")
    got = {r.bibcode: r.abstract_processed for r in search.processed_text(df, ["the"]).collect()}
    assert got == {"a": "done", "b": "red fox", "c": ""}


def test_recommend(spark, index):
    tables = Tables(spark, FOLDER)
    prompts = tables.benchmark.select(F.col("item_id").alias("prompt_id"), F.col("text").alias("prompt"))
    texts, similar = search.recommend(prompts, index.papers, search.search_function(index), backoff_model(tables), n=3, k=4)
    assert [tuple(r) for r in texts.groupBy("prompt_id").count().select("count").distinct().collect()] == [(3,)]
    assert similar.count() == 40 * 4


def test_stream_search_equals_batch(spark, index, asked, tmp_path):
    find = search.search_function(index, nprobe=8)
    asked.write.json(str(tmp_path / "in"))
    for _ in range(2):
        stream_search(spark, str(tmp_path / "in"), index.papers, find, str(tmp_path / "out"), str(tmp_path / "c"), 5).awaitTermination()
    assert ranked(spark.read.parquet(str(tmp_path / "out"))) == ranked(search.semantic_search(asked, index.papers, find, 5))


def test_embed_papers(spark):
    df = ingest._as_papers(spark.createDataFrame([("a", "mars rover"), ("b", None)], "bibcode string, abstract string"))
    got = {r.bibcode: r.abstract_embedding for r in evaluate.embed_papers(df).collect()}
    values = [float(v) for v in got["a"].split(",")]
    assert got["b"] is None and len(values) == 256 and abs(np.linalg.norm(values) - 1) < 1e-4


def test_evaluate_embeddings(spark):
    files = [(f"cat{c}-{i}.md", " ".join(f"w{c}{(i * 7 + j) % 23}" for j in range(130))) for c in range(3) for i in range(6)]
    docs = spark.createDataFrame(files + [("cat0-empty.md", "")], "file string, text string")
    out = evaluate.evaluate_embeddings(docs, 40, lambda df, c: features.encode_text(df, c, dim=64), neighbors_k=3)
    chunks = out["points"].count()
    assert chunks == 18 * 7
    scores = out["scores"].first()
    assert scores.silhouette > 0.2 and scores.davies_bouldin > 0 and scores.calinski_harabasz > 1
    inside = {r.cat: r for r in out["in_out"].collect()}
    assert all(r.in_sim > r.out_sim for r in inside.values()) and len(inside) == 3
    assert out["neighbors"].count() == chunks * 3 and out["pca"].count() == out["lda"].count() == chunks


def test_evaluate_folder(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    for i in range(12):
        kind = ("red", "blue", "green")[i % 3]
        (tmp_path / "docs" / f"{kind}-{i:02}.md").write_text(f"# {kind}\n" + f"{kind} things and {kind} words number {i} " * 20)
    out = evaluate.evaluate_folder(spark, str(tmp_path / "docs"), str(tmp_path / "scores"), chunking=lambda c: F.split(c, "number"),
                                   neighbors_k=2, metric="cosine", graph="cells", cells=3, nprobe=3)
    scores = spark.read.json(str(tmp_path / "scores")).first()
    assert set(scores.asDict()) == set(out["scores"].columns) and 0 < scores["silhouette"] <= 1
    assert out["neighbors"].select("query_id").distinct().count() == out["points"].count()


def test_answered_batches_leave_nothing_staged(spark, tmp_path):
    """A batch's queries and hits go when it is answered; the answers and the stream stay whole."""
    def same_id(queries, k):
        return queries.select("query_id", F.col("query_id").alias("id"), F.lit(0.0).alias("dist"), F.lit(1).alias("rank"))

    stored = spark.createDataFrame([(i, f"b{i}", "t", "a" * i) for i in range(5)], "id long, bibcode string, title string, abstract string")
    at = f"{shared_dir(spark)}/paperloom"
    before = set(os.listdir(at)) if os.path.isdir(at) else set()
    for lines in ([(1, "x"), (2, "y")], [(1, "x"), (2, "z"), (4, "w")]):
        spark.createDataFrame(lines, "query_id long, query string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream_search_changed(spark, str(tmp_path / "in"), stored, same_id, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert {name.split("-")[0] for name in set(os.listdir(at)) - before} == set()
    assert sorted((r.query_id, r.abstract) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, "a"), (2, "aa"), (2, "aa"), (4, "aaaa")]
