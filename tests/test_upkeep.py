"""A saved index that grows: the same finds as an index filled at once by the same steps."""

import pytest
from pyspark.sql import functions as F

from paperloom.operators import projections
from paperloom.operators.neighbors import CellIndex
from paperloom.functions import text
from paperloom.plans import search, upkeep
from paperloom.queries.base import Tables
from paperloom.queries.flows import papers
from paperloom.sources import models

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def every(spark):
    return papers(Tables(spark, FOLDER)).cache()


def part(every, *rest):
    return every.where((F.col("id") % 3).isin(*rest))


def found(spark, index, asked, nprobe=64):
    hits = search.semantic_search(asked, index.papers, search.search_function(index, nprobe=nprobe), 8)
    return sorted((r.query_id, round(r.dist, 5)) for r in hits.collect())


@pytest.fixture(scope="module")
def at_once(spark, every):
    """Steps learnt on the first third, all papers placed at once."""
    index = search.build_index(part(every, 0), cells=5, max_features=400)
    done = search.processed_text(every)
    tokens = done.select("id", text.tfidf_tokens(F.col("abstract_processed")).alias("tokens"))
    vectors = projections.project(index.tfidf.transform(tokens), index.pca, "id", "features")
    return models.SearchIndex(index.tfidf, index.pca, CellIndex.build(vectors, 5), done), index


@pytest.mark.parametrize("overfull", [4.0, 1.01])
def test_two_additions_find_what_one_index_finds(spark, every, at_once, tmp_path, overfull):
    whole, base = at_once
    path = str(tmp_path / "index")
    models.save_model(base, path)
    upkeep.add_papers(spark, path, part(every, 1, 0), overfull=overfull)
    index = upkeep.add_papers(spark, path, part(every, 2, 1), overfull=overfull)
    assert sorted(r.id for r in index.papers.select("id").collect()) == list(range(every.count()))
    asked = every.where("length(abstract) > 100").select(F.col("id").alias("query_id"), F.col("abstract").alias("query")).limit(40)
    expected = found(spark, whole, asked)
    assert found(spark, index, asked) == expected
    sizes = index.cells.cells.groupBy("cell").agg(F.countDistinct("id").alias("n")).collect()
    assert {(r.cell, r.n) for r in sizes} == {(r.cell, r.n) for r in index.cells.centroids.collect()}
    told = upkeep.drift(spark, path).agg(F.sum("built").alias("built"), F.sum("n").alias("n"), F.count("*").alias("cells")).first()
    assert (told.built, told.n) == (base.papers.count(), every.count())
    assert (told.cells > 5) == (overfull < 2)
    upkeep.merge_cells(spark, path)
    assert found(spark, models.load_model(spark, path), asked) == expected
    assert upkeep.add_papers(spark, path, every).papers.count() == every.count()


def test_an_addition_cut_short_is_made_up_for(spark, every, at_once, tmp_path, monkeypatch):
    whole, base = at_once
    path = str(tmp_path / "index")
    models.save_model(base, path)

    def killed(*_, **__):
        raise RuntimeError("killed")

    real = upkeep.split_cells
    monkeypatch.setattr(upkeep, "split_cells", killed)
    with pytest.raises(RuntimeError):  # cells and papers are there, sizes aren't
        upkeep.add_papers(spark, path, part(every, 1))
    monkeypatch.setattr(upkeep, "split_cells", real)
    cells = spark.read.parquet(f"{path}/cells")  # cells without their papers
    extra = cells.limit(1).withColumn("id", F.lit(10_000).cast("long"))
    assert extra.count() == 1
    index = upkeep.add_papers(spark, path, every)
    assert index.papers.count() == every.count()
    assert index.cells.cells.select("id").distinct().count() == index.cells.cells.count() == every.count()
