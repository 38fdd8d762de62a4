"""Neighbours, scores and projections against short numpy formulas."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from paperloom.operators import clusters, features, neighbors, projections

RNG = np.random.default_rng(7)
X = RNG.standard_normal((400, 12))
X[300:] = X[:100]  # copies
X[5] = 0.0
LABELS = np.where(np.arange(400) < 250, "hot", np.where(np.arange(400) < 399, "mid", "one"))


@pytest.fixture(scope="module")
def points(spark):
    rows = [(i, [float(v) for v in x], str(LABELS[i])) for i, x in enumerate(X)]
    return spark.createDataFrame(rows, "id long, vec array<double>, label string").repartition(5).cache()


def brute(queries, k, skip_self=False):
    live = np.flatnonzero(np.linalg.norm(X, axis=1) > 0)
    unit = X[live] / np.linalg.norm(X[live], axis=1)[:, None]
    out = {}
    for q in queries:
        if q not in live:
            continue
        dist = np.sqrt(np.maximum(2 * (1 - unit @ unit[list(live).index(q)]), 0))
        order = [(round(float(d), 6), int(i)) for d, i in zip(dist, live) if not (skip_self and i == q)]
        out[q] = [i for _, i in sorted(order)[:k]]
    return out


def hits(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.id)
    return out


def test_knn_small_and_large_query_sets(points, monkeypatch):
    want = brute(range(400), 7)
    assert hits(neighbors.knn_exact(points, points, 7)) == want
    monkeypatch.setattr(neighbors, "MAX_QUERY_VALUES", 24)
    monkeypatch.setattr(neighbors, "ROWS_PER_SALT", 50)
    assert hits(neighbors.knn_exact(points, points, 7)) == want
    assert hits(neighbors.knn_graph(points, 3)) == brute(range(400), 3, skip_self=True)


def test_tiles_are_bounded_and_complete(points):
    tiles = neighbors.pack_tiles(points.withColumn("cell", (F.col("label") == "hot").cast("int")), 16).collect()
    assert max(len(t.ids) for t in tiles) <= 16
    assert sorted(i for t in tiles for i in t.ids) == list(range(400))
    assert all(np.allclose(np.reshape(t.vecs, (-1, 12)), X[list(t.ids)]) for t in tiles)


def test_cell_index(points, spark, tmp_path, monkeypatch):
    monkeypatch.setattr(neighbors, "ROWS_PER_SALT", 20)
    index = neighbors.CellIndex.build(points, 9, restarts=2)
    assert hits(index.search(points, 5, nprobe=9)) == brute(range(400), 5)
    index.save(str(tmp_path))
    loaded = neighbors.CellIndex.load(spark, str(tmp_path))
    few = points.filter("id < 3")
    assert hits(loaded.search(few, 5, nprobe=9)) == brute(range(3), 5)
    # One probed cell cannot hold k rows: more cells are probed.
    assert all(len(v) == 350 for v in hits(loaded.search(few, 350, nprobe=1)).values())


def test_recall_at_candidate_share(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    asked = table.filter("id < 40").select("id", F.transform("vec", lambda x: x + F.randn(3) * 0.02).alias("vec"))
    index = neighbors.CellIndex.build(table, 45)
    exact, found = hits(neighbors.knn_exact(asked, table, 10)), hits(index.search(asked, 10, nprobe=16))
    recall = np.mean([len(set(found[q]) & set(v)) / len(v) for q, v in exact.items()])
    assert index.candidate_share(asked, 10, 16) <= 0.6 and recall >= 0.8


def test_knn_sparse_matches_join(spark, monkeypatch):
    from paperloom.plans.search import similar_documents

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    near = hits(similar_documents(items, docs, "item_id", "doc_id"))
    monkeypatch.setattr(neighbors, "MAX_QUERIES", 1)
    assert hits(similar_documents(items, docs, "item_id", "doc_id")) == near


def cosines():
    live = np.linalg.norm(X, axis=1) > 0
    unit = X[live] / np.linalg.norm(X[live], axis=1)[:, None]
    return unit @ unit.T, LABELS[live]


def test_category_similarities(points):
    cos, labels = cosines()
    got = {(r.cat_i, r.cat_j): r.mean_cos for r in clusters.category_cosine_matrix(points, "vec", "label").collect()}
    for i in set(labels):
        for j in set(labels):
            assert abs(got[i, j] - cos[labels == i][:, labels == j].mean()) < 1e-9
    for r in clusters.in_out_similarity(points, "vec", "label").collect():
        assert abs(r.in_sim - cos[labels == r.cat][:, labels == r.cat].mean()) < 1e-9
        assert abs(r.out_sim - cos[labels == r.cat][:, labels != r.cat].mean()) < 1e-9
    single = clusters.in_out_similarity(points.withColumn("label", F.lit("x")), "vec", "label").first()
    assert single.out_sim is None


def test_category_mean_equals_pair_mean(spark):
    @settings(max_examples=5, deadline=None)
    @given(st.lists(st.tuples(st.sampled_from("ab"), st.lists(st.floats(-1, 1), min_size=3, max_size=3)), min_size=2, max_size=12))
    def check(values):
        values = [(c, v) for c, v in values if np.linalg.norm(v) > 1e-3]
        if not values:
            return
        df = spark.createDataFrame(values, "c string, v array<double>").coalesce(1)
        unit = np.array([np.array(v) / np.linalg.norm(v) for _, v in values])
        cat = np.array([c for c, _ in values])
        for r in clusters.category_cosine_matrix(df, "v", "c").collect():
            assert abs(r.mean_cos - (unit @ unit.T)[cat == r.cat_i][:, cat == r.cat_j].mean()) < 1e-9

    check()


def test_pairwise_summary(points, monkeypatch):
    monkeypatch.setattr(neighbors, "ROWS_PER_SALT", 60)
    cos, _ = cosines()
    rows = neighbors.pairwise_cosine(points, "id", "vec").orderBy("id").collect()
    assert np.allclose([r.mean_cos for r in rows], cos.mean(axis=1))
    assert np.allclose([r.min_cos for r in rows], cos.min(axis=1))


def test_scores(points, monkeypatch):
    monkeypatch.setattr(neighbors, "ROWS_PER_SALT", 60)
    dist = np.linalg.norm(X[:, None] - X[None], axis=2)
    names = sorted(set(LABELS))
    s = []
    for i in range(len(X)):
        own = LABELS == LABELS[i]
        if own.sum() == 1:
            s.append(0.0)
            continue
        a = dist[i][own].sum() / (own.sum() - 1)
        b = min(dist[i][LABELS == n].mean() for n in names if n != LABELS[i])
        s.append((b - a) / max(a, b))
    assert abs(neighbors.silhouette(points, "id", "vec", "label").first()[0] - np.mean(s)) < 1e-9
    centers = {n: X[LABELS == n].mean(axis=0) for n in names}
    spread = {n: np.linalg.norm(X[LABELS == n] - centers[n], axis=1).mean() for n in names}
    worst = [max((spread[i] + spread[j]) / np.linalg.norm(centers[i] - centers[j]) for j in names if j != i) for i in names]
    assert abs(clusters.davies_bouldin(points, "vec", "label").first()[0] - np.mean(worst)) < 1e-9
    between = sum((LABELS == n).sum() * ((centers[n] - X.mean(axis=0)) ** 2).sum() for n in names)
    within = sum(((X[LABELS == n] - centers[n]) ** 2).sum() for n in names)
    want = (between / 2) / (within / (len(X) - 3))
    assert abs(clusters.calinski_harabasz(points, "vec", "label").first()[0] - want) < 1e-9


def test_pca(points, spark, tmp_path):
    centred = X - X.mean(axis=0)
    values = np.linalg.eigvalsh(np.cov(X.T))[::-1]
    ratio = values / values.sum()
    model = projections.fit_pca(points, "vec", 0.6)
    want = int(np.searchsorted(np.cumsum(ratio), 0.6, side="right")) + 1
    assert model.components.shape == (12, want) and np.allclose(model.ratio, ratio[:want])
    model.save(spark, str(tmp_path))
    loaded = projections.PcaModel.load(spark, str(tmp_path))
    rows = projections.project(points, loaded, "id", "vec").orderBy("id").collect()
    assert np.allclose([r.vec for r in rows], centred @ model.components)
    assert (np.abs(model.components).max(axis=0) == model.components.max(axis=0)).all()


def test_wide_pca_equals_exact(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    from paperloom.functions import text
    from paperloom.operators import aggregates

    tokens = docs.select("doc_id", text.tfidf_tokens(F.col("text")).alias("tokens"))
    tfidf = features.TfidfModel.from_table(aggregates.idf_table(tokens, 300))
    vectors = tfidf.transform(tokens).select("doc_id", "features").cache()
    values, axes = np.linalg.eigh(projections.covariance(vectors, "features"))
    values, axes = values[::-1], axes[:, ::-1]
    share = values / values.sum()
    keep = int(np.searchsorted(np.cumsum(share), 0.6, side="right")) + 1
    monkeypatch.setattr(projections, "BLOCK", 16)  # the space must grow
    monkeypatch.setattr(projections, "RESIDUAL", 1e-6)
    wide = projections.fit_pca(vectors, "features", 0.6)
    assert wide.components.shape == (300, keep)
    assert np.allclose(wide.ratio, share[:keep], rtol=1e-6)
    assert np.allclose(np.abs((wide.components * axes[:, :keep]).sum(axis=0)[:5]), 1, atol=1e-6)
    monkeypatch.setattr(projections, "MAX_DIRECTIONS", 40)
    with pytest.raises(ValueError):
        projections.fit_pca(vectors, "features", 0.6)


def test_projection_is_blocked(spark, monkeypatch):
    """A batch of 10,000 rows is multiplied in parts whose products stay within ``TASK_VALUES``."""
    rng = np.random.default_rng(3)
    w = rng.standard_normal((50, 20))
    model = projections.PcaModel(np.zeros(50), w, np.ones(20) / 20)
    rows = [(i, [float(x) for x in rng.standard_normal(50)]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    monkeypatch.setattr(projections, "TASK_VALUES", 2_000)  # two rows at a time
    got = {r.id: r.vec for r in projections.project(df, model, "id", "v").collect()}
    assert len(got) == 300 and all(np.allclose(got[i], np.array(v) @ w) for i, v in rows)


def test_lda(points):
    many = points.withColumn("label", (F.col("id") % 4).cast("string"))
    labels = np.arange(400) % 4
    got = np.array([[r.x, r.y] for r in projections.lda_2d(many, "id", "vec", "label").orderBy("id").collect()])
    within = sum((got[labels == c] - got[labels == c].mean(axis=0)).T @ (got[labels == c] - got[labels == c].mean(axis=0))
                 for c in range(4)) / (400 - 4)
    assert np.allclose(within, np.eye(2), atol=1e-8)
    with pytest.raises(ValueError):
        projections.lda_2d(points.withColumn("label", (F.col("id") % 2).cast("string")), "id", "vec", "label")


def test_pooling(spark):
    rows = [("a", 0, [1.0, 2.0], 1), ("a", 1, [3.0, 6.0], 1), ("a", 2, [9.0, 9.0], 0), ("b", 0, [5.0, 5.0], 0)]
    df = spark.createDataFrame(rows, "t string, pos int, v array<double>, m int")
    pooled = {r.t: list(r.embedding) for r in features.mean_pool(df, "t", "v", "m").collect()}
    assert pooled == {"a": [2.0, 4.0], "b": [0.0, 0.0]}
    assert {r.t: list(r.embedding) for r in features.cls_pool(df, "t", "pos", "v").collect()} == {"a": [1.0, 2.0], "b": [5.0, 5.0]}


def test_encoders(spark):
    df = spark.createDataFrame([(1, "mars rover mars"), (2, "rover mars mars"), (3, None), (4, "x")], "i int, t string")
    native = {r.i: r.embedding for r in features.encode_text(df, "t", dim=32).collect()}
    assert native[1] == native[2] and native[3] is None and abs(np.linalg.norm(native[1]) - 1) < 1e-9 and len(native[1]) == 32

    def make():
        return lambda texts: np.array([[len(t), t.count("a")] for t in texts])

    plugged = {r.i: list(r.embedding) for r in features.encode_text(df, "t", make, batch=2).collect()}
    assert plugged == {1: [15.0, 2.0], 2: [15.0, 2.0], 3: [0.0, 0.0], 4: [1.0, 0.0]}


def test_linear_silhouette(points):
    live = X[np.linalg.norm(X, axis=1) > 0]
    labels = LABELS[np.linalg.norm(X, axis=1) > 0]
    for metric, vectors, own in (("squaredEuclidean", X, LABELS), ("cosine", live / np.linalg.norm(live, axis=1)[:, None], labels)):
        d = ((vectors[:, None, :] - vectors[None, :, :]) ** 2).sum(axis=2) / (2 if metric == "cosine" else 1)
        scores = []
        for i in range(len(vectors)):
            mine = own == own[i]
            if mine.sum() == 1:
                scores.append(0.0)
                continue
            a = d[i][mine].sum() / (mine.sum() - 1)
            b = min(d[i][own == o].mean() for o in set(own) if o != own[i])
            scores.append((b - a) / max(a, b))
        got = neighbors.silhouette(points, "id", "vec", "label", metric).first().silhouette
        assert abs(got - np.mean(scores)) < 1e-6


def test_space_of_components_stays_small(monkeypatch):
    """The space starts again at twice the needed pairs, and isn't examined before it can hold them."""
    d, k, sizes, solve = 1500, 100, [], np.linalg.eigh
    values = 1 / np.sqrt(1 + np.arange(d))
    monkeypatch.setattr(np.linalg, "eigh", lambda a: sizes.append(len(a)) or solve(a))
    found, axes = projections.leading_pairs(lambda block: values[:, None] * block, d, values.sum(), lambda v: k if len(v) >= k else None, 1400, 32)
    assert k <= min(sizes) and max(sizes) <= 2 * k + 2 * 32
    assert np.allclose(found[:k], values[:k], rtol=1e-5) and axes.shape == (d, k)


def test_saved_components_come_back_in_parts(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(0)
    monkeypatch.setattr(projections, "SAVED", 3)
    for k in (0, 1, 8):
        model = projections.PcaModel(rng.standard_normal(20), rng.standard_normal((20, k)), rng.random(k))
        model.save(spark, f"{tmp_path}/{k}")
        back = projections.PcaModel.load(spark, f"{tmp_path}/{k}")
        assert np.array_equal(back.mean, model.mean) and np.array_equal(back.components, model.components) and np.array_equal(back.ratio, model.ratio)


def test_products_by_dense_parts(monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(features, "BLOCK_ROWS", 4)
    sizes = np.array([3, 0, 5, 1, 0, 0, 0, 0, 2, 4])
    indices = np.concatenate([rng.choice(30, n, replace=False) for n in sizes])
    values, m = rng.standard_normal(len(indices)), rng.standard_normal((30, 6))
    dense = np.zeros((10, 30))
    dense[np.repeat(np.arange(10), sizes), indices] = values
    assert np.allclose(features.times_matrix(indices, values, sizes, m), dense @ m)
    assert all(part.shape[0] <= 4 for _, _, part in features.dense_blocks(indices, values, sizes, 30))


def test_a_task_hands_on_k_rows_a_query(spark):
    """However many tiles it meets, and in however many batches; ties go to the smaller id."""
    rng = np.random.default_rng(2)
    corpus = rng.standard_normal((40, 4))
    corpus[20:] = corpus[:20]
    corpus /= np.linalg.norm(corpus, axis=1, keepdims=True)
    left = [float(x) for x in corpus[:7].ravel()]
    tiles = [(list(range(7)), left, list(range(a, a + 5)), [float(x) for x in corpus[a:a + 5].ravel()]) for a in (35, 10, 0, 5, 20, 15, 25, 30)]
    pairs = spark.createDataFrame(tiles, "l_ids array<long>, l_vecs array<double>, r_ids array<long>, r_vecs array<double>").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
    try:
        got = neighbors._tile_topk(pairs, 3, True).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    dist = np.sqrt(np.maximum(2 - 2 * corpus[:7] @ corpus.T, 0))
    dist[np.arange(7), np.arange(7)] = np.inf
    wanted = [(q, int(i)) for q in range(7) for i in np.lexsort((np.arange(40), np.round(dist[q], 6)))[:3]]
    assert sorted((r.query_id, r.id) for r in got) == sorted(wanted)


def test_a_tile_reaches_a_probed_cell_once(spark, monkeypatch):
    """Neighbours within all cells are the exact ones, ties by id included, and no tile is repeated for each tile of the other side."""
    rng = np.random.default_rng(5)
    rows = np.round(rng.normal(size=(90, 4)), 1).tolist()
    rows += rows[:20]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "id long, vec array<double>")
    index = neighbors.CellIndex.build(df, 3)
    exact = {(r.query_id, r.rank): (r.id, round(r.dist, 6)) for r in neighbors.knn_graph(df, 5).collect()}
    for size in (1024, 4):
        monkeypatch.setattr(neighbors, "TILE", size)
        monkeypatch.setattr(neighbors, "LEAST_PER_SALT", 8 * size)
        got = {(r.query_id, r.rank): (r.id, round(r.dist, 6)) for r in neighbors.knn_graph(df, 5, index=index, nprobe=3).collect()}
        assert got == exact
    one = df.repartition(2).selectExpr("0 as cell", "id", "vec")
    sizes = spark.createDataFrame([(0, 110)], "cell int, n long")
    monkeypatch.setattr(neighbors, "LEAST_PER_SALT", 1024)
    dealt = neighbors._dealt_tiles(one, one, sizes, sizes).collect()
    assert sum(len(r.ids) for r in dealt if r.asks) == sum(len(r.ids) for r in dealt if not r.asks) == 110
