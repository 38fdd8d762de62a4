"""Embeddings: arithmetic, pooling, neighbours, separation scores, projections."""

from pyspark.sql import functions as F

from paperloom.functions import vectors
from paperloom.operators import clusters, descent, features, neighbors, projections, windows
from paperloom.queries.base import query
from paperloom.staging import stage

E = "(SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
UNIT = """
    u AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u
          FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings))"""


def _rounded(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.round(c, 4))
    return df


def _long(df, key, column):
    long = df.select(key, F.posexplode(column).alias("pos", "x"))
    return _rounded(long, "x")


@query("cosine", f"""
    SELECT a.vec_id, round(list_dot_product(a.v, b.v) / greatest(sqrt(list_dot_product(a.v, a.v))
      * sqrt(list_dot_product(b.v, b.v)), 1e-6), 4) AS cos FROM {E} a JOIN {E} b ON b.vec_id = a.vec_id + 1""")
def cosine(t):
    after = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    pairs = t.embeddings.join(after, "vec_id")
    return _rounded(pairs.select("vec_id", vectors.cosine(F.col("embedding"), F.col("b")).alias("cos")), "cos")


@query("l2_normalize", f"""
    WITH {UNIT} SELECT vec_id, CAST(generate_subscripts(u, 1) - 1 AS INTEGER) AS pos, round(unnest(u), 4) AS x FROM u""")
def l2_normalize(t):
    return _long(t.embeddings.select("vec_id", vectors.l2_normalize(F.col("embedding")).alias("u")), "vec_id", "u")


LONG = f"(SELECT vec_id, label, v, unnest(v) AS x, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS pos FROM {E})"


@query("mean_pool", f"""
    SELECT label, pos, round(sum(CASE WHEN v[1] > 0 THEN x ELSE 0 END)
      / greatest(sum(CASE WHEN v[1] > 0 THEN 1 ELSE 0 END), 1e-9), 4) AS x FROM {LONG} GROUP BY label, pos""")
def mean_pool(t):
    tokens = t.embeddings.withColumn("mask", (F.col("embedding")[0] > 0).cast("int"))
    return _long(features.mean_pool(tokens, "label", "embedding", "mask"), "label", "embedding")


@query("cls_pool", f"""
    SELECT label, pos, round(x, 4) AS x FROM {LONG} JOIN (SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY label)
    USING (label, vec_id)""")
def cls_pool(t):
    first = features.cls_pool(t.embeddings, "label", "vec_id", "embedding")
    return _long(first.select("label", F.transform("embedding", lambda x: x.cast("double")).alias("v")), "label", "v")


@query("first_last_similarity", f"""
    WITH m AS (SELECT label, min(vec_id) AS lo, max(vec_id) AS hi FROM embeddings GROUP BY label)
    SELECT m.label, round(list_cosine_similarity(a.v, b.v), 4) AS similarity
    FROM m JOIN {E} a ON a.vec_id = lo JOIN {E} b ON b.vec_id = hi""")
def first_last_similarity(t):
    return _rounded(windows.first_last_similarity(t.embeddings, "label", "vec_id", "embedding"), "similarity")


def _knn_sql(condition: str) -> str:
    return f"""
    WITH {UNIT},
    s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, sqrt(greatest(2 * (1 - list_dot_product(a.u, b.u)), 0)) AS dist
          FROM u a JOIN u b ON {condition}),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(dist, 6), id) AS rank FROM s)
    SELECT query_id, id, round(dist, 4) AS dist, rank FROM r WHERE rank <= 10"""


KEYS = {"query_key": "vec_id", "key": "vec_id", "query_vec": "embedding", "vec": "embedding"}


@query("knn_exact", _knn_sql("true"))
def knn_exact(t):
    return _rounded(neighbors.knn_exact(t.embeddings, t.embeddings, 10, **KEYS), "dist")


@query("knn_approx", _knn_sql("true"))
def knn_approx(t):
    # Every cell is probed, so the result must equal the exact one.
    return _rounded(neighbors.knn_approx(t.embeddings, t.embeddings, 10, cells=16, nprobe=16, **KEYS), "dist")


@query("knn_graph", _knn_sql("a.vec_id <> b.vec_id"))
def knn_graph(t):
    return _rounded(neighbors.knn_graph(t.embeddings, 10, key="vec_id", vec="embedding"), "dist")


@query("knn_descent", """
    SELECT count(*) AS n_points, 10 * count(*) AS n_links, true AS found
    FROM documents WHERE regexp_matches(lower(text), '[\\p{L}\\p{N}_]{2,}')""")
def knn_descent(t):
    # Encoded documents; nine tenths of the exact neighbours of every hundredth must be found.
    points = stage(features.encode_text(t.spread("documents").select("doc_id", "text"), "text").select("doc_id", "embedding"))
    found = stage(descent.descend(points, 10, key="doc_id", vec="embedding")[0])
    asked = points.where("doc_id % 100 = 0")
    exact = neighbors.knn_exact(asked, points, 10, query_key="doc_id", key="doc_id", query_vec="embedding", vec="embedding", skip_self=True)
    recall = descent.recall(found, exact)
    return found.agg(F.countDistinct("query_id").alias("n_points"), F.count("*").alias("n_links")).withColumn("found", F.lit(recall >= 0.9))


@query("pairwise_cosine", f"""
    WITH {UNIT}, c AS (SELECT a.vec_id, list_dot_product(a.u, b.u) AS cos FROM u a CROSS JOIN u b)
    SELECT vec_id, count(*) AS n_pairs, round(avg(cos), 4) AS mean_cos, round(min(cos), 4) AS min_cos,
      round(max(cos), 4) AS max_cos FROM c GROUP BY vec_id""")
def pairwise_cosine(t):
    return _rounded(neighbors.pairwise_cosine(t.embeddings, "vec_id", "embedding"), "mean_cos", "min_cos", "max_cos")


@query("category_cosine_matrix", f"""
    WITH {UNIT} SELECT a.label AS cat_i, b.label AS cat_j, round(avg(list_dot_product(a.u, b.u)), 4) AS mean_cos
    FROM u a CROSS JOIN u b GROUP BY ALL""")
def category_cosine_matrix(t):
    return _rounded(clusters.category_cosine_matrix(t.embeddings, "embedding", "label"), "mean_cos")


@query("in_out_similarity", f"""
    WITH {UNIT}, c AS (SELECT a.label AS cat, a.label = b.label AS same, list_dot_product(a.u, b.u) AS cos FROM u a CROSS JOIN u b)
    SELECT cat, round(avg(cos) FILTER (same), 4) AS in_sim, round(avg(cos) FILTER (NOT same), 4) AS out_sim FROM c GROUP BY cat""")
def in_out_similarity(t):
    return _rounded(clusters.in_out_similarity(t.embeddings, "embedding", "label"), "in_sim", "out_sim")


@query("silhouette", f"""
    WITH d AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(list_distance(a.v, b.v)) AS total, count(*) AS n
               FROM {E} a JOIN {E} b ON a.vec_id <> b.vec_id GROUP BY ALL),
    p AS (SELECT vec_id, max(total / n) FILTER (own = other) AS a, min(total / n) FILTER (own <> other) AS b FROM d GROUP BY vec_id)
    SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 4) AS silhouette FROM p""")
def silhouette(t):
    return _rounded(neighbors.silhouette(t.embeddings, "vec_id", "embedding", "label"), "silhouette")


CENTERS = f"""
    c AS (SELECT label, pos, avg(x) AS c FROM {LONG} GROUP BY label, pos),
    d AS (SELECT vec_id, label, sum((x - c) ** 2) AS d2 FROM {LONG} JOIN c USING (label, pos) GROUP BY vec_id, label)"""


@query("davies_bouldin", f"""
    WITH {CENTERS}, s AS (SELECT label, avg(sqrt(d2)) AS s FROM d GROUP BY label),
    m AS (SELECT a.label AS i, b.label AS j, sqrt(sum((a.c - b.c) ** 2)) AS m FROM c a JOIN c b USING (pos)
          WHERE a.label <> b.label GROUP BY ALL),
    r AS (SELECT i, max((si.s + sj.s) / m) AS r FROM m JOIN s si ON si.label = i JOIN s sj ON sj.label = j GROUP BY i)
    SELECT round(avg(r), 4) AS davies_bouldin FROM r""")
def davies_bouldin(t):
    return _rounded(clusters.davies_bouldin(t.embeddings, "embedding", "label"), "davies_bouldin")


@query("calinski_harabasz", f"""
    WITH {CENTERS}, g AS (SELECT pos, avg(x) AS g FROM {LONG} GROUP BY pos),
    n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label),
    b AS (SELECT sum(n * (c - g) ** 2) AS b, count(DISTINCT label) AS k FROM c JOIN g USING (pos) JOIN n USING (label)),
    w AS (SELECT sum(d2) AS w, count(*) AS n FROM d)
    SELECT round((b / (k - 1)) / (w / (n - k)), 4) AS calinski_harabasz FROM b, w""")
def calinski_harabasz(t):
    return _rounded(clusters.calinski_harabasz(t.embeddings, "embedding", "label"), "calinski_harabasz")


# Eigenvectors in SQL: 16 squarings of a matrix leave its leading direction; it is taken off and the rest squared again.
MATRIX = f"""
    e AS {E},
    x AS (SELECT vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e),
    mu AS (SELECT list(m ORDER BY pos) AS mu FROM (SELECT pos, avg(x) AS m FROM x GROUP BY pos)),
    y AS (SELECT vec_id, label, list_transform(v, lambda a, i: a - mu[i]) AS y FROM e, mu),
    z AS (SELECT vec_id, label, unnest(y) AS z, generate_subscripts(y, 1) AS pos FROM y),
    entry AS (SELECT a.pos AS i, b.pos AS j, sum(a.z * b.z) / ((SELECT count(*) FROM e) - 1) AS c FROM z a JOIN z b USING (vec_id) GROUP BY ALL),
    matrix AS (SELECT list(r ORDER BY i) AS c FROM (SELECT i, list(c ORDER BY j) AS r FROM entry GROUP BY i))"""


def _signed(axis: str) -> str:
    return f"CASE WHEN list_max({axis}) >= -list_min({axis}) THEN {axis} ELSE list_transform({axis}, lambda a: -a) END"


def _pca_sql(more: str) -> str:
    """``pair(component, ratio, axis)``; the next is taken while ``more`` holds of the ``sum`` and number ``k`` of those before."""
    return f"""{MATRIX},
    total AS (SELECT sum(c) AS total FROM entry WHERE i = j),
    step(k, s, c, p, value, axis, sum) AS (
      SELECT 0, 0, c, c, 0::DOUBLE, NULL::DOUBLE[], 0::DOUBLE FROM matrix
      UNION ALL
      SELECT CASE WHEN done THEN k + 1 ELSE k END, CASE WHEN done THEN 0 ELSE s + 1 END, CASE WHEN done THEN less ELSE c END,
        CASE WHEN done THEN less ELSE list_transform(p, lambda a: list_transform(p, lambda b: list_dot_product(a, b) / size)) END,
        CASE WHEN done THEN value ELSE 0 END, CASE WHEN done THEN axis END, CASE WHEN done THEN sum + value ELSE sum END
      FROM (SELECT *, CASE WHEN done THEN list_transform(c, lambda row, i: list_transform(row, lambda a, j: a - value * axis[i] * axis[j])) END AS less
            FROM (SELECT *, list_dot_product(axis, list_transform(c, lambda row: list_dot_product(row, axis))) AS value
                  FROM (SELECT k, s, c, p, sum, s = 16 AS done, list_sum(list_transform(p, lambda a: list_dot_product(a, a))) AS size,
                          CASE WHEN s = 16 THEN list_transform(big, lambda a: a / sqrt(list_dot_product(big, big))) END AS axis
                        FROM (SELECT *, p[list_position(list_transform(p, lambda a, i: a[i]), list_max(list_transform(p, lambda a, i: a[i])))] AS big FROM step)))),
        total WHERE {more}),
    pair AS (SELECT k - 1 AS component, value / total AS ratio, {_signed("axis")} AS axis FROM step, total WHERE axis IS NOT NULL)"""


_POINTS = """SELECT vec_id, round(max(x) FILTER (component = 0), 4) AS x, round(max(x) FILTER (component = 1), 4) AS y
    FROM (SELECT vec_id, component, list_dot_product(y, axis) AS x FROM y, pair) GROUP BY vec_id"""


@query("fit_pca", f"WITH RECURSIVE {_pca_sql('sum <= 0.6 * total')} SELECT component, round(ratio, 4) AS ratio FROM pair")
def fit_pca(t):
    model = projections.fit_pca(t.embeddings, "embedding", variance=0.6)
    rows = [(i, round(float(r), 4)) for i, r in enumerate(model.ratio)]
    return t.spark.createDataFrame(rows, "component int, ratio double")


@query("project", f"""WITH RECURSIVE {_pca_sql('sum <= 0.6 * total')}
    SELECT vec_id, component AS pos, round(list_dot_product(y, axis), 4) AS x FROM y, pair""")
def project(t):
    model = projections.fit_pca(t.embeddings, "embedding", variance=0.6)
    return _long(projections.project(t.embeddings, model, "vec_id", "embedding"), "vec_id", "vec")


@query("pca_2d", f"WITH RECURSIVE {_pca_sql('k < 2')} {_POINTS}")
def pca_2d(t):
    return _rounded(projections.pca_2d(t.embeddings, "vec_id", "embedding"), "x", "y")


# Scatter within labels is inverted by Newton's iteration; its product with the scatter between is squared as above.
@query("lda_2d", f"""
    WITH RECURSIVE {MATRIX},
    centre AS (SELECT label, pos, avg(z) AS m, count(*) AS n FROM z GROUP BY label, pos),
    between AS (SELECT a.pos AS i, b.pos AS j, sum(a.n * a.m * b.m) AS c FROM centre a JOIN centre b USING (label) GROUP BY ALL),
    wide AS (SELECT list(rb ORDER BY i) AS b, list(rw ORDER BY i) AS w FROM (
      SELECT i, list(t.c ORDER BY j) AS rb, list((e.c * ((SELECT count(*) FROM e) - 1) - t.c) / ((SELECT count(*) - count(DISTINCT label) FROM e)) ORDER BY j) AS rw
      FROM between t JOIN entry e USING (i, j) GROUP BY i)),
    newton(s, w, v) AS (
      SELECT 0, w, list_transform(w, lambda row, i: list_transform(row, lambda a, j: CASE WHEN i = j THEN 1 / list_sum(list_transform(w, lambda r, k: r[k])) ELSE 0 END)) FROM wide
      UNION ALL
      SELECT s + 1, w, list_transform(v, lambda a, i: list_transform(v, lambda b, j: 2 * a[j] - list_dot_product(vw[i], b)))
      FROM (SELECT *, list_transform(v, lambda a: list_transform(w, lambda b: list_dot_product(a, b))) AS vw FROM newton) WHERE s < 24),
    m AS (SELECT newton.w, b, list_transform(v, lambda p: list_transform(b, lambda q: list_dot_product(p, q))) AS m,
            list_transform(b, lambda p: list_transform(v, lambda q: list_dot_product(p, q))) AS t FROM newton, wide WHERE s = 24),
    step(k, s, w, b, m, t, p, q, axis) AS (
      SELECT 0, 0, w, b, m, t, m, t, NULL::DOUBLE[] FROM (SELECT m.w, m.b, m.m, m.t FROM m)
      UNION ALL
      SELECT CASE WHEN done THEN k + 1 ELSE k END, CASE WHEN done THEN 0 ELSE s + 1 END, w, b, CASE WHEN done THEN m1 ELSE m END, CASE WHEN done THEN t1 ELSE t END,
        CASE WHEN done THEN m1 ELSE list_transform(p, lambda a: list_transform(q, lambda c: list_dot_product(a, c) / size)) END,
        CASE WHEN done THEN t1 ELSE list_transform(q, lambda a: list_transform(p, lambda c: list_dot_product(a, c) / size)) END, CASE WHEN done THEN axis END
      FROM (SELECT *, CASE WHEN done THEN list_transform(m, lambda r, i: list_transform(r, lambda a, j: a - power * axis[i] * wa[j])) END AS m1,
                      CASE WHEN done THEN list_transform(t, lambda r, i: list_transform(r, lambda a, j: a - power * wa[i] * axis[j])) END AS t1
            FROM (SELECT *, list_transform(w, lambda r: list_dot_product(r, axis)) AS wa, list_dot_product(axis, list_transform(b, lambda r: list_dot_product(r, axis))) AS power
                  FROM (SELECT k, s, w, b, m, t, p, q, s = 16 AS done, list_sum(list_transform(p, lambda a: list_dot_product(a, a))) AS size,
                          CASE WHEN s = 16 THEN list_transform(big, lambda a: a / sqrt(list_dot_product(big, list_transform(w, lambda r: list_dot_product(r, big))))) END AS axis
                        FROM (SELECT *, q[list_position(list_transform(q, lambda a: list_dot_product(a, a)), list_max(list_transform(q, lambda a: list_dot_product(a, a))))] AS big
                              FROM step)))) WHERE k < 2),
    pair AS (SELECT k - 1 AS component, {_signed("axis")} AS axis FROM step WHERE axis IS NOT NULL)
    {_POINTS}""")
def lda_2d(t):
    return _rounded(projections.lda_2d(t.embeddings, "vec_id", "embedding", "label"), "x", "y")


@query("encode_text", """
    SELECT doc_id, 256 AS dim, CASE WHEN regexp_matches(lower(text), '[\\p{L}\\p{N}_]{2,}') THEN 1.0 END AS length FROM documents""")
def encode_text(t):
    encoded = features.encode_text(t.spread("documents").select("doc_id", "text"), "text")
    return encoded.select(
        "doc_id", F.lit(256).alias("dim"),
        F.when(F.size("embedding") == 256, F.round(vectors.norm(F.col("embedding")), 4)).alias("length"))
