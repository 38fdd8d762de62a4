"""Counts, histograms, vocabularies and TF-IDF over the test tables."""

from pyspark.sql import functions as F

from paperloom.functions import fixed, text
from paperloom.operators import aggregates, features
from paperloom.plans import search
from paperloom.queries.base import lit, query
from paperloom.queries.texts import TOKENS_SQL


def _tokens(t):
    return t.spread("documents").select("doc_id", text.tfidf_tokens(F.col("text")).alias("tokens"))


@query("count_rows", """
    SELECT count(*) AS n_rows, count(*) FILTER (q <> '') AS n_filled
    FROM (SELECT CASE quality WHEN 0 THEN '' WHEN 1 THEN 'good' END AS q FROM documents LEFT JOIN labels USING (doc_id))""")
def count_rows(t):
    q = F.when(F.col("quality") == 0, "").when(F.col("quality") == 1, "good")
    return aggregates.count_rows(t.documents.join(t.labels, "doc_id", "left").withColumn("q", q), "q")


@query("corpus_counts", "SELECT count(*) AS n_read, count(*) FILTER (length(text) > 100) AS n_kept FROM documents")
def corpus_counts(t):
    return aggregates.corpus_counts(t.documents, F.length("text") > 100)


@query("top_publications", """
    SELECT p_brand AS pub, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, pub LIMIT 15""")
def top_publications(t):
    return aggregates.top_publications(t.part.select(F.col("p_brand").alias("pub")))


YEARS = """
    WITH y AS (SELECT CASE WHEN o_orderpriority <> '1-URGENT' THEN year(o_orderdate) END AS year FROM orders)"""


def _years(t):
    return t.orders.select(F.when(F.col("o_orderpriority") != "1-URGENT", F.year("o_orderdate")).alias("year"))


@query("year_histogram", YEARS + """,
    b AS (SELECT min(year) AS lo, max(year) AS hi FROM y),
    bins AS (SELECT CAST(unnest(range(lo, hi)) AS INTEGER) AS bin FROM b)
    SELECT bin, count(year) AS n FROM bins CROSS JOIN b LEFT JOIN y ON least(year, hi - 1) = bin GROUP BY bin""")
def year_histogram(t):
    return aggregates.year_histogram(_years(t))


@query("year_stats", YEARS + """
    SELECT count(year) AS n, round(avg(year), 4) AS mean, round(stddev_pop(year), 4) AS std, min(year) AS min_year,
      max(year) AS max_year, round(avg(year) - 3 * stddev_pop(year), 4) AS lower_bound FROM y""")
def year_stats(t):
    stats = aggregates.year_stats(_years(t))
    for c in ("mean", "std", "lower_bound"):
        stats = stats.withColumn(c, F.round(c, 4))
    return stats


NOISE_SQL = " OR ".join(f"contains(word, {lit(w)})" for w in fixed.TITLE_NOISE + ["red"])


@query("word_frequencies", f"""
    WITH w AS (SELECT unnest(string_split(p_name, ' ')) AS word FROM part
               UNION ALL SELECT unnest(string_split(text, ' ')) FROM documents),
    c AS (SELECT word, count(*) AS n FROM w WHERE word <> '' AND NOT ({NOISE_SQL}) GROUP BY word
          ORDER BY n DESC, word LIMIT 200)
    SELECT word, n, round(n / max(n) OVER (), 4) AS relative FROM c""")
def word_frequencies(t):
    titles = t.part.select(F.col("p_name").alias("title")).unionByName(t.documents.select(F.col("text").alias("title")))
    words = aggregates.title_words(F.col("title"), fixed.TITLE_NOISE + ["red"])
    return aggregates.word_frequencies(titles, words).withColumn("relative", F.round("relative", 4))


@query("bigram_collocations", f"""
    WITH d AS (SELECT doc_id, list_filter(string_split(text, ' '), lambda w: w <> '') AS w FROM documents),
    u AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM d) GROUP BY word),
    t AS (SELECT CAST(sum(n) AS DOUBLE) AS n FROM u),
    b AS (SELECT first, second, count(*) AS n_pair FROM (
            SELECT unnest(w[1 : len(w) - 1]) AS first, unnest(w[2 : len(w)]) AS second FROM d WHERE len(w) > 1) GROUP BY ALL),
    j AS (SELECT b.*, u1.n AS n_first, u2.n AS n_second, t.n AS total,
            CAST(n_pair AS DOUBLE) AS c12, CAST(u1.n AS DOUBLE) AS c1, CAST(u2.n AS DOUBLE) AS c2
          FROM b JOIN u u1 ON u1.word = first JOIN u u2 ON u2.word = second CROSS JOIN t),
    p AS (SELECT *, c2 / total AS p, c12 / c1 AS p1, (c2 - c12) / greatest(total - c1, 1e-10) AS p2 FROM j),
    s AS (SELECT *, CASE WHEN total <= c1 OR total <= c2 THEN 0 ELSE -2 * (
        ln(greatest(p, 1e-10)) * c12 + ln(greatest(1 - p, 1e-10)) * (c1 - c12)
        + ln(greatest(p, 1e-10)) * (c2 - c12) + ln(greatest(1 - p, 1e-10)) * (total - c1 - (c2 - c12))
        - ln(greatest(p1, 1e-10)) * c12 - ln(greatest(1 - p1, 1e-10)) * (c1 - c12)
        - ln(greatest(p2, 1e-10)) * (c2 - c12) - ln(greatest(1 - p2, 1e-10)) * (total - c1 - (c2 - c12))) END AS score FROM p)
    SELECT first, second, n_pair, n_first, n_second, round(score, 4) AS score FROM s WHERE score > 30""")
def bigram_collocations(t):
    found = aggregates.bigram_collocations(t.spread("documents"), F.split("text", " "))
    return found.withColumn("score", F.round("score", 4))


VOCABULARY = f"""
    tok AS (SELECT doc_id, unnest({TOKENS_SQL}) AS term FROM documents),
    vocab AS (SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM tok GROUP BY term
              ORDER BY tf DESC, term LIMIT 16384),
    idf AS (SELECT *, ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1 AS idf FROM vocab)"""


@query("term_vocabulary", f"WITH {VOCABULARY} SELECT term, tf, df FROM vocab")
def term_vocabulary(t):
    return aggregates.term_vocabulary(_tokens(t))


@query("idf_table", f"WITH {VOCABULARY} SELECT term, tf, df, round(idf, 4) AS idf FROM idf")
def idf_table(t):
    return aggregates.idf_table(_tokens(t)).withColumn("idf", F.round("idf", 4))


WEIGHTS = VOCABULARY + """,
    tfs AS (SELECT doc_id, term, count(*) AS n FROM tok GROUP BY ALL),
    raw AS (SELECT doc_id, term, n * idf AS w FROM tfs JOIN idf USING (term)),
    weights AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM raw)"""


@query("tfidf", f"WITH {WEIGHTS} SELECT doc_id, term, round(w, 4) AS weight FROM weights")
def tfidf(t):
    tokens = _tokens(t)
    weights = features.tfidf(tokens, aggregates.idf_table(tokens), "doc_id")
    return weights.withColumn("weight", F.round("weight", 4))


@query("similar_documents", f"""
    WITH {WEIGHTS},
    qtok AS (SELECT item_id, unnest({TOKENS_SQL}) AS term FROM benchmark),
    qraw AS (SELECT item_id, term, count(*) * idf AS w FROM qtok JOIN idf USING (term) GROUP BY item_id, term, idf),
    q AS (SELECT item_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS w FROM qraw),
    s AS (SELECT item_id, doc_id, sqrt(greatest(2 * (1 - sum(q.w * weights.w)), 0)) AS dist
          FROM q JOIN weights USING (term) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(dist, 6), doc_id) AS rank FROM s)
    SELECT item_id AS query_id, doc_id AS id, round(dist, 4) AS dist, rank, lang, source
    FROM r JOIN documents USING (doc_id) WHERE rank <= 10""")
def similar_documents(t):
    hits = search.similar_documents(t.benchmark, t.spread("documents"), "item_id", "doc_id")
    docs = t.documents.select(F.col("doc_id").alias("id"), "lang", "source")
    return docs.join(hits, "id").select("query_id", "id", F.round("dist", 4).alias("dist"), "rank", "lang", "source")


@query("label_encode", """
    SELECT doc_id, source, CAST(dense_rank() OVER (ORDER BY source) - 1 AS INTEGER) AS label FROM documents""")
def label_encode(t):
    return aggregates.label_encode(t.documents.select("doc_id", "source"), "source")


NGRAMS = f"""
    d AS (SELECT {TOKENS_SQL} AS w FROM documents),
    g AS (SELECT unnest(w[1 : len(w) - 1]) AS context, unnest(w[2 : len(w)]) AS next FROM d WHERE len(w) > 1),
    counts AS (SELECT context, next, count(*) AS n FROM g GROUP BY ALL),
    grams AS (SELECT context, next, n, n / sum(n) OVER (PARTITION BY context) AS share FROM counts)"""


def ngrams(t):
    return aggregates.ngram_counts(t.spread("documents"), text.tfidf_tokens(F.col("text")))


@query("ngram_counts", f"WITH {NGRAMS} SELECT context, next, n, round(share, 4) AS share FROM grams")
def ngram_counts(t):
    return ngrams(t).withColumn("share", F.round("share", 4))
