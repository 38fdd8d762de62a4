"""Whole jobs: ingest, curation, profiles, search, evaluation, streams."""

import numpy as np
from pyspark.sql import functions as F

from paperloom.functions import fixed, text
from paperloom.operators import aggregates, features
from paperloom.plans import corpus, evaluate, ingest, profile, search, upkeep
from paperloom.queries.base import between, lit, query, replaces, scratch_path, staged
from paperloom.queries.language import backoff_model, suggest_sql
from paperloom.queries.texts import (
    BODY_SQL, CATEGORIES, CATEGORY_ROWS, DECODE_STEP, HEX_STEPS, PUB_SQL, RAW_TOKENS_SQL, STOP_SQL, STOP_WORDS, TOKENS_SQL, WS,
    article, journal_sql,
)
from paperloom.sources import models, store
from paperloom.streaming.ingest import stream_ingest
from paperloom.streaming.search import stream_search, stream_search_changed


def papers(t):
    """Documents as stored papers."""
    return ingest._as_papers(t.spread("documents").select(
        F.col("doc_id").alias("id"), F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("bibcode"),
        F.col("source").alias("title"), F.col("lang").alias("pub"), F.col("text").alias("abstract"),
    ))


def metadata(t):
    """Documents as metadata records; copies share their id with the first text."""
    return t.documents.select(
        F.md5("text").alias("id"), F.concat("source", F.lit(" \n  x")).alias("title"), F.col("text").alias("abstract"),
        F.concat(F.lit("J, "), F.col("n_chars").cast("string")).alias("journal-ref"),
        F.concat("lang", F.lit(" "), "source").alias("categories"),
        F.array(F.struct(F.lit("v1").alias("version"), F.lit("Mon, 2 Apr 2007 19:18:42 GMT").alias("created"))).alias("versions"),
        F.col("doc_id").alias("_row"),
    )


CLEAN = [("\n", " "), ("  ", " ")]
INGESTED = f"""
    WITH m(code, name) AS (VALUES {CATEGORY_ROWS}),
    codes AS (SELECT doc_id, unnest([lang, source]) AS code, unnest([1, 2]) AS pos FROM documents),
    named AS (SELECT doc_id, string_agg(name, ',' ORDER BY pos) || ',' AS categories FROM codes JOIN m USING (code) GROUP BY doc_id),
    rows AS (SELECT doc_id, md5(text) AS bibcode, trim({replaces("source || ' ' || chr(10) || '  x'", CLEAN)}, {WS}) AS title,
               trim({replaces('text', CLEAN)}, {WS}) AS abstract, 'J, ' || n_chars AS pub, CAST(n_chars AS INTEGER) AS year, categories
             FROM documents JOIN named USING (doc_id))
    SELECT bibcode, title, abstract, pub, year, categories FROM rows
    QUALIFY row_number() OVER (PARTITION BY bibcode ORDER BY doc_id) = 1"""
PAPER_COLUMNS = ["bibcode", "title", "abstract", "pub", "year", "categories"]


@query("ingest_jsonl", INGESTED + " AND bibcode NOT IN (SELECT md5(text) FROM documents SEMI JOIN labels USING (doc_id))")
def ingest_jsonl(t):
    """A dump is written, read and appended to stored papers; what was appended is returned."""
    dump, target = scratch_path(t, "dump"), scratch_path(t, "papers")
    metadata(t).repartitionByRange("_row").sortWithinPartitions("_row").drop("_row").write.json(dump)
    stored = t.documents.join(t.labels, "doc_id", "left_semi").select(F.md5("text").alias("bibcode")).distinct()
    ingest._as_papers(stored.withColumn("submitter", F.lit("stored"))).write.parquet(target)
    ingest.ingest_jsonl(t.spark, dump, target, CATEGORIES)
    known = stored.withColumnRenamed("bibcode", "old")
    found = t.spark.read.parquet(target)
    return found.join(known, found["bibcode"] == known["old"], "left_anti").select(*PAPER_COLUMNS)


@query("stream_ingest", INGESTED)
def streamed_ingest(t):
    dump, target = scratch_path(t, "dump"), scratch_path(t, "papers")
    # Range-partitioned, sorted files keep the line order of the dump equal to the order of the ids.
    metadata(t).repartitionByRange("_row").sortWithinPartitions("_row").drop("_row").write.json(dump)
    ingest._as_papers(metadata(t).limit(0).select(F.col("id").alias("bibcode"))).write.parquet(target)
    for _ in range(2):  # the second stream starts from nothing and finds every key stored
        stream_ingest(t.spark, dump, target, scratch_path(t, "checkpoint"), CATEGORIES).awaitTermination()
    return t.spark.read.parquet(target).select(*PAPER_COLUMNS)


@query("ingest_search", """
    WITH hits AS (SELECT * FROM part WHERE p_size <= 30 AND contains(lower(p_name), 'ring') AND p_brand <> 'Brand#1'),
    cited AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM hits)),
    refs AS (SELECT * FROM part WHERE p_partkey IN (SELECT k FROM cited) AND p_brand <> 'Brand#1'
             AND p_partkey NOT IN (SELECT p_partkey FROM hits))
    SELECT CAST(p_partkey AS VARCHAR) AS bibcode, p_type AS title, p_name AS abstract, p_brand AS pub, p_size AS year,
      'Ring' AS categories FROM (SELECT * FROM hits UNION ALL SELECT * FROM refs)""")
def ingest_search(t):
    responses = t.part.select(
        F.col("p_partkey").cast("string").alias("bibcode"), F.array("p_type").alias("title"), F.col("p_name").alias("abstract"),
        F.col("p_brand").alias("pub"), F.col("p_size").cast("string").alias("year"))
    edges = t.lineitem.select(F.col("l_partkey").cast("string").alias("citing"), F.col("l_suppkey").cast("string").alias("cited"))
    stored = responses.filter("pub = 'Brand#1'").select("bibcode")
    found = ingest.ingest_search(responses.filter("cast(year as int) <= 30"), edges, responses, stored, "Ring")
    return found.select(*PAPER_COLUMNS)


CURATED_WORDS = fixed.OFF_TOPIC_WORDS + ["ndernt", "Eauouon"]
CURATED_BAD = " OR ".join(f"contains(text, {lit(w)})" for w in CURATED_WORDS)
CURATED_STEPS = [between("c", m) for m in fixed.SECTION_MARKERS] + [replaces("c", fixed.MARKUP_RULES)] + HEX_STEPS
SHOUTED = [(", ", " Abstract~ "), (". ", "± <SUB>ﬁ</SUB> ")]


@query("curate_corpus", f"""
    WITH kept AS (SELECT doc_id, lang AS abstract, {replaces('text', SHOUTED)} AS text FROM documents WHERE NOT ({CURATED_BAD})),
    samples AS (SELECT doc_id, abstract AS c FROM kept UNION ALL SELECT doc_id, text FROM kept WHERE length(text) > 100),
    hexed AS ({staged("SELECT doc_id, c FROM samples WHERE c <> ''", CURATED_STEPS, "doc_id")}),
    plain AS (SELECT doc_id, length(c) / 3 AS n, {DECODE_STEP} AS v FROM hexed)
    SELECT doc_id, trim(v, {WS}) AS value FROM plain WHERE contains(v, ' ') AND n > 100""")
def curate_corpus(t):
    dressed = t.spread("documents").select(
        "doc_id", F.col("source").alias("title"), F.col("lang").alias("abstract"),
        text.replace_all(F.col("text"), SHOUTED).alias("text"))
    return corpus.curate_corpus(dressed, CURATED_WORDS).select("doc_id", "value")


BODIES_BAD = " OR ".join(f"contains(lang, {lit(w)}) OR contains(source, {lit(w)})" for w in fixed.BODY_OFF_TOPIC_WORDS + ["src1"])


@query("extract_bodies", f"""
    WITH p AS (SELECT doc_id, lang, source, {PUB_SQL} AS pub, {BODY_SQL} AS c,
                 CASE WHEN quality = 1 THEN 'done' WHEN quality = 0 THEN '' END AS text
               FROM documents LEFT JOIN labels USING (doc_id)),
    todo AS (SELECT doc_id, pub, c FROM p WHERE pub <> 'Other' AND coalesce(text, '') = '' AND NOT ({BODIES_BAD})),
    b AS ({journal_sql('SELECT * FROM todo', 'doc_id')})
    SELECT p.doc_id AS bibcode, p.pub, CASE WHEN b.doc_id IS NULL THEN p.text
      ELSE {replaces('b.c', [(chr(10), ' '), ('- ', ''), (chr(12), ''), ('  ', ' ')])} END AS text
    FROM p LEFT JOIN b USING (doc_id)""")
def extract_bodies(t):
    docs = article(t.spread("documents")).join(t.labels, "doc_id", "left")
    done = F.when(F.col("quality") == 1, "done").when(F.col("quality") == 0, "")
    stored = docs.select(
        F.col("doc_id").alias("bibcode"), "pub", done.alias("text"), F.col("source").alias("title"), F.col("lang").alias("abstract"))
    texts = docs.select(F.col("doc_id").alias("bibcode"), "body")
    filled = corpus.extract_bodies(stored, texts, fixed.BODY_OFF_TOPIC_WORDS + ["src1"])
    return filled.select("bibcode", "pub", "text")


PROFILE_BAD = " OR ".join(f"contains(p_name, {lit(w)}) OR contains(p_type, {lit(w)})" for w in fixed.PROFILE_OFF_TOPIC_WORDS + ["red"])
PROFILE_NOISE = " OR ".join(f"contains(k, {lit(w)})" for w in fixed.TITLE_NOISE)


@query("profile_corpus", f"""
    WITH p AS (SELECT p_name AS title, p_brand AS pub, 1970 + p_size AS year FROM part WHERE NOT ({PROFILE_BAD})),
    b AS (SELECT min(year) AS lo, max(year) AS hi FROM p),
    bins AS (SELECT unnest(range(lo, hi)) AS bin FROM b),
    w AS (SELECT list_filter(string_split(title, ' '), lambda k: k <> '' AND NOT ({PROFILE_NOISE})) AS w FROM p),
    u AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM w) GROUP BY word),
    t AS (SELECT CAST(sum(n) AS DOUBLE) AS n FROM u),
    g AS (SELECT first, second, count(*) AS n_pair FROM (
            SELECT unnest(w[1 : len(w) - 1]) AS first, unnest(w[2 : len(w)]) AS second FROM w WHERE len(w) > 1) GROUP BY ALL),
    c AS (SELECT g.*, t.n AS n, CAST(n_pair AS DOUBLE) AS k12, CAST(x.n AS DOUBLE) AS k1, CAST(y.n AS DOUBLE) AS k2
          FROM g JOIN u x ON x.word = first JOIN u y ON y.word = second CROSS JOIN t),
    q AS (SELECT *, k2 / n AS p, k12 / k1 AS p1, (k2 - k12) / greatest(n - k1, 1e-10) AS p2 FROM c),
    s AS (SELECT *, CASE WHEN n <= k1 OR n <= k2 THEN 0 ELSE -2 * (
        ln(greatest(p, 1e-10)) * k12 + ln(greatest(1 - p, 1e-10)) * (k1 - k12)
        + ln(greatest(p, 1e-10)) * (k2 - k12) + ln(greatest(1 - p, 1e-10)) * (n - k1 - (k2 - k12))
        - ln(greatest(p1, 1e-10)) * k12 - ln(greatest(1 - p1, 1e-10)) * (k1 - k12)
        - ln(greatest(p2, 1e-10)) * (k2 - k12) - ln(greatest(1 - p2, 1e-10)) * (n - k1 - (k2 - k12))) END AS score FROM q)
    SELECT * FROM (SELECT 'publications' AS stat, pub AS k, count(*) AS n, CAST(NULL AS DOUBLE) AS value FROM p GROUP BY pub ORDER BY n DESC, pub LIMIT 15)
    UNION ALL SELECT 'years', CAST(bin AS VARCHAR), count(year), NULL FROM bins CROSS JOIN b LEFT JOIN p ON least(year, hi - 1) = bin GROUP BY bin
    UNION ALL SELECT 'year_stats', k, n, round(v, 4) FROM (
      SELECT count(*) AS n, unnest(['mean', 'std', 'min_year', 'max_year', 'lower_bound']) AS k,
        unnest([avg(year), stddev_pop(year), min(year), max(year), avg(year) - 3 * stddev_pop(year)]) AS v FROM p)
    UNION ALL SELECT * FROM (SELECT 'words', word, n, NULL FROM u ORDER BY n DESC, word LIMIT 200)
    UNION ALL SELECT 'bigrams', first || ' ' || second, n_pair, round(score, 4) FROM s WHERE score > 30""")
def profile_corpus(t):
    kept = t.part.select(
        F.col("p_name").alias("title"), F.col("p_type").alias("abstract"), F.col("p_brand").alias("pub"),
        (F.lit(1970) + F.col("p_size")).alias("year"))
    stats = profile.profile_corpus(kept, fixed.PROFILE_OFF_TOPIC_WORDS + ["red"])
    years = ("mean", "std", "min_year", "max_year", "lower_bound")
    spread = stats["year_stats"].select("n", F.inline(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("double").alias("value")) for c in years])))
    parts = {
        "publications": stats["publications"].select(F.col("pub").alias("k"), "n", F.lit(None).cast("double").alias("value")),
        "years": stats["years"].select(F.col("bin").cast("string").alias("k"), "n", F.lit(None).cast("double").alias("value")),
        "year_stats": spread,
        "words": stats["words"].select(F.col("word").alias("k"), "n", F.lit(None).cast("double").alias("value")),
        "bigrams": stats["bigrams"].select(F.concat_ws(" ", "first", "second").alias("k"), F.col("n_pair").alias("n"), F.col("score").alias("value")),
    }
    out = None
    for name, part in parts.items():
        part = part.select(F.lit(name).alias("stat"), "k", F.col("n").cast("long").alias("n"), F.round("value", 4).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


@query("save_model", f"""
    WITH tok AS (SELECT doc_id, unnest({TOKENS_SQL}) AS term FROM documents),
    v AS (SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM tok GROUP BY term ORDER BY tf DESC, term LIMIT 16384)
    SELECT term, round(ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1, 4) AS idf FROM v""")
def save_model(t):
    """The vocabulary of all texts, saved and loaded; semantic_search saves and loads a whole index."""
    tokens = t.spread("documents").select("doc_id", text.tfidf_tokens(F.col("text")).alias("tokens"))
    path = scratch_path(t, "vocabulary")
    models.save_vocabulary(t.spark, features.TfidfModel.from_table(aggregates.idf_table(tokens)), path)
    back = models.load_vocabulary(t.spark, path)
    return t.spark.createDataFrame(list(zip(back.terms, back.idf)), "term string, idf double").withColumn("idf", F.round("idf", 4))


def _queries(t):
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


NORMAL = f"""list_filter({RAW_TOKENS_SQL}, lambda w: NOT list_contains({STOP_SQL}, w)
      AND instr({lit(fixed.PUNCTUATION)}, w) = 0 AND w <> '')"""
PROCESSED_TOKENS = f"regexp_extract_all(array_to_string({NORMAL}, ' '), {lit(fixed.WORD_RUN)})"


# Up to 1,200 texts the production width keeps every component, so for texts of the corpus the projected angle
# equals that of the centred TF-IDF vectors; every cell is probed. More texts have no counterpart in SQL.
SEMANTIC = f"""
    asked AS (SELECT doc_id AS item_id, text FROM documents WHERE doc_id % 100 = 0),
    tok AS (SELECT doc_id, unnest({PROCESSED_TOKENS}) AS term FROM documents),
    vocab AS (SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM tok GROUP BY term ORDER BY tf DESC, term LIMIT 16384),
    idf AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1 AS idf FROM vocab),
    raw AS (SELECT doc_id, term, count(*) * idf AS w FROM tok JOIN idf USING (term) GROUP BY doc_id, term, idf),
    x AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM raw),
    qtok AS (SELECT item_id, unnest({PROCESSED_TOKENS}) AS term FROM asked),
    qraw AS (SELECT item_id, term, count(*) * idf AS w FROM qtok JOIN idf USING (term) GROUP BY item_id, term, idf),
    q AS (SELECT item_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS w FROM qraw),
    mu AS (SELECT term, sum(w) / (SELECT count(*) FROM documents) AS m FROM x GROUP BY term),
    mm AS (SELECT sum(m * m) AS mm FROM mu),
    dx AS (SELECT doc_id, coalesce(sum(x.w * m), 0) AS xm, coalesce(sum(x.w * x.w), 0) AS xx
           FROM documents LEFT JOIN x USING (doc_id) LEFT JOIN mu USING (term) GROUP BY doc_id),
    dq AS (SELECT item_id, coalesce(sum(q.w * m), 0) AS qm, coalesce(sum(q.w * q.w), 0) AS qq
           FROM asked LEFT JOIN q USING (item_id) LEFT JOIN mu USING (term) GROUP BY item_id),
    xq AS (SELECT item_id, doc_id, sum(q.w * x.w) AS xq FROM q JOIN x USING (term) GROUP BY ALL),
    s AS (SELECT item_id, doc_id, (coalesce(xq, 0) - xm - qm + mm) / sqrt((xx - 2 * xm + mm) * (qq - 2 * qm + mm)) AS cos
          FROM dx CROSS JOIN dq CROSS JOIN mm LEFT JOIN xq USING (item_id, doc_id)),
    r AS (SELECT item_id, doc_id, sqrt(greatest(2 * (1 - cos), 0)) AS dist FROM s),
    found AS (SELECT item_id AS query_id, doc_id AS id, source AS title, dist, row_number() OVER (PARTITION BY item_id ORDER BY round(dist, 6), doc_id) AS rank
              FROM r JOIN documents USING (doc_id) QUALIFY rank <= 10)"""
BIBCODE_SQL = "'d' || lpad(CAST({} AS VARCHAR), 12, '0')"


def _asked(t):
    """Every hundredth document as a query text."""
    return t.documents.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))


def _saved_index(t):
    """An index of the production width, written and read back."""
    path = scratch_path(t, "index")
    models.save_model(search.build_index(papers(t), cells=16, components=1200, stop_words=STOP_WORDS), path)
    return models.load_model(t.spark, path)


@query("semantic_search", f"WITH {SEMANTIC} SELECT query_id, id, title, round(dist, 4) AS dist, rank FROM found")
def semantic_search(t):
    index = _saved_index(t)
    find = search.search_function(index, nprobe=16, stop_words=STOP_WORDS)
    found = search.semantic_search(_asked(t), index.papers, find)
    return found.select("query_id", "id", "title", F.round("dist", 4).alias("dist"), "rank")


@query("build_index", f"""
    SELECT row_number() OVER (ORDER BY bibcode) - 1 AS id, bibcode, 1 AS n_cells, true AS nearest
    FROM (SELECT {BIBCODE_SQL.format("doc_id")} AS bibcode FROM documents)""")
def build_index(t):
    # Every paper lies in one cell, whose centre is the nearest of all.
    index = search.build_index(papers(t), cells=32)
    stored = index.cells.cells
    nearest = index.cells.probes(stored.select("id", "vec"), 0, 1, 0).select("id", F.col("cells")[0].alias("near"))
    placed = stored.join(nearest, "id").groupBy("id").agg(F.count("*").alias("n_cells"), F.bool_and(F.col("cell") == F.col("near")).alias("nearest"))
    return index.papers.select("id", "bibcode").join(placed, "id", "left")


@query("index_upkeep", f"""
    SELECT row_number() OVER (ORDER BY doc_id % 3, bibcode) - 1 AS id, bibcode, 1 AS n_cells
    FROM (SELECT doc_id, {BIBCODE_SQL.format("doc_id")} AS bibcode FROM documents)""")
def index_upkeep(t):
    # An index of a third of the papers takes the others in two steps, each with known ones among them.
    path, every = scratch_path(t, "index"), papers(t)
    third = lambda *rest: every.where(F.col("id").isNotNull() & (F.col("id") % 3).isin(*rest))
    models.save_model(search.build_index(third(0), cells=16, stop_words=STOP_WORDS), path)
    upkeep.add_papers(t.spark, path, third(0, 1), STOP_WORDS)
    index = upkeep.add_papers(t.spark, path, third(1, 2), STOP_WORDS)
    n_cells = index.cells.cells.groupBy("id").agg(F.countDistinct("cell").alias("n_cells"))
    return index.papers.select("id", "bibcode").join(n_cells, "id", "left")


@query("recommend", f"""
    WITH {SEMANTIC},
    {suggest_sql(f"SELECT item_id, t[greatest(len(t) - 39, 1) : len(t)] AS h FROM (SELECT item_id, {TOKENS_SQL.replace('(text)', '(right(text, 200))')} AS t FROM asked)", k=6)}
    SELECT item_id AS prompt_id, 'text' AS kind, rank, suggestion AS value FROM suggested
    UNION ALL SELECT query_id, 'paper', rank, {BIBCODE_SQL.format("id")} FROM found""")
def recommend(t):
    index = _saved_index(t)
    prompts = _asked(t).select(F.col("query_id").alias("prompt_id"), F.col("query").alias("prompt"))
    find = search.search_function(index, nprobe=16, stop_words=STOP_WORDS)
    suggested, similar = search.recommend(prompts, index.papers, find, backoff_model(t))
    texts = suggested.select("prompt_id", F.lit("text").alias("kind"), "rank", F.col("suggestion").alias("value"))
    return texts.unionByName(similar.select(
        F.col("query_id").alias("prompt_id"), F.lit("paper").alias("kind"), "rank", F.col("bibcode").alias("value")))


@query("stream_search", f"WITH {SEMANTIC} SELECT query_id, rank, id, round(dist, 4) AS dist, {BIBCODE_SQL.format('id')} AS bibcode FROM found")
def streamed_search(t):
    index = _saved_index(t)
    asked, sink = scratch_path(t, "asked"), scratch_path(t, "answers")
    _asked(t).write.json(asked)
    find = search.search_function(index, nprobe=16, stop_words=STOP_WORDS)
    stream_search(t.spark, asked, index.papers, find, sink, scratch_path(t, "checkpoint")).awaitTermination()
    return t.spark.read.parquet(sink).select("query_id", "rank", "id", F.round("dist", 4).alias("dist"), "bibcode")


@query("embed_papers", """
    SELECT 'd' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS bibcode,
      CASE WHEN regexp_matches(lower(text), '[\\p{L}\\p{N}_]{2,}') THEN 256 END AS n_values FROM documents""")
def embed_papers(t):
    embedded = evaluate.embed_papers(papers(t))
    filled = F.when(F.col("abstract_embedding").isNotNull(), F.size(F.split("abstract_embedding", ",")))
    return embedded.select("bibcode", filled.alias("n_values"))


@query("evaluate_embeddings")
def evaluate_embeddings(t):
    docs = t.spread("documents").select(
        F.concat("lang", F.lit("-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file"), "text")
    results = evaluate.evaluate_embeddings(docs, 100)
    scores = results["scores"]
    metrics = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in scores.columns]))
    long = scores.select(metrics.alias("m")).select("m.metric", "m.value")
    cats = results["in_out"]
    parts = [
        long,
        cats.select(F.concat(F.lit("in "), "cat").alias("metric"), F.col("in_sim").alias("value")),
        cats.select(F.concat(F.lit("out "), "cat").alias("metric"), F.col("out_sim").alias("value")),
        results["neighbors"].agg(F.count("*").cast("double").alias("value")).select(F.lit("neighbour edges").alias("metric"), "value"),
        *[results[name].agg(F.var_samp("x").alias("value")).select(F.lit(f"{name} variance").alias("metric"), "value") for name in ("pca", "lda")],
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# --- callables in the place of named parts ------------------------------------------------------

@query("chunk_callable", """
    SELECT doc_id, unnest(range(len(c))) AS chunk_ix, unnest(c) AS chunk FROM (SELECT doc_id, string_split(text, ', ') AS c FROM documents)""")
def chunk_callable(t):
    own = text.chunker(lambda c: F.split(c, ", "))
    return t.spread("documents").select("doc_id", F.posexplode(own(F.col("text"))).alias("chunk_ix", "chunk"))


LETTERS = "aeiou"


def letter_counts():
    """An encoder that SQL can repeat: how often a text holds each vowel."""
    return lambda texts: np.array([[t.count(c) for c in LETTERS] for t in texts], dtype=float).reshape(len(texts), len(LETTERS))


@query("encode_callable", f"""
    SELECT doc_id, {', '.join(f"CAST(length(text) - length(replace(text, '{c}', '')) AS DOUBLE) AS {c}" for c in LETTERS)} FROM documents""")
def encode_callable(t):
    encoded = features.encode_text(t.spread("documents").select("doc_id", "text"), "text", make_encoder=letter_counts)
    return encoded.select("doc_id", *[F.col("embedding")[i].alias(c) for i, c in enumerate(LETTERS)])


@query("search_callable", """
    SELECT item_id AS query_id, r + 1 AS rank, round(r / 10.0, 4)::DOUBLE AS dist, doc_id AS id, source AS title
    FROM benchmark, (SELECT unnest(range(10)) AS r), documents WHERE doc_id = item_id + r""")
def search_callable(t):
    def next_ids(asked, k):
        hits = asked.select("query_id", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("r"))
        return hits.select("query_id", (F.col("query_id") + F.col("r")).alias("id"), (F.col("r") / 10.0).alias("dist"), (F.col("r") + 1).alias("rank"))

    found = search.semantic_search(_queries(t), papers(t), next_ids)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), F.round("dist", 4).alias("dist"), "id", "title")


def next_ids(asked, k):
    """Hits that SQL can repeat: the documents whose ids follow that of the query."""
    hits = asked.select("query_id", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("r"))
    return hits.select("query_id", (F.col("query_id") % 1_000_000_000 + F.col("r")).alias("id"), (F.col("r") / 10.0).alias("dist"), (F.col("r") + 1).alias("rank"))


@query("stream_search_changed", """
    SELECT q.query_id, r + 1 AS rank, d.doc_id AS id, q.times AS times
    FROM (SELECT doc_id AS query_id, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS times FROM documents
          UNION ALL SELECT doc_id + 1000000000, 1 FROM documents) q,
      (SELECT unnest(range(10)) AS r), documents d WHERE d.doc_id = q.query_id % 1000000000 + r""")
def streamed_changes(t):
    # Every document asks; the same again with new ids beside them; then the even ones with another text and the rest unchanged.
    first = t.documents.select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    other = first.withColumn("query_id", F.col("query_id") + 1_000_000_000)
    changed = first.withColumn("query", F.when(F.col("query_id") % 2 == 0, F.concat(F.lit("new "), F.coalesce("query", F.lit("")))).otherwise(F.col("query")))
    asked, sink, checkpoint = (scratch_path(t, name) for name in ("asked", "answers", "checkpoint"))
    for batch in (first, first.unionByName(other), changed):
        batch.write.mode("append").json(asked, compression="gzip")
        stream_search_changed(t.spark, asked, papers(t), next_ids, sink, checkpoint).awaitTermination()
    return t.spark.read.parquet(sink).groupBy("query_id", F.col("rank").cast("long").alias("rank"), "id").agg(F.count("*").alias("times"))
