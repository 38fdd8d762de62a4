"""Predicates, joins, orders and the papers table over the test tables."""

import os
import uuid
from urllib.parse import urlparse

from pyspark.sql import functions as F

from paperloom import schema
from paperloom.functions import fixed, predicates, text
from paperloom.functions.vectors import csv_to_vector, vector_to_csv
from paperloom.operators import relations, windows
from paperloom.queries.base import lit, query, scratch_path
from paperloom.queries.texts import LEMMA_SQL, RAW_TOKENS_SQL, TOKENS_SQL, lemma_table
from paperloom.sources import buckets, readers, sinks, store


def _labelled(t):
    return t.documents.join(t.labels, "doc_id", "left")


LABELLED = "documents LEFT JOIN labels USING (doc_id)"


# --- predicates --------------------------------------------------------------------------------

@query("query_where", """
    SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'en' AND n_chars > 500 ORDER BY doc_id LIMIT 10""")
def query_where(t):
    found = relations.query_where(t.documents, F.col("lang") == "en", F.col("n_chars") > 500, order=["doc_id"])
    return found.select("doc_id", "lang", "n_chars")


BAD_WORDS = fixed.OFF_TOPIC_WORDS + ["retitioning", "Eauouon", "eauouon", "ndernt"]
BAD_SQL = " OR ".join(f"contains(text, {lit(w)}) OR contains(source, {lit(w)})" for w in BAD_WORDS)


@query("contains_any", f"SELECT doc_id FROM documents WHERE NOT ({BAD_SQL})")
def contains_any(t):
    return relations.drop_off_topic(t.spread("documents"), ["text", "source"], BAD_WORDS).select("doc_id")


@query("non_blank", f"""
    SELECT doc_id FROM (SELECT doc_id, text, CASE quality WHEN 0 THEN '' WHEN 1 THEN 'good' END AS q FROM {LABELLED})
    WHERE q IS NOT NULL AND q <> '' AND text <> ''""")
def non_blank(t):
    q = F.when(F.col("quality") == 0, "").when(F.col("quality") == 1, "good")
    return _labelled(t).withColumn("q", q).filter(predicates.non_blank(F.col("q"), F.col("text"))).select("doc_id")


@query("pub_in", "SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src5', 'src12')")
def pub_in(t):
    return t.documents.filter(predicates.pub_in(F.col("source"), ["src1", "src5", "src12"])).select("doc_id", "source")


@query("unprocessed", f"""
    SELECT doc_id FROM (SELECT doc_id, CASE quality WHEN 0 THEN '' WHEN 1 THEN 'good' END AS q FROM {LABELLED})
    WHERE coalesce(q, '') = ''""")
def unprocessed(t):
    q = F.when(F.col("quality") == 0, "").when(F.col("quality") == 1, "good")
    return _labelled(t).withColumn("q", q).filter(predicates.unprocessed(F.col("q"))).select("doc_id")


@query("query_in_text", "SELECT doc_id FROM documents WHERE contains(lower(text), 'ention')")
def query_in_text(t):
    return t.documents.filter(predicates.query_in_text(F.col("text"), "ENTION")).select("doc_id")


@query("drop_null_abstract", f"""
    SELECT doc_id, a AS abstract FROM (
      SELECT doc_id, CASE WHEN quality = 0 THEN '' WHEN quality = 1 THEN text END AS a FROM {LABELLED})
    WHERE a IS NOT NULL""")
def drop_null_abstract(t):
    abstract = F.when(F.col("quality") == 0, "").when(F.col("quality") == 1, F.col("text"))
    return relations.drop_null_abstract(_labelled(t).select("doc_id", abstract.alias("abstract")))


@query("has_space_and_min_bytes", """
    SELECT doc_id FROM documents WHERE contains(text, ' ') AND octet_length(encode(text)) > 400""")
def has_space_and_min_bytes(t):
    return t.documents.filter(predicates.has_space_and_min_bytes(F.col("text"), 400)).select("doc_id")


@query("min_chars", "SELECT doc_id FROM documents WHERE length(text) > 100")
def min_chars(t):
    return t.documents.filter(predicates.min_chars(F.col("text"))).select("doc_id")


NOISE = ["tion", "th", "ou", "é"]


@query("drop_tokens_containing", f"""
    SELECT doc_id, array_to_string(list_filter(string_split(text, ' '),
      lambda w: NOT ({" OR ".join(f"contains(w, '{n}')" for n in NOISE)})), ' ') AS c FROM documents""")
def drop_tokens_containing(t):
    kept = predicates.drop_tokens_containing(F.split("text", " "), NOISE)
    return t.documents.select("doc_id", F.array_join(kept, " ").alias("c"))


# --- sources and sinks -------------------------------------------------------------------------

@query("read_papers_jsonl", """
    SELECT CAST(doc_id AS VARCHAR) AS id, source AS title, text AS abstract, lang AS categories, 'J, ' || n_chars AS journal
    FROM documents""")
def read_papers_jsonl(t):
    path = scratch_path(t, "dump")
    t.documents.select(
        F.col("doc_id").cast("string").alias("id"), F.col("source").alias("title"), F.col("text").alias("abstract"),
        F.concat(F.lit("J, "), F.col("n_chars").cast("string")).alias("journal-ref"), F.col("lang").alias("categories"),
        F.array(F.struct(F.lit("v1").alias("version"), F.lit("Mon, 2 Apr 2007 19:18:42 GMT").alias("created"))).alias("versions"),
    ).write.json(path)
    dump = readers.read_papers_jsonl(t.spark, path)
    return dump.select("id", "title", "abstract", "categories", F.col("journal-ref").alias("journal"))


@query("read_text_lines", """
    SELECT line AS value, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY ALL""")
def read_text_lines(t):
    path = scratch_path(t, "lines")
    t.documents.select(F.explode(F.split("text", "\n")).alias("value")).write.text(path)
    return readers.read_text_lines(t.spark, path).groupBy("value").agg(F.count("*").alias("n"))


@query("write_text_corpus", f"""
    SELECT trim(regexp_replace(text, '[\\r\\n]+', ' ', 'g'), {lit(fixed.WHITESPACE)}) AS value, count(*) AS n
    FROM documents GROUP BY ALL""")
def write_text_corpus(t):
    path = scratch_path(t, "corpus")
    sinks.write_text_corpus(t.documents.select(F.col("text").alias("value")), path)
    return readers.read_text_lines(t.spark, path).groupBy("value").agg(F.count("*").alias("n"))


def _write_files(texts, path):
    """``(name, text)`` rows as one file ``name.txt`` each, in one folder.

    Spark's writer takes a folder and two processes (chmod of the file and of its checksum) for each file of a local folder, so
    the tasks write these themselves; each file appears whole, and a task that is run again writes the same ones.
    """
    if urlparse(path).scheme not in ("", "file"):
        texts.withColumn("text", F.coalesce("text", F.lit(""))).write.partitionBy("name").text(path)
        return
    folder = urlparse(path).path
    os.makedirs(folder)

    def write(rows):
        for row in rows:
            beside = f"{folder}/.{row['name']}-{uuid.uuid4().hex}"
            with open(beside, "w", encoding="utf-8", newline="") as file:
                file.write(row["text"] + "\n")
            os.replace(beside, f"{folder}/{row['name']}.txt")

    texts.foreachPartition(write)


@query("read_markdown_dir", "SELECT '# ' || text || chr(10) AS text, true AS named FROM documents")
def read_markdown_dir(t):
    """One file for each document; rows that share an id are in one."""
    path = scratch_path(t, "markdown")
    named = t.documents.select(F.concat(F.lit("# "), "text").alias("text"), F.col("doc_id").cast("string").alias("doc"))
    joined = F.array_join(F.collect_list(F.coalesce("text", F.lit(""))), "\n")
    _write_files(named.groupBy("doc").agg(joined.alias("text")).select(F.concat_ws("-", F.lit("doc"), "doc").alias("name"), "text"), path)
    return readers.read_markdown_dir(t.spark, path, "*.txt").select("text", F.col("file").endswith(".txt").alias("named"))


@query("scan_columns", "SELECT doc_id, lang, source FROM documents")
def scan_columns(t):
    return readers.scan_columns(t.documents, ["doc_id", "lang", "source"])


@query("append_papers", """
    SELECT doc_id, lang, count(*) AS n FROM (
      SELECT doc_id, lang FROM documents UNION ALL SELECT doc_id, lang FROM documents SEMI JOIN labels USING (doc_id))
    GROUP BY ALL""")
def append_papers(t):
    path = scratch_path(t, "papers")
    store.append_papers(t.documents.select("doc_id", "lang"), path)
    store.append_papers(t.documents.join(t.labels, "doc_id", "left_semi").select("doc_id", "lang"), path)
    return t.spark.read.parquet(path).groupBy("doc_id", "lang").agg(F.count("*").alias("n"))


@query("insert_if_absent", """
    SELECT doc_id, 'stored' AS origin, text FROM documents SEMI JOIN labels USING (doc_id)
    UNION ALL SELECT doc_id, 'new', text FROM documents ANTI JOIN labels USING (doc_id)""")
def insert_if_absent(t):
    stored = t.documents.join(t.labels, "doc_id", "left_semi").select("doc_id", F.lit("stored").alias("origin"), "text")
    docs = t.documents.select("doc_id", F.lit("new").alias("origin"), "text", F.lit(0).alias("turn"))
    again = t.documents.select("doc_id", F.lit("repeat").alias("origin"), "text", F.lit(1).alias("turn"))
    return store.insert_if_absent(docs.unionByName(again), stored, "doc_id", ["turn"])


@query("update_by_key", f"""
    SELECT doc_id, lang, CASE WHEN quality IS NULL THEN source ELSE 'q' || quality END AS source, n_chars FROM {LABELLED}""")
def update_by_key(t):
    updates = t.labels.select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("source"))
    papers = t.documents.select("doc_id", "lang", "source", "n_chars")
    return store.update_by_key(papers, updates, "doc_id", ["source"])


@query("delete_where", f"SELECT doc_id, quality FROM {LABELLED} WHERE NOT coalesce(quality = 0, false)")
def delete_where(t):
    return store.delete_where(_labelled(t).select("doc_id", "quality"), F.col("quality") == 0)


# The same changes on a table by buckets; the last column counts the buckets that a change of one key writes anew.

@query("bucket_insert", """
    SELECT doc_id, 'stored' AS origin, text FROM documents SEMI JOIN labels USING (doc_id)
    UNION ALL SELECT doc_id, 'new', text FROM documents ANTI JOIN labels USING (doc_id)""")
def bucket_insert(t):
    stored = t.documents.join(t.labels, "doc_id", "left_semi").select("doc_id", F.lit("stored").alias("origin"), "text")
    docs = t.documents.select("doc_id", F.lit("new").alias("origin"), "text", F.lit(0).alias("turn"))
    again = t.documents.select("doc_id", F.lit("repeat").alias("origin"), "text", F.lit(1).alias("turn"))
    table = buckets.BucketTable.create(stored, scratch_path(t, "table"), "doc_id", 16)
    return table.insert_if_absent(docs.unionByName(again), ["turn"]).read()


@query("bucket_update", f"""
    SELECT doc_id, lang, CASE WHEN doc_id = (SELECT max(doc_id) FROM documents) THEN 'last' WHEN quality IS NULL THEN source ELSE 'q' || quality END AS source,
      n_chars, 1 AS n_rewritten FROM {LABELLED}""")
def bucket_update(t):
    updates = t.labels.select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("source"))
    table = buckets.BucketTable.create(t.documents.select("doc_id", "lang", "source", "n_chars"), scratch_path(t, "table"), "doc_id", 16)
    table = table.update(updates, ["source"])
    last = t.documents.agg(F.max("doc_id").alias("doc_id")).withColumn("source", F.lit("last"))
    after = table.update(last, ["source"])
    return after.read().withColumn("n_rewritten", F.lit(len(after.changed_since(table))))


@query("bucket_delete", f"SELECT doc_id, quality FROM {LABELLED} WHERE NOT coalesce(quality = 0, false)")
def bucket_delete(t):
    path = scratch_path(t, "table")
    buckets.BucketTable.create(_labelled(t).select("doc_id", "quality"), path, "doc_id", 16).delete(F.col("quality") == 0)
    return buckets.BucketTable.open(t.spark, path).read()


@query("write_scores_json", "SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def write_scores_json(t):
    path = scratch_path(t, "scores")
    sinks.write_scores_json(t.embeddings.groupBy("label").agg(F.count("*").alias("n")), path)
    return t.spark.read.schema("label int, n long").json(path)


@query("rows_to_json", f"""
    SELECT doc_id, CAST(to_json({{'doc_id': doc_id, 'lang': lang, 'text': text, 'quality': quality}}) AS VARCHAR) AS c
    FROM {LABELLED}""")
def rows_to_json(t):
    return _labelled(t).select("doc_id", sinks.rows_to_json(["doc_id", "lang", "text", "quality"]).alias("c"))


@query("vector_to_csv", """
    SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos,
      CAST(CAST(CAST(unnest(embedding) AS DOUBLE) AS DECIMAL(18,6)) * 1000000 AS BIGINT) AS millionths FROM embeddings""")
def vector_csv(t):
    back = csv_to_vector(vector_to_csv(F.col("embedding")))
    long = t.embeddings.select("vec_id", F.posexplode(back).alias("pos", "x"))
    return long.select("vec_id", "pos", F.round(F.col("x").cast("double") * 1e6).cast("long").alias("millionths"))


@query("create_papers_table", f"""
    SELECT doc_id AS id, 'd' || doc_id AS bibcode, text AS abstract, {len(schema.PAPERS.fields)} AS n_columns FROM documents
    WHERE doc_id % 2 = 1""")
def create_papers_table(t):
    """Created, filled, created again and filled with other rows: only the second filling is there."""
    name = f"paperloom_created_{uuid.uuid4().hex}"
    for rest in (0, 1):
        store.create_papers_table(t.spark, name, scratch_path(t, "created"))
        empty = t.spark.table(name)
        rows = t.documents.where(F.col("doc_id") % 2 == rest).select(F.col("doc_id").alias("id"), F.concat(F.lit("d"), "doc_id").alias("bibcode"), F.col("text").alias("abstract"))
        empty.unionByName(rows, allowMissingColumns=True).select(*[F.col(f.name).cast(f.dataType) for f in empty.schema]).write.mode("append").saveAsTable(name)
    table = t.spark.table(name)
    return table.select("id", "bibcode", "abstract", F.lit(len(table.columns)).alias("n_columns"))


# --- joins -------------------------------------------------------------------------------------

@query("exists_by_key", "SELECT doc_id, lang FROM documents SEMI JOIN labels USING (doc_id)")
def exists_by_key(t):
    return relations.exists_by_key(t.documents.select("doc_id", "lang"), t.labels, "doc_id")


@query("absent_by_key", "SELECT doc_id, lang FROM documents ANTI JOIN labels USING (doc_id)")
def absent_by_key(t):
    return relations.absent_by_key(t.documents.select("doc_id", "lang"), t.labels, "doc_id")


@query("lookup_ids", "SELECT doc_id AS id, lang, text, quality AS query_id, toxic AS rank FROM documents JOIN labels USING (doc_id)")
def lookup_ids(t):
    hits = t.labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("query_id"), F.col("toxic").alias("rank"))
    return relations.lookup_ids(hits, t.documents.select(F.col("doc_id").alias("id"), "lang", "text"))


@query("expand_references", """
    WITH cited AS (SELECT DISTINCT l_partkey AS bibcode FROM lineitem SEMI JOIN
      (SELECT o_orderkey AS l_orderkey FROM orders WHERE o_orderstatus = 'F') s USING (l_orderkey))
    SELECT p_partkey AS bibcode, p_name AS abstract, 'widget' AS categories FROM part
    WHERE p_partkey IN (SELECT bibcode FROM cited) AND p_size <= 40 AND p_type <> 'SMALL'""")
def expand_references(t):
    seeds = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("bibcode"))
    edges = t.lineitem.select(F.col("l_orderkey").alias("citing"), F.col("l_partkey").alias("cited"))
    abstract = F.when(F.col("p_size") <= 40, F.col("p_name"))
    papers = t.part.select(F.col("p_partkey").alias("bibcode"), abstract.alias("abstract"))
    stored = t.part.filter("p_type = 'SMALL'").select(F.col("p_partkey").alias("bibcode"))
    return relations.expand_references(seeds, edges, papers, stored, "widget")


@query("join_by_position", """
    WITH e AS (SELECT *, row_number() OVER (ORDER BY source, doc_id) - 1 AS id FROM documents)
    SELECT id, e.doc_id, lang, quality FROM e JOIN (SELECT doc_id AS id, quality FROM labels) USING (id)""")
def join_by_position(t):
    entries = windows.assign_dense_ids(t.documents.select("doc_id", "lang", "source"), ["source", "doc_id"])
    hits = t.labels.select(F.col("doc_id").alias("id"), "quality")
    return relations.join_by_position(hits, entries).select("id", "doc_id", "lang", "quality")


@query("token_embedding_lookup", """
    SELECT p_partkey, p_size AS token_id, array_to_string([round(CAST(x AS DOUBLE) * 1000000)::BIGINT FOR x IN embedding], ',') AS millionths
    FROM part JOIN embeddings ON p_size = vec_id""")
def token_embedding_lookup(t):
    tokens = t.part.select("p_partkey", F.col("p_size").cast("long").alias("token_id"))
    table = t.embeddings.select(F.col("vec_id").alias("token_id"), "embedding")
    millionths = F.transform("embedding", lambda x: F.round(x.cast("double") * 1000000).cast("long").cast("string"))
    return relations.token_embedding_lookup(tokens, table).select("p_partkey", "token_id", F.array_join(millionths, ",").alias("millionths"))


@query("lemma_lookup", f"""
    WITH l AS ({LEMMA_SQL}), tok AS (SELECT unnest({RAW_TOKENS_SQL}) AS token FROM documents)
    SELECT coalesce(lemma, token) AS lemma, count(*) AS n FROM tok LEFT JOIN l USING (token) GROUP BY ALL""")
def lemma_lookup(t):
    tokens = t.spread("documents").select(F.explode(text.raw_tokens(F.col("text"))).alias("token"))
    return relations.lemma_lookup(tokens, lemma_table(t)).groupBy("lemma").agg(F.count("*").alias("n"))


# --- orders, first rows, unions ----------------------------------------------------------------

@query("assign_dense_ids", "SELECT doc_id, source, row_number() OVER (ORDER BY source, doc_id) - 1 AS id FROM documents")
def assign_dense_ids(t):
    return windows.assign_dense_ids(t.documents.select("doc_id", "source"), ["source", "doc_id"])


@query("dedup_first", "SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text")
def dedup_first(t):
    return windows.dedup_first(t.documents, ["text"], ["doc_id"]).select("doc_id", "text")


@query("pack_token_blocks", f"""
    WITH tok AS (SELECT conv_id, turn, unnest({TOKENS_SQL}) AS tok, generate_subscripts({TOKENS_SQL}, 1) AS pos FROM conversations),
    p AS (SELECT tok, row_number() OVER (ORDER BY conv_id, turn, pos) - 1 AS p FROM tok)
    SELECT p // 128 AS block_id, string_agg(tok, ' ' ORDER BY p) AS c FROM p GROUP BY ALL HAVING count(*) = 128""")
def pack_token_blocks(t):
    rows = t.spread("conversations").select("conv_id", "turn", text.tfidf_tokens(F.col("text")).alias("tokens"))
    blocks = windows.pack_token_blocks(rows, ["conv_id", "turn"])
    return blocks.select("block_id", F.array_join("tokens", " ").alias("c"))


@query("topk_per_query", """
    SELECT query_id, id, round(dist, 4) AS dist, rank FROM (
      SELECT label AS query_id, vec_id AS id, CAST(embedding[1] AS DOUBLE) AS dist,
        row_number() OVER (PARTITION BY label ORDER BY round(CAST(embedding[1] AS DOUBLE), 6), vec_id) AS rank FROM embeddings)
    WHERE rank <= 10""")
def topk_per_query(t):
    scores = t.embeddings.select(
        F.col("label").alias("query_id"), F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("dist"))
    return windows.topk_per_query(scores, 10).withColumn("dist", F.round("dist", 4))


@query("search_sort", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 750")
def search_sort(t):
    return relations.search_sort(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey")


@query("newest_first", "SELECT o_orderkey, year(o_orderdate) AS year FROM orders")
def newest_first(t):
    return relations.newest_first(t.orders.select("o_orderkey", F.year("o_orderdate").alias("year")), key="o_orderkey")


@query("union_samples", """
    SELECT doc_id, source AS value FROM documents
    UNION ALL SELECT doc_id, text FROM documents WHERE length(text) > 100""")
def union_samples(t):
    return relations.union_samples(t.documents.select("doc_id", "text", F.col("source").alias("abstract"))).select("doc_id", "value")


@query("union_ingest", """
    WITH r AS (SELECT doc_id, text, CASE lang WHEN 'en' THEN 0 ELSE 1 END AS s FROM documents)
    SELECT doc_id, text, CASE s WHEN 0 THEN 'search' ELSE 'reference' END AS origin
    FROM r QUALIFY row_number() OVER (PARTITION BY text ORDER BY s, doc_id) = 1""")
def union_ingest(t):
    docs = t.documents.select("doc_id", "text", "lang")
    seed = docs.filter("lang = 'en'").select("doc_id", "text", F.lit("search").alias("origin"))
    refs = docs.select("doc_id", "text", F.lit("reference").alias("origin"))
    return relations.union_ingest(seed, refs, "text", ["doc_id"])
