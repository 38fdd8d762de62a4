"""Sources, sinks and the papers table on small tables."""

import json
from pathlib import Path

import pytest

from pyspark.sql import functions as F

from paperloom import schema, staging
from paperloom.operators import relations, windows
from paperloom.plans import corpus, ingest
from paperloom.queries import QUERIES
from paperloom.sources import readers, sinks, store
from paperloom.staging import shared_dir


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


DUMP = [
    {"id": "1", "title": "A\n    title", "abstract": " x  y ", "journal-ref": "X,2007", "categories": "cs.LG hep-th",
     "versions": [{"version": "v1", "created": "Mon, 2 Apr 2007 19:18:42 GMT"}], "submitter": "s"},
    {"id": "2", "title": "B", "abstract": "b", "journal-ref": None, "categories": "cs.NA math.NA",
     "versions": [{"version": "v1", "created": "Mon, 2 Apr 2012 19:18:42 GMT"}]},
    {"id": "3", "title": "C", "abstract": "c", "journal-ref": None, "categories": "hep-th", "versions": []},
    {"id": "1", "title": "again", "abstract": "z", "journal-ref": "X,1999", "categories": "cs.LG",
     "versions": [{"version": "v1", "created": "Mon, 2 Apr 2007 19:18:42 GMT"}]},
]


def write_dump(path, records=DUMP):
    path.mkdir(exist_ok=True)
    (path / "a.json").write_text("".join(json.dumps(r) + "\n" for r in records))
    return str(path)


def test_ingest_jsonl_twice(spark, tmp_path):
    dump, target = write_dump(tmp_path / "dump"), str(tmp_path / "papers")
    spark.createDataFrame([], schema.PAPERS).write.parquet(target)
    for _ in range(2):
        ingest.ingest_jsonl(spark, dump, target)
    stored = spark.read.parquet(target)
    assert rows(stored.select("bibcode", "title", "abstract", "year", "categories"), "bibcode") == [
        ("1", "A   title", "x y", 2007, "Machine Learning,"),
        ("2", "B", "b", 2012, "Numerical Analysis,Numerical Analysis,"),
    ]


def test_bad_json_fails(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"id": "1"\n')
    with pytest.raises(Exception):
        readers.read_papers_jsonl(spark, str(tmp_path)).collect()


def test_stream_ingest_is_idempotent(spark, tmp_path):
    from paperloom.streaming.ingest import stream_ingest

    dump, target = write_dump(tmp_path / "dump"), str(tmp_path / "papers")
    spark.createDataFrame([], schema.PAPERS).write.parquet(target)
    stream_ingest(spark, dump, target, str(tmp_path / "c1")).awaitTermination()
    (tmp_path / "dump" / "b.json").write_text(json.dumps({**DUMP[1], "id": "9"}) + "\n")
    stream_ingest(spark, dump, target, str(tmp_path / "c1")).awaitTermination()
    stream_ingest(spark, dump, target, str(tmp_path / "c2")).awaitTermination()
    assert rows(spark.read.parquet(target).select("bibcode", "title"), "bibcode") == [("1", "A   title"), ("2", "B"), ("9", "B")]


def test_markdown_folder(spark, tmp_path):
    for name in ("b-1.md", "a-1.md", "skip.txt"):
        (tmp_path / name).write_text(f"# {name}\nline")
    got = [tuple(r) for r in readers.read_markdown_dir(spark, str(tmp_path)).collect()]
    assert got == [("a-1.md", "# a-1.md\nline"), ("b-1.md", "# b-1.md\nline")]


def test_jdbc_urls():
    assert readers.jdbc_url("sqlite", "p.db") == "jdbc:sqlite:p.db"
    assert readers.jdbc_url("postgresql", "p", "host", "5432") == "jdbc:postgresql://host:5432/p"


def test_create_and_append(spark, tmp_path):
    assert store.create_papers_table(spark, "papers_test", str(tmp_path / "t")) == 0
    assert spark.table("papers_test").schema.names == schema.PAPERS.names
    path = str(tmp_path / "p")
    for _ in range(2):
        store.append_papers(spark.range(2), path)
    assert spark.read.parquet(path).count() == 4


def test_insert_if_absent(spark):
    stored = spark.createDataFrame([("a", "old")], "k string, v string")
    new = spark.createDataFrame([("a", "x", 0), ("b", "second", 2), ("b", "first", 1)], "k string, v string, o int")
    once = store.insert_if_absent(new, stored, "k", ["o"])
    assert rows(once, "k") == [("a", "old"), ("b", "first")]
    assert rows(store.insert_if_absent(new, once, "k", ["o"]), "k") == rows(once, "k")


def test_update_and_delete(spark):
    df = spark.createDataFrame([("a", 1, None), ("b", 2, "y")], "k string, n int, s string")
    updates = spark.createDataFrame([("a", "one", 1), ("a", "two", 2), ("z", "no", 1)], "k string, s string, o int")
    assert rows(store.update_by_key(df, updates, "k", ["s"], ["o"]), "k") == [("a", 1, "two"), ("b", 2, "y")]
    cleared = spark.createDataFrame([("b", None)], "k string, s string")
    assert rows(store.update_by_key(df, cleared, "k", ["s"]), "k") == [("a", 1, None), ("b", 2, None)]
    assert rows(store.delete_where(df, F.col("s") == "y"), "k") == [("a", 1, None)]


def test_text_corpus_keeps_one_line_per_sample(spark, tmp_path):
    df = spark.createDataFrame([(" a\r\nb ",), ("c",)], "value string")
    sinks.write_text_corpus(df, str(tmp_path / "o"))
    assert sorted(r.value for r in readers.read_text_lines(spark, str(tmp_path / "o")).collect()) == ["a b", "c"]


def test_dense_ids(spark):
    df = spark.range(0, 5000, 3).select((F.col("id") * 7919 % 10007).alias("k")).repartition(13)
    got = rows(windows.assign_dense_ids(df, ["k"]).select("id", "k"), "id")
    keys = sorted(r.k for r in df.collect())
    assert got == list(enumerate(keys))


def test_token_blocks(spark):
    docs = [[f"t{d}_{i}" for i in range((d * 37) % 300)] for d in range(60)]
    df = spark.createDataFrame(list(enumerate(docs)), "d int, tokens array<string>").repartition(7)
    got = rows(windows.pack_token_blocks(df, ["d"], block_size=64), "block_id")
    flat = [t for doc in docs for t in doc]
    want = [(b, flat[b * 64:(b + 1) * 64]) for b in range(len(flat) // 64)]
    assert [(b, list(t)) for b, t in got] == want


def test_expand_references(spark):
    papers = spark.createDataFrame(
        [("s1", "seed"), ("r1", "ref"), ("r2", None), ("r3", "stored"), ("far", "two hops")], "bibcode string, abstract string")
    edges = spark.createDataFrame(
        [("s1", "r1"), ("s2", "r1"), ("s1", "r2"), ("s1", "r3"), ("r1", "far")], "citing string, cited string")
    seeds = spark.createDataFrame([("s1",), ("s2",)], "bibcode string")
    stored = spark.createDataFrame([("r3",), ("s1",), ("s2",)], "bibcode string")
    assert rows(relations.expand_references(seeds, edges, papers, stored, "q"), "bibcode") == [("r1", "ref", "q")]


def test_ingest_search(spark):
    def responses(*items):
        return spark.createDataFrame(
            [(b, [t, "alt"], a, "ApJ", "2016", ["k"], 1.0, 3) for b, t, a in items], schema.SEARCH_RESULT)

    hits = responses(("s1", "T", "An Exoplanet"), ("s2", "T", "other"), ("s3", "T", None), ("old", "T", "exoplanet"))
    cited = responses(("r1", "R", "no match needed"), ("r2", "R", None), ("s1", "T", "An Exoplanet"))
    edges = spark.createDataFrame(
        [("s1", "r1"), ("s1", "r2"), ("s1", "s1"), ("s2", "r1"), ("old", "r1")], "citing string, cited string")
    stored = spark.createDataFrame([("old",)], "bibcode string")
    found = ingest.ingest_search(hits, edges, cited, stored, "exoplanet")
    assert rows(found.select("bibcode", "title", "year", "categories"), "bibcode") == [
        ("r1", "R", 2016, "exoplanet"), ("s1", "T", 2016, "exoplanet")]
    loose = ingest.ingest_search(hits, edges, cited, stored, "exoplanet", loose=True)
    assert [r[0] for r in rows(loose.select("bibcode"), "bibcode")] == ["r1", "s1", "s2"]


def test_curate_corpus(spark):
    long = "A long enough abstract about planets and their atmospheres, seen in transit with a small telescope at night."
    papers = [
        ("keep", "Title", long, "ABSTRACT head ABSTRACT tail"), ("short", "Title", "too short", None),
        ("blank", "", long, None), ("off", "A galaxy", long, None), ("body", "Title", "x", long.replace("planets", "ﬁt~5")),
        ("nospace", "Title", "x" * 200, None), ("offbody", "Title", long, "about quasars: quasar"),
    ]
    df = spark.createDataFrame(papers, "bibcode string, title string, abstract string, text string")
    got = rows(corpus.curate_corpus(df).select("bibcode", "value"), "bibcode")
    assert got == [("body", long.replace("planets", "fitabout 5")), ("keep", long)]


def test_curate_to_files(spark, tmp_path):
    long = "A long enough abstract about planets and their atmospheres, seen in transit with a small telescope at night."
    papers = [("keep", "Title", long, None), ("blank", "", long, None), ("off", "A galaxy", long, None), ("blank off", None, "galaxy", None)]
    df = spark.createDataFrame(papers, "bibcode string, title string, abstract string, text string")
    counts = corpus.curate_to_files(df, str(tmp_path / "lines"), str(tmp_path / "papers"))
    assert counts == {"read": 4, "deleted": 1, "kept": 1}
    assert [r.value for r in spark.read.text(str(tmp_path / "lines")).collect()] == [long]
    assert {r.bibcode for r in spark.read.parquet(str(tmp_path / "papers")).collect()} == {"keep", "blank", "blank off"}


def test_rows_without_a_key_are_not_inserted(spark):
    new = spark.createDataFrame([(None, 1), ("a", 2), ("a", 3), ("b", 4)], "k string, v int")
    stored = spark.createDataFrame([("b", 0)], "k string, v int")
    assert [tuple(r) for r in store.absent_rows(new, stored, "k", ["v"]).collect()] == [("a", 2)]


def test_extract_bodies(spark):
    papers = [
        ("a", "Science", "T", "abs", ""), ("b", "Science", "T", "abs", "done"), ("c", "Nature", "T", "abs", None),
        ("d", "Science", "pulsation", "abs", None), ("e", "The Astrophysical Journal", "T", "abs", None), ("f", "Science", "T", "abs", None),
    ]
    df = spark.createDataFrame(papers, "bibcode string, pub string, title string, abstract string, text string")
    body = "h\n\n1\n\nmain- body [1]\nline References"
    texts = spark.createDataFrame([(k, body) for k in "abcde"], "bibcode string, body string")
    got = dict(rows(corpus.extract_bodies(df, texts).select("bibcode", "text"), "bibcode"))
    assert got == {"a": "mainbody line ", "b": "done", "c": None, "d": None,
                   "e": "h 1 mainbody [1] line References", "f": None}


def test_staging_reads_the_named_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir", "")
    assert staging.shared_dir(spark) == named.rstrip("/") if named else staging.shared_dir(spark)
    first = staging.stage(spark.range(3))
    second = staging.restage(first.selectExpr("id + 1 as id"), first)
    assert sorted(r.id for r in second.collect()) == [1, 2, 3]
    with pytest.raises(Exception):
        first.collect()


def test_a_staged_table_counts_with_its_rows(spark):
    """Rows that compress to little are not sent to every task."""
    from paperloom.operators.relations import lookup_ids
    from paperloom.staging import stage

    papers = spark.range(10).withColumn("title", F.lit("t"))
    planned = lambda hits: lookup_ids(hits, papers)._jdf.queryExecution().optimizedPlan().toString()
    hits = lambda n: stage(spark.range(n).select(F.lit(1).cast("long").alias("query_id"), F.lit(2).cast("long").alias("id"), F.lit(0.5).alias("dist")), "hits")
    assert "strategy=broadcast" in planned(hits(1000))
    assert "strategy=broadcast" not in planned(hits(2_000_000))
    assert lookup_ids(hits(1000), papers).count() == 1000


def test_markdown_files_lie_in_one_folder(spark, tmp_path):
    """A file for each document and no folder for each: rows that share an id are in one file, a null text is an empty line."""
    rows = [(1, "a\nb"), (2, "c"), (2, "d"), (3, None), (None, "e"), (4, "\x85é\r\n")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    known = set(Path(shared_dir(spark)).glob("paperloom/markdown-*"))
    got = [tuple(r) for r in QUERIES["read_markdown_dir"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted([(x, True) for x in ("# a\nb\n", "\n", "# e\n", "# \x85é\r\n\n")] + [r for r in got if r[0] in ("# c\n# d\n", "# d\n# c\n")], key=str)
    assert len(got) == 5
    folder, = set(Path(shared_dir(spark)).glob("paperloom/markdown-*")) - known
    assert len(list(folder.iterdir())) == 5 and all(f.is_file() for f in folder.iterdir())
