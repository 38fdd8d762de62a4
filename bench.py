"""Time the headline queries on one parquet folder and print one JSON line.

BENCH_SF_DIR names the folder, BENCH_CPUS the local cores; names as arguments restrict the queries.
"""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from paperloom.queries import QUERIES

HEADLINE = [
    "clean_text", "normalize_tokens", "tfidf_tokens", "chunk_words", "html_to_text", "contains_any", "repair_bytes",
    "curate_corpus", "ingest_jsonl", "insert_if_absent", "dedup_first", "assign_dense_ids", "pack_token_blocks",
    "term_vocabulary", "tfidf", "similar_documents", "ngram_counts", "bigram_collocations", "expand_references",
    "knn_exact", "knn_approx", "knn_graph", "pairwise_cosine", "silhouette", "category_cosine_matrix", "fit_pca",
    "encode_text", "sample_next",
]
#: Whole jobs of many Spark jobs each, timed on their only run.
JOBS = ["semantic_search", "build_index", "recommend", "stream_search", "evaluate_embeddings", "bpe_train", "bpe_encode"]


def run(spark: SparkSession, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/documents.parquet").selectExpr("sum(n_chars)").collect()
    seconds, first = {}, {}
    for name in sys.argv[1:] or HEADLINE + JOBS:
        first[name] = run(spark, name, folder)  # class loading and compilation
        seconds[name] = first[name] if name in JOBS else run(spark, name, folder)
        print(f"{name} first {first[name]} then {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "first_run_total": round(sum(first.values()), 3), "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
