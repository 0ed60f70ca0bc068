"""Times headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tessera.plans import registry

HEADLINE = [
    "hybrid_retrieval", "bm25_topk", "sparse_dot_topk", "dense_topk", "rrf_fusion", "ir_metrics_at_k", "sliding_window_chunks", "section_fold",
    "imrad_statistics", "imrad_repair", "graph_edges", "claim_edges", "evidence_trail", "nli_blend_verdict", "citation_concentration", "corpus_profile", "upsert_merge", "answer_engine",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    registry.QUERIES["corpus_profile"](spark, sf_dir).collect()  # the first query also starts the engine
    for name in HEADLINE:
        began = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
