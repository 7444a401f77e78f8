"""Times the headline queries and prints one JSON line.

Staged tables are built in their own timed steps (``build_*``), so the queries
that read them do not hide that work. Every query is run to the end with the
``noop`` sink: all rows and columns are computed, nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sprintgauge.plans import base, catalogue, evaluation, modelling, retrieval  # noqa: E402
from sprintgauge.session import build_session  # noqa: E402

BUILDS = {
    "build_curated": base.curated,
    "build_folds": evaluation.folds,
    "build_splits": evaluation.intra,
    "build_terms": evaluation.bags,
    "build_tfidf": evaluation.tfidf,
    "build_neighbours": evaluation.intra_neighbours,
    "build_predictions": evaluation.oof,
    "build_retrieved": retrieval.retrieved,
    "build_vocabulary": retrieval.words,
    "build_encoded": retrieval.encoded,
    "build_vectors": modelling.vectors,
}
HEADLINES = [
    "dataset_stats", "scan_requirements", "dedup_first", "filter_language", "filter_iqr",
    "uniform_cap", "limit_per_dataset", "curate_view", "clean_ascii", "html_to_text",
    "strip_tags", "detect_language", "sentence_count", "word_count", "tokenize",
    "kfold_assign", "holdout_split", "inter_roles_rows", "term_df", "top_terms",
    "tfidf_weights", "predict_knn", "predict_des", "metrics_by_model", "fold_summary",
    "inter_summary", "scale_target", "knn_join", "prompt_few_shot", "truncate_prompt",
    "parse_answer", "mlm_mask", "perplexity", "fit_ridge", "fit_lasso", "fit_tree",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "bench", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        # The tables are a few MB: let every core have a share of them.
        "spark.sql.files.openCostInBytes": "131072",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "65536"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    queries = catalogue.queries()
    times: dict[str, float] = {}
    for name, build in BUILDS.items():
        start = time.perf_counter()
        build(spark, sf_dir)
        times[name] = round(time.perf_counter() - start, 3)
    for name in HEADLINES:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "total wall time of headline queries", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
