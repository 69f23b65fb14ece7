"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the folder of tables, ``BENCH_CPUS`` the number of cores. With
``BENCH_QUERIES`` (comma-separated names, or ``all``) other registered queries are timed.

A table of the folder is a single file with a single row group, which any number of cores reads
in one task. The tables are therefore first written again as a file per core, as tables lie on a
cluster; that is not timed. The fit that ``train_category``, ``predict_category`` and
``classify_model`` share is made, and timed, in the first of them.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "build_labeled",
    "map_to_category",
    "clean_text",
    "category_distribution",
    "value_counts",
    "describe_length",
    "top_words",
    "text_stats",
    "class_weights",
    "stratified_split",
    "prepare_summary",
    "word_ngrams",
    "char_ngrams",
    "tfidf_word",
    "tfidf_char",
    "linear_score",
    "train_category",
    "predict_category",
    "metrics_overall",
    "threshold_sweep",
    "lexicon_polarity",
    "urgency_signals",
    "analyze_sentiment",
    "priority_score",
    "classify_rules",
    "classify_model",
    "recent_tickets",
    "ticket_stats",
    "stream_classify",
)


def session(cores: str):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("triage-bench")
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "20g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def per_core(spark, sf_dir: str, out: str, cores: int) -> None:
    """The tables in files of about a core's share each."""
    for source in sorted(Path(sf_dir).glob("*.parquet")):
        spark.read.parquet(str(source)).repartition(cores).write.parquet(f"{out}/{source.name}")


def main() -> None:
    from queries.registry import REGISTRY

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    wanted = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE))
    names = list(REGISTRY) if wanted == "all" else wanted.split(",")

    split_dir = tempfile.mkdtemp(prefix="bench-")
    per_core(spark, sf_dir, split_dir, spark.sparkContext.defaultParallelism)
    spark.read.parquet(f"{split_dir}/documents.parquet").groupBy("lang").count().collect()
    seconds, errors = {}, {}
    for name in names:
        start = time.perf_counter()
        try:
            REGISTRY[name][0](spark, split_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
        except Exception as e:  # noqa: BLE001
            errors[name] = str(e)[:200]
        print(name, seconds.get(name, "failed"), file=sys.stderr, flush=True)
    result = {
        "metric": "total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": sf_dir.rstrip("/").split("sf")[-1],
    }
    if errors:
        result["errors"] = errors
    shutil.rmtree(split_dir, ignore_errors=True)
    print(json.dumps(result))


if __name__ == "__main__":
    main()
