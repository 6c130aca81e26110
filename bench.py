"""Time headline queries: one JSON line on standard output.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores. Every query is written to
a sink that discards rows, so all columns of all rows are computed.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks import QUERIES  # noqa: E402
from threadlens.settings import configure  # noqa: E402

HEADLINES = [
    "s1_ticket_scan",
    "j1_ticket_threads",
    "a6_transcript",
    "f4_redact",
    "a13_daily_conversations",
    "a15_deflection",
    "a17_dashboard",
    "s6_latest_snapshot",
    "u1_enrich",
    "b1_lexicon_sentiment",
    "b2_term_themes",
    "b3_answer_overlap",
    "b4_best_article",
    "b5_top_sentence",
    "b7_entity_redaction",
    "analyse_offline",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    names = sys.argv[1:] or HEADLINES
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("threadlens-bench")
    builder = builder.config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
    builder = builder.config("spark.ui.enabled", "false")
    builder = builder.config("spark.ui.showConsoleProgress", "false")
    spark = configure(builder, cpus).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    try:
        for name in names:
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    finally:
        spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
