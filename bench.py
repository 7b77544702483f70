"""Time the headline queries; prints one JSON line.

The change sets are made once from ``documents`` and written to a new folder
of the warehouse, so each query is timed from its own parquet scan to the last
row.  Every query runs once to warm up and then ``BENCH_RUNS`` times; the best
run counts.  Plan building is part of the time.
"""

import json
import os
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from patchloom import (
    analyze_diffs,
    diff_statistics,
    parse_files,
    parse_hunks,
    parse_lines,
    render_diffs,
    summarize_diffs,
)
from workload.corpus import diffs as corpus

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))

QUERIES = {
    "statistics": diff_statistics,
    "files": parse_files,
    "hunks": parse_hunks,
    "diff_lines": parse_lines,
    "file_analysis": analyze_diffs,
    "overview": lambda d: summarize_diffs(d, with_files=False),
    "summaries": summarize_diffs,
    "render_plain": lambda d: render_diffs(d, "plain"),
    "render_markdown": lambda d: render_diffs(d, "markdown"),
    "render_json": lambda d: render_diffs(d, "json"),
}


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/bench-{uuid.uuid4().hex}"
    started = time.time()
    corpus(spark, SF_DIR).repartition(int(CPUS) * 2).write.parquet(folder)
    made = time.time() - started
    diffs = spark.read.parquet(folder)
    size = diffs.agg(F.count("*").alias("n"), F.sum(F.length("diff_text")).alias("chars")).first()

    seconds = {}
    for name, query in QUERIES.items():
        times = []
        for _ in range(RUNS + 1):
            started = time.time()
            query(diffs).write.format("noop").mode("overwrite").save()
            times.append(time.time() - started)
        seconds[name] = round(min(times[1:] or times), 3)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
                "diffs": size.n,
                "characters": size.chars,
                "corpus_sec": round(made, 3),
                "diffs_per_sec": {k: round(size.n / v) for k, v in seconds.items()},
            }
        )
    )


if __name__ == "__main__":
    main()
