"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the data, BENCH_CPUS (default 8) the
cores, BENCH_QUERIES (comma separated) a choice of queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tarnish.catalog.registry import QUERIES  # noqa: E402
from tarnish.session import drop_staged, local_session  # noqa: E402

HEADLINE = [
    "paired_loss",
    "pairwise_contrasts",
    "verdict_families",
    "metric_band",
    "degrade_completeness",
    "degrade_validity",
    "degrade_precision",
    "degrade_coherence",
    "degrade_uniqueness",
    "composite_duplast",
    "severity_profile",
    "bootstrap_split",
    "hotdeck_impute",
    "auc",
    "f1_brier",
    "point632plus",
    "c_index",
    "ibs",
    "mixed_icc",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "tarnish-bench")
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("md5(cast(l_orderkey as string)) h").groupBy("h").count().count()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        drop_staged(spark)
        print(f"{name}: {times[name]}", file=sys.stderr)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
