"""Time the jobs on the derived catalog; prints one JSON line.

The catalog, requests and replies are first written as parquet with one file per
core, as a real catalog would lie there; that is not timed. Each job then runs
twice into the ``noop`` sink, which computes every row and column, and the
shorter run counts, so that code generation and JIT warm-up do not. ``building`` is
the part of it in which the plan is made and staged tables are written.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

import shelfwise
from checks import derived
from shelfwise.streaming.views import latest_viewed

RULES = shelfwise.InsightConfig(fallback_to_rules=True)


def session(cpus: int) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("shelfwise-bench")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(job: Callable[[], DataFrame]) -> tuple[float, float]:
    """Seconds of it all, and of those the ones of making the plan, with what it stages."""
    started = time.perf_counter()
    frame = job()
    planned = time.perf_counter()
    frame.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started, planned - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = session(cpus)
    with tempfile.TemporaryDirectory(prefix="shelfwise-bench-") as folder:
        inputs = {}
        for name in ("catalog", "requests", "replies", "many_paths_catalog"):
            frame = getattr(derived, name)(spark, sf_dir)
            frame.repartition(cpus).write.parquet(f"{folder}/{name}")
            inputs[name] = spark.read.parquet(f"{folder}/{name}")
        catalog, requests, replies = inputs["catalog"], inputs["requests"], inputs["replies"]
        many = inputs["many_paths_catalog"]
        few = requests.orderBy("request_id").limit(100)
        few.write.parquet(f"{folder}/few")
        few = spark.read.parquet(f"{folder}/few")
        staging = shelfwise.Staging(spark)
        shelfwise.pools(catalog, config=RULES).write.parquet(f"{folder}/pools")
        pools = spark.read.parquet(f"{folder}/pools")
        views = derived.views(derived.table(spark, sf_dir, "events"))

        jobs = {
            "indicators": lambda: shelfwise.analyse(catalog, config=RULES),
            "indicators_with_replies": lambda: shelfwise.analyse(catalog, replies, RULES),
            "explanations": lambda: shelfwise.explain(catalog, config=RULES),
            "summaries": lambda: shelfwise.summarise(catalog, config=RULES),
            "rule_pairings": lambda: shelfwise.pair(catalog, config=RULES),
            "rule_pairings_table": lambda: shelfwise.pair(
                catalog, config=RULES, rules=shelfwise.fixed_rules(spark)
            ),
            "reply_pairings": lambda: shelfwise.pair(catalog, replies, RULES),
            "prompts": lambda: shelfwise.prompts(catalog),
            "category_pools": lambda: shelfwise.pools(catalog, config=RULES),
            "alternatives": lambda: shelfwise.alternatives(catalog, config=RULES, staging=staging),
            "alternatives_stored_pools": lambda: shelfwise.alternatives(catalog, pools=pools, config=RULES),
            "resolve_requests": lambda: shelfwise.resolve_requests(requests, catalog),
            "requests_not_found": lambda: shelfwise.requests_not_found(requests, catalog),
            "report": lambda: shelfwise.report(catalog, replies=replies, config=RULES, staging=staging),
            "report_requested": lambda: shelfwise.report(
                catalog, requests, replies, config=RULES, staging=staging
            ),
            "report_100_requests": lambda: shelfwise.report(
                catalog, few, replies, config=RULES, staging=staging
            ),
            "category_pools_many_paths": lambda: shelfwise.pools(many, config=RULES),
            "alternatives_many_paths": lambda: shelfwise.alternatives(
                many, config=RULES, staging=staging
            ),
            "latest_viewed": lambda: latest_viewed(views),
        }
        shorter = {name: min(run(job), run(job)) for name, job in jobs.items()}
        seconds = {name: round(total, 3) for name, (total, _) in shorter.items()}
        building = {name: round(planned, 3) for name, (_, planned) in shorter.items()}
        staging.remove()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "building": building,
                "sf": Path(sf_dir).name,
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
