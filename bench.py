"""Times the headline queries; one JSON line. BENCH_SF_DIR and BENCH_CPUS choose tables and cores."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from rulewright.queries import QUERIES, scale_query

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = {n: QUERIES[n] for n in ("e_multi_rule_alerts", "e_matched_staged", "e_rule_counts", "m_regex", "m_contains_long", "m_cidr4", "m_fuzzy", "c_n_of_glob", "j_simple", "e_prefilter_sound")}
    queries |= {f"rules_{n}": scale_query(n) for n in (10, 50, 100, 500, 1000)}
    took: dict[str, float] = {}
    planned: dict[str, float] = {}
    for name, query in queries.items():
        times = []
        for _ in range(2):  # the first also compiles
            start = time.time()
            df = query(spark, SF_DIR)
            df._jdf.queryExecution().executedPlan()
            ready = time.time()
            df.write.format("noop").mode("overwrite").save()
            times.append((time.time() - start, ready - start))
        took[name], planned[name] = (round(x, 3) for x in min(times))
    events = spark.read.parquet(f"{SF_DIR}/events.parquet").count()
    rates = {f"{n}": round(events / took[f"rules_{n}"]) for n in (10, 100, 1000)}
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR).removeprefix("sf"), "events_per_second_by_rules": rates, "build_and_plan_seconds": planned, "cpus": int(CPUS)}))
    spark.stop()


if __name__ == "__main__":
    main()
