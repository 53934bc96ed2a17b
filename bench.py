"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the local cores.
Each query runs once to warm up on the smallest table folder beside it, if there, then once timed.
"""

import importlib.util
import json
import os
import time

from pyspark.sql import SparkSession

from tracelake import catalog
from tracelake.session import configure

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ["rule_multi_scan", "sigma_boolean_condition", "v_timeline", "timeline_flagged", "interval_join_first", "anti_join_hidden", "expected_parent", "burst_hours", "cluster_two_level_score", "techniques", "compare_cases", "topk_per_rule", "ioc_address_extract", "ioc_multi_feed_score", "dedup_key_sha1", "first_writer_wins", "upsert_coalesce", "manifest_diff", "sigma_keyword_corpus", "sigma_aggregations", "sigma_near", "cidr_longest_match", "yara_documents"]


def main() -> None:
    spark = configure(SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries = {n: catalog.QUERIES[n] for n in HEADLINE}
    if importlib.util.find_spec("tracelake.llm"):
        from tracelake.llm.queries import QUERIES

        queries |= QUERIES
    warm = os.path.join(os.path.dirname(SF_DIR.rstrip("/")), "sf0.001")
    took = {}
    for name, query in queries.items():
        if os.path.isdir(warm):
            query(spark, warm).write.format("noop").mode("overwrite").save()
        began = time.time()
        query(spark, SF_DIR).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total query seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
