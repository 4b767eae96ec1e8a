"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is forced in full with the no-op sink (nothing is collected).  A
warm-up pass runs the same queries once on a smaller fixture ($BENCH_WARM_DIR,
default sf0.01) so JVM start, JIT and code generation are not charged to the
first timed query; only the pass over $BENCH_SF_DIR is reported.  Run-to-run
noise on a shared 8-core machine is about +-15 %.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "infer_types_lineitem",   # profile + decide, 11 columns of lineitem as text
    "infer_types_orders",
    "infer_types_events",
    "infer_types_dirty",      # every cleaner branch on dirty text
    "convert_orders",         # infer + one narrow conversion select
    "chunk_types",            # per-chunk profile in the same single pass
    "override_errors",        # override checks + error samples
    "page_orders",            # row ids + range-filtered page
    "csv_roundtrip",          # write + all-string read + file-order row ids
]


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    scratch = tempfile.mkdtemp(prefix="colsense-bench-")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("colsense-bench")
             .config("spark.ui.enabled", "false")
             .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "12g"))
             .config("spark.sql.shuffle.partitions", str(max(8, int(cpus) * 2)))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.checkpoint.dir", os.path.join(scratch, "checkpoints"))
             .config("spark.sql.warehouse.dir", os.path.join(scratch, "warehouse"))
             # the cleaners generate large methods; let HotSpot compile them
             .config("spark.driver.extraJavaOptions", "-XX:-DontCompileHugeMethods")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")

    from colsense.plans.catalog import QUERIES

    def run(name: str, where: str) -> float:
        t = time.time()
        QUERIES[name](spark, where).write.format("noop").mode("overwrite").save()
        return round(time.time() - t, 3)

    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.01")
    if os.path.isdir(warm_dir):
        for name in HEADLINE:
            run(name, warm_dir)
    times = {name: run(name, sf_dir) for name in HEADLINE}
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
                      "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
