"""Times the headline queries over whole tables.

First the logical tables are derived from the given ones and stored, as the write flows
store them (`prepare_tables` in the result, no part of the total). Then every query reads the stored
tables and writes to a sink that drops the rows. Prints one JSON line. BENCH_SF_DIR,
BENCH_CPUS, BENCH_RUNS and BENCH_QUERIES (comma separated) change data, cores, runs
per query (the best counts) and queries.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from dockledger.plans.versions import load_version, publish_version
from dockledger.sources.sample import sample_tables
from dockledger.tables import TABLE_NAMES
from dockledger.catalog.queries import ON_TABLES

HEADLINE = [
    "item_search", "item_by_code", "po_picker", "po_history", "po_line_status", "po_line_status_raw",
    "po_line_balance", "cumulative_provisional", "receipt_history", "receipt_history_search",
    "receipt_history_supplier", "receipt_detail", "receipt_detail_batch", "submit_lines", "delivery_sheet",
    "delivery_sheet_totals", "explode_requests", "register_receipts", "edit_receipt_lines", "delete_receipts",
]


def timed(spark: SparkSession, name: str, root: str, runs: int) -> float:
    """Best time of a query, from opening the tables to the last row."""
    times = []
    for _ in range(runs):
        start = time.perf_counter()
        ON_TABLES[name](load_version(spark, root)).write.format("noop").mode("overwrite").save()
        times.append(time.perf_counter() - start)
    print(name, [round(t, 2) for t in times], file=sys.stderr, flush=True)
    return round(min(times), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("dockledger-bench")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "12g")
        # The tables are small here; smaller files keep every core busy.
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    with tempfile.TemporaryDirectory(prefix="dockledger-bench-") as root:
        start = time.perf_counter()
        tables = sample_tables(spark, sf_dir)
        publish_version(spark, {name: tables[name] for name in TABLE_NAMES}, root)
        prepared = round(time.perf_counter() - start, 3)
        seconds |= {name: timed(spark, name, root, runs) for name in names}
    result = {
        "metric": "total_query_time",
        "value": round(sum(seconds.values()), 3),
        "prepare_tables": prepared,
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": cpus,
        "runs": runs,
    }
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
