"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) say on what; each query is run once to warm up
and then timed, written to the no-op sink so that every row is made.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "a01_cached_bars", "c11_veto_cascade", "d01_asof", "d01_asof_by_symbol", "d10_overlap_weights", "d19_peer_alignment", "e05_cube_cells", "e06_inference_table", "e20_percentiles", "e25_rank_ic",
    "e36_transitions", "e43_trailing_count", "f12_adx", "f16_supertrend", "f24_cci", "f45_consensus", "f46_triples", "f85_reversion_features", "i26_option_price", "j02_bracket_trades", "j10_bootstrap", "j13_sweep", "j13_random_sweep", "j15_triple_barrier", "k01_cosine_library",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from tapewright.plans import QUERIES

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    shared = tempfile.mkdtemp(prefix="spark-bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    taken: dict[str, float] = {}
    for name in HEADLINE:
        for _ in range(2):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken[name] = round(time.perf_counter() - began, 3)
    from tapewright.plans.simulation_queries import RANDOM, signals

    backtests = RANDOM * signals(spark, sf_dir).select("symbol").distinct().count()  # series under parameters, with a trade or not
    print(json.dumps({"metric": "headline queries, warm, total", "value": round(sum(taken.values()), 3), "unit": "sec", "queries": taken, "sf": Path(sf_dir).name.removeprefix("sf"), "backtests_per_sec": round(backtests / taken["j13_random_sweep"], 1)}))


if __name__ == "__main__":
    main()
