"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""

from __future__ import annotations

import json
import os
import time

from terrane import plans
from terrane.session import build

HEADLINE = [
    "B1_area_weighted",
    "A14_weighted_quantile",
    "B3_class_mixture",
    "W1_percent_rank",
    "D2_dispersion",
    "J1_inner_join",
    "J16_validity_join",
    "J17_floor_lookup",
    "W8_gaps_and_islands",
    "H1_harmonics",
    "L1_zscore_lens",
    "L11_context_percentiles",
    "T15_crosswalk_steps",
    "M2_morans_i",
    "G2_upstream_closure",
    "J11_point_in_polygon",
]


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": cpus}
    spark = build(f"local[{cpus}]", "bench", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    tables = plans.Tables(spark, folder)
    tables.customer.groupBy("c_nationkey").count().collect()  # start the session
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        plans.QUERIES[name](tables).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total wall time of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
