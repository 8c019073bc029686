"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from pluvion.catalog import all_queries
from pluvion.session import local_session

HEADLINE = [
    "zonal_mean", "zonal_std", "weighted_median", "zonal_quantile", "ensemble_stats", "ytd_ratio", "annual_ratio_bands", "append_dedupe",
    "unpivot_wide", "zone_files", "cdi_cascade", "cdi_districts", "cpt_lookup", "soft_inference", "soft_inference_batch", "dbn_sequence",
    "storylines", "bayes_update", "district_evidence", "bilinear_regrid", "spatial_pip", "quantile_map", "model_forcing", "land_surface",
    "event_hydrographs", "upstream_area", "river_chains", "cycle_check", "wrsi_node", "precipitation_index",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    times = {}
    for name in wanted:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/"))}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
