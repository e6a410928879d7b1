"""Time the headline queries and print one JSON line.

BENCH_SF_DIR   folder of the test tables (default /root/testdata/sf0.1)
BENCH_CPUS     cores of the local session (default 8)
BENCH_QUERIES  "all", or names separated by commas, instead of the headline list
BENCH_COLD     "1" also reports the first, cold run of each query
"""

from __future__ import annotations

import json
import os
import sys
import time

from tunedata import plans
from tunedata.plans.registry import QUERIES
from tunedata.session import build_session

HEADLINE = [
    "norm_sft", "norm_pref", "conv_flatten", "flt_length", "blend_interleave", "blend_sweep", "idx_dense",
    "shard_assign", "zip_cyclic", "bal_interleave", "kto_mismatch", "pad_batch", "tok_assemble", "tok_positions",
    "w_softmax", "w_batch_loss", "w_step1", "w_run", "pool_mean", "score_activate", "lp_seq_ce", "kl_reward",
    "masked_norm", "obj_policy", "dpo", "kto_even", "kd_ce", "ev_number", "mc_fewshot", "mc_extract", "mc_rollup",
    "ev_normalise", "mod_multilabel", "guard_fnr", "rank_scores", "dist_kde", "dist_hist", "rw_best_of_n", "mon_ema",
    "mon_running_mean", "st_ema", "st_group_window", "udf_generate",
]


def run_once(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    plans.load_all()
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]", spark_sql_shuffle_partitions=cpus, spark_ui_enabled="false",
        spark_driver_memory="12g", spark_ui_showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    cold, warm = {}, {}
    for name in names:
        try:
            cold[name] = round(run_once(spark, name, sf_dir), 3)
            warm[name] = round(run_once(spark, name, sf_dir), 3)
            print(f"{name} {cold[name]} {warm[name]}", file=sys.stderr, flush=True)
        except Exception as problem:  # noqa: BLE001 - one failing query must not hide the others
            print(f"{name} failed: {str(problem)[:300]}", file=sys.stderr, flush=True)
    spark.stop()
    out = {
        "metric": "headline_queries_warm_total", "value": round(sum(warm.values()), 3), "unit": "sec",
        "queries": warm, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "failed": [n for n in names if n not in warm],
    }
    if os.environ.get("BENCH_COLD") == "1":
        out["cold"] = cold
    print(json.dumps(out))


if __name__ == "__main__":
    main()
