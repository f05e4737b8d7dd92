"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from phenoframe.registry import QUERIES  # noqa: E402
from phenoframe.session import local_session  # noqa: E402

HEADLINE = [
    "decadal_median_composite",
    "composite_dense",
    "phenology_curve",
    "phenology_interpolated",
    "chunk_merge",
    "valid_step_mask",
    "gapfill_hold",
    "gapfill_hold_in_row",
    "resample_linear",
    "irregular_to_grid",
    "label_remap_fixed",
    "label_remap_dense",
    "cell_sample_join",
    "monthly_fallback",
    "multimodal_align",
    "class_rank",
    "paper_split",
    "ratio_split",
    "quota_sample",
    "oversample_balanced",
    "scaler_fit_channel",
    "scaler_fit_step_channel",
    "scaler_apply_channel",
    "median_impute",
    "class_weights",
    "missing_summary",
    "histogram",
    "pearson_matrix",
    "spearman_matrix",
    "confusion_matrix",
    "evaluation_summary",
    "losses",
    "batch_scoring",
    "terrain",
    "tabular_preparation",
    "scene_preparation",
]


def timed(spark, fn, sf_dir: str) -> float:
    """Seconds to build and run a query; results are computed in full and not kept."""
    began = time.perf_counter()
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "phenoframe-bench")
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        timed(spark, QUERIES[name], sf_dir)
        runs = [timed(spark, QUERIES[name], sf_dir) for _ in range(repeats)]
        seconds[name] = round(statistics.median(runs), 3)
    print(
        json.dumps(
            {
                "metric": "sum of median query seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
