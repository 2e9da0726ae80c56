"""Time the headline queries; prints one JSON line.

Each query first runs once, untimed, on the smallest tables beside the given ones,
so that compilation and the start of Python workers are not counted. The timed run
builds the plan, reads the tables and computes every row.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

NAMES = (
    "level_report windowed_peaks composite_level step_response delay concatenate sweep_summary "
    "biquad_cascade biquad_cascade_long zero_phase signal_pipeline avg_spectrum_long median_spectrum peak_spectrum spectrogram "
    "resample_sample_rate bass_managed_sum mono_mix routed_samples channel_operations "
    "interpolate_smooth octave_smoothing polynomial_smoothing "
    "pass_filter_sections set_response catalogue_responses reduced_shelves biquad_report_decimal "
    "catalogue_output_paths episode_runs collated_routes routing_violations window_levels"
).split()


def main() -> None:
    from pyspark.sql import functions as F

    from lowtide.operators import filters as O
    from lowtide.plans import QUERIES, tables
    from lowtide.session import local_session

    spark = local_session(CPUS, max(8, int(CPUS)) if CPUS.isdigit() else 8, "lowtide-bench")
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    small = os.path.join(os.path.dirname(SF_DIR.rstrip("/")), "sf0.001")
    warm = os.path.isdir(small)

    def run(name, build) -> None:
        if warm:
            build(small).write.format("noop").mode("overwrite").save()
        start = time.perf_counter()
        build(SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)

    # Start the JVM, code generation and Python workers outside the timings.
    spark.range(1000).mapInPandas(lambda it: it, "id long").agg(F.sum("id")).collect()

    run("store_samples", lambda d: tables.samples(spark, d))
    run("store_long_blocks", lambda d: tables.long_blocks(spark, d))
    for name in NAMES:
        run(name, lambda d: QUERIES[name](spark, d))
    run("bulk_responses_4096", lambda d: O.response(tables.filters(spark, d), 4096))
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_query_time", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
