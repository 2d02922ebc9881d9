"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the number of local cores, BENCH_QUERIES (comma-separated) picks queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

from streamatlas.plans.all_queries import QUERIES
from streamatlas.session import local_session

HEADLINE = (
    "canonical_url_p1", "stable_id_p2_c18", "merge_key_p3_c4", "route_p6", "url_join_c6", "percent_codec_c5_c4", "credential_scrub_p22", "strip_tags_c13",
    "title_category_c2", "location_suffix_p20_p21", "url_vetting_p17", "keyed_merge_a1", "snapshot_k2", "playlist_k1_l1", "distinct_first_a2",
    "shared_verdict_j2", "listing_priority_j3", "resolve_asof_j8_c16", "capped_hosts_a7", "diagnose_sources_a10", "guard_cycles_w4_w5", "health_payload_k3",
    "shedding_episodes_t5", "outcome_windows_t6", "extract_ladder_e1_e2_e3_e4", "page_meta_e5", "resolve_x1_x11_j6", "check_candidates_j2_p13",
    "serving_view_j11_p14_m3", "manifest_lines_w1_c24", "manifest_rewrite_m2", "live_edge_w2", "live_edge_text_w3", "reachable_g1", "page_plan_s15_l4",
    "probe_batch_t3", "source_feratel_e7", "source_skyline_j3_g1", "source_tomarigi_s10", "guard_stream_t1",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES")
    names = wanted.split(",") if wanted else list(HEADLINE)
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8, app="bench")
    spark.read.parquet(f"{sf_dir}/region.parquet").count()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{times[name]:8.3f}s {name}", file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline queries, total seconds", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
