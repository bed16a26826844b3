"""Headline queries on one machine: prints one JSON line.

Each query runs once to warm the JVM and once measured; the result is written
to the ``noop`` sink, so the whole plan runs and nothing comes to the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "rules_scan",
    "secrets_scan",
    "ref_unknown_domains",
    "find_summary",
    "sarif_results",
    "sarif_documents",
    "fmt_resolve",
    "route_scanners",
    "poly_embedded",
    "zip_traversal",
    "zip_header_mismatch",
    "pkl_opcodes",
    "pkl_imports",
    "pkl_verdict",
    "pkl_call_summary",
    "gguf_tensor_count",
    "gguf_kv_dir",
    "gguf_cumulative",
    "wt_outliers",
    "wt_entropy",
    "wt_verdict",
    "meta_json_fields",
    "keras_config_nodes",
    "dep_typosquat",
    "cvss_distribution",
    "artifact_hash",
]


def main() -> None:
    from tamperlens.plans.catalog import QUERIES
    from tamperlens.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, partitions=int(cores) if cores.isdigit() else 8, memory="16g")
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        for _ in range(2):
            start = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline queries, warm, total",
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
