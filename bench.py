"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from siteledger.plans import bridges as B  # noqa: E402
from siteledger.plans.registry import QUERIES  # noqa: E402
from siteledger.session import local_session  # noqa: E402

HEADLINE = [
    "extract_page", "extract_links", "canonical_json", "module_status", "merkle_root", "site_summary",
    "site_trust_summary", "metrics_summary", "max_concurrency", "expand_sitemap_index", "fmt_duration",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "siteledger-bench")
    # The derived input tables are written before the clock starts.
    for table in (B.modules_again, B.site_index, B.recaptures, B.audit_pages_again, B.sitemaps, B.request_log):
        table(spark, sf_dir).count()
    counts = {
        "pages": B.table(spark, sf_dir, "pages").count(),
        "modules": B.modules(spark, sf_dir).count(),
    }
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    rates = {
        "extract_page_pages_per_sec": round(counts["pages"] / seconds["extract_page"], 1),
        "site_summary_modules_per_sec": round(counts["modules"] / seconds["site_summary"], 1),
        "merkle_root_modules_per_sec": round(counts["modules"] / seconds["merkle_root"], 1),
    }
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
                "rates": rates,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
