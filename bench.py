"""Time the headline queries; print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set input and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from broadsheet.plans.queries import CATALOGUE  # noqa: E402
from broadsheet.session import build_session  # noqa: E402

HEADLINES = [
    "feed_items_roundtrip",
    "article_text",
    "articles_normalized",
    "language_profiles",
    "detect_language",
    "topic_by_prototype",
    "topic_by_tokens",
    "find_feeds",
    "markup_tokens",
    "tag_census",
    "close_events",
    "pointer_join",
    "flatten_docs",
    "patch_apply_objects",
    "patch_apply_full",
    "snapshot_diff",
    "snapshot_diff_moves",
    "diff_moves_roundtrip",
    "markup_stream_tokens",
    "segment_tokens",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    spark = build_session("bench", os.environ.get("BENCH_CPUS", "8"))
    seconds: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINES:
        start = time.perf_counter()
        # Every row and column is computed; nothing is stored.
        CATALOGUE[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(sf_dir).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": float(scale)}))
    spark.stop()


if __name__ == "__main__":
    main()
