"""Times the headline reports and prints one JSON line.

BENCH_SF_DIR names the table folder (default sf0.1), BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import time

from logsieve.reports import REPORTS
from logsieve.session import local_session

HEADLINE = [
    "lines_to_top_techniques",
    "parse_plain",
    "parse_jsonl",
    "parse_rejects_by_file",
    "features_text",
    "feature_scaler",
    "baseline_model",
    "baseline_scores",
    "score_stats",
    "technique_counts_top20",
    "technique_ranked",
    "anomaly_table",
    "recent_anomaly_list",
    "metric_series",
    "event_rate_5m",
    "score_by_class",
    "roc_auc",
    "f1_sweep",
    "category_recall",
    "labelled_mix",
    "iforest_scores",
    "stream_ingest",
    "stream_rate",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores)
    spark.read.parquet(f"{folder}/events.parquet").count()
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        REPORTS[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    total = round(sum(seconds.values()), 3)
    result = {
        "metric": "access-log reports, total time",
        "value": total,
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "cores": cores,
        "spark": spark.version,
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
