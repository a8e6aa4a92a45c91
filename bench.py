"""Times the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from tonemark.plans.session import local_session, ship_package
from tonemark.queries import all_checks

HEADLINE = [
    "flagship",
    "TXT1",
    "TXT4",
    "TXT6",
    "ACC3",
    "ACC4",
    "ACC8",
    "ACC9",
    "LAT2",
    "LAT4",
    "LAT5",
    "STAT1",
    "STAT1_large",
    "STAT3",
    "TQ_all",
    "TQ7_chars",
    "INT1",
    "INT4",
    "SET2",
    "SET5",
    "SET7",
    "SEG1",
    "SEG5",
    "GATE2",
    "GATE4",
    "CMP1",
    "REC5",
    "SNK5",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus)
    ship_package()
    checks = all_checks()
    spark.read.parquet(f"{folder}/documents.parquet").count()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        checks[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline_total_seconds",
                "value": total,
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
