"""Headline queries, warm, on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, (os.path.dirname(os.path.abspath(__file__)), os.environ.get("PYTHONPATH", ""))))

from docscore.plans import catalog  # noqa: E402
from docscore.session import session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    spark = session("bench", **{"spark.master": f"local[{CPUS}]", "spark.driver.memory": "8g", "spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.log.level": "ERROR"})
    took: dict[str, float] = {}
    for name, query in catalog.queries().items():
        times = []
        for _ in range(3):
            start = time.perf_counter()
            query(spark, SF_DIR).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
            if times[0] > 20:
                break
        took[name] = round(statistics.median(times[1:] or times), 3)
    print(json.dumps({"metric": "total_warm_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
