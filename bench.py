"""Times the headline queries; prints one JSON line."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = ["speaker_summary", "keyword_tf", "lexicon_hits", "word_speaker_overlap", "merge_speaker", "graph_summary", "neighbors", "components_all", "sentences", "identify_top3"]


def main() -> None:
    from pyspark.sql import SparkSession

    from colloq import catalogue

    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    taken = {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):  # the first warms up
            t = time.time()
            catalogue.queries()[name](spark, d).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - t)
        taken[name] = round(min(runs[1:]), 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(taken.values()), 3), "unit": "sec", "queries": taken, "sf": d.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
