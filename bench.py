"""Headline queries, timed: one JSON line. BENCH_SF_DIR and BENCH_CPUS set the data and the cores.

`queries` are timed with the derivation of pixels from the given tables, a sort of each supplier's rows by ten columns; `stored` are the same queries over
pixels that were written before, as frames usually are.
"""

import json
import os
import time

from pyspark.sql import SparkSession

from framelake.operators.lineage import discard, kept
from framelake.plans import catalogue
from framelake.sources import views

HEADLINE = ["merge_debevec", "tm_reinhard02", "tm_reinhard05", "hist_quantiles", "wb_color_balance", "resize_bilinear", "contrast_equalize", "repair_normalize", "exposure_metadata", "frame_stats"]


def timed(spark, sf_dir: str) -> dict[str, float]:
    times = {}
    for name in HEADLINE:
        began = time.time()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    return times


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalogue.QUERIES[HEADLINE[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    times, written = timed(spark, sf_dir), []
    pixels = kept(views.px(spark, sf_dir), written)
    rows, views.px = pixels.count(), lambda *_: pixels
    stored = timed(spark, sf_dir)
    discard(spark, written)
    spark.stop()
    total = lambda found: round(sum(found.values()), 3)
    print(json.dumps({"metric": "headline queries", "value": total(times), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "stored": stored, "stored_value": total(stored), "pixels": rows}))


if __name__ == "__main__":
    main()
