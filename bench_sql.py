"""Seconds of each grid query at $BENCH_SF_DIR, median of three warm runs, beside its SQL in DuckDB, as a Markdown table."""

import glob
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

import duckdb  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

from gridlake.plans import registry  # noqa: E402


def median(run) -> float:
    run()
    seconds = []
    for _ in range(3):
        began = time.time()
        run()
        seconds.append(time.time() - began)
    return statistics.median(seconds)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    db = duckdb.connect()
    db.execute(f"SET threads = {cpus}")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    print("| query | Spark s | DuckDB s |\n|-|-|-|")
    for name, query in registry.QUERIES.items():
        ours = median(lambda: query(spark, sf_dir).write.format("noop").mode("overwrite").save())  # noqa: B023
        theirs = f"{median(lambda: db.execute(registry.SQL[name]).fetchall()):.3f}" if name in registry.SQL else "-"  # noqa: B023
        print(f"| {name} | {ours:.3f} | {theirs} |", flush=True)


if __name__ == "__main__":
    main()
