"""python -m tests.check_queries [sf] [name ...]: compare registered queries with their SQL."""

import sys
import time

from pyspark.sql import SparkSession

import __spark_entry__ as entry
from tests.compare import differences, duck


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = 0
    for name, fn in entry.queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        sql = entry.oracle_sql().get(name)
        t = time.time()
        try:
            df = fn(spark, sf_dir)
            if sql is None:
                print(f"rows {name} {df.count()} {time.time() - t:.1f}s", flush=True)
                continue
            diff = differences(df, con, sql)
        except Exception as e:  # noqa: BLE001
            diff = [type(e).__name__ + ": " + str(e)[:1500]]
        bad += bool(diff)
        print(("FAIL" if diff else "ok  "), name, f"{time.time() - t:.1f}s", flush=True)
        for line in diff:
            print("     ", line[:1500])
    print("failed", bad)


main()
