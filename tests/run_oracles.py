"""Run registered queries against their oracles: run_oracles.py SF_DIR [name-prefix ...]."""

import sys
import time

sys.path.insert(0, __file__.rsplit("/", 2)[0])
sys.path.insert(0, __file__.rsplit("/", 1)[0])
import __spark_entry__ as E
from compare import connect, differences

from buildlens.session import tuned_builder



def area_of(name):
    from importlib import import_module

    from buildlens.catalog import AREAS

    return [a for a in AREAS if name in import_module(f"buildlens.catalog.{a}").QUERIES]


if __name__ == "__main__":
    sf = sys.argv[1]
    spark = tuned_builder("local[8]").config("spark.sql.shuffle.partitions", "8").config(
        "spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    names = [n for n in E.queries() if not sys.argv[2:] or n in sys.argv[2:] or any(f":{a}" in sys.argv[2:] for a in area_of(n))]
    failed = 0
    for n in names:
        t = time.time()
        try:
            df = E.queries()[n](spark, sf)
            sql = E.oracle_sql().get(n)
            if sql is None:
                rows = len(df.collect())
                print(f"rows {n} {rows} {time.time() - t:.1f}s", flush=True)
                continue
            diff = differences(df, con, sql)
        except Exception as e:
            diff = [f"{type(e).__name__}: {str(e)[:700]}"]
        if diff:
            failed += 1
            print("BAD", n, f"{time.time() - t:.1f}s", *diff, sep="\n   ", flush=True)
        else:
            print(f"ok {n} {time.time() - t:.1f}s", flush=True)
    print("failed", failed)
