"""Compare all (or the named) queries with their SQL: ``python tests/check_oracles.py [--sf DIR] [name ...]``."""

from __future__ import annotations

import argparse
import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import SparkSession

from relops.session import get_spark
from relops.workload import ORACLES, QUERIES
from tests.oracle import connect, differences


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--plain", action="store_true", help="a session without this library's settings")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    if args.plain:
        spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").getOrCreate()
    else:
        spark = get_spark("check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    bad = 0
    for name in args.names or QUERIES:
        begun = time.time()
        try:
            got = QUERIES[name](spark, args.sf).toArrow()
            took = time.time() - begun
            if name not in ORACLES:
                verdict = f"rows only ({got.num_rows})"
            else:
                problems = differences(got, con.execute(ORACLES[name]).to_arrow_table())
                bad += bool(problems)
                verdict = f"ok ({got.num_rows} rows)" if not problems else "DIFFERS: " + "; ".join(problems)
        except Exception as error:
            bad += 1
            took = time.time() - begun
            verdict = "FAILED: " + "".join(traceback.format_exception_only(error)).strip()[:1500]
        print(f"{name}: {verdict} [{took:.1f}s]", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
