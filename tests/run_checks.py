"""Compare queries with their twins from the command line: run_checks.py SF_DIR [NAME_PREFIX ...]."""

import sys
import time
import traceback

sys.path.insert(0, str(__import__("pathlib").Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(__import__("pathlib").Path(__file__).resolve().parent))

from oracle import connect, difference, spark_rows  # noqa: E402
from session import make_session  # noqa: E402

from __spark_entry__ import oracle_sql, queries  # noqa: E402

if __name__ == "__main__":
    sf, prefixes = sys.argv[1], tuple(sys.argv[2:])
    spark, con = make_session(), connect(sf)
    bad = 0
    for name, query in queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        begin = time.time()
        try:
            sql = oracle_sql().get(name)
            if sql is None:
                result = f"rows only: {len(spark_rows(query(spark, sf))[1])}"
            else:
                result = difference(query(spark, sf), con, sql)
        except Exception as error:  # noqa: BLE001
            result = f"ERROR {type(error).__name__}: {str(error)[:1500]}"
            if "-v" in sys.argv:
                traceback.print_exc()
        flag = "ok  " if result is None or result.startswith("rows only") else "FAIL"
        bad += flag == "FAIL"
        print(f"{flag} {name} {time.time() - begin:.1f}s {result or ''}", flush=True)
    print("failures:", bad)
