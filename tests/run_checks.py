"""Run all registered queries against their SQL: ``python tests/run_checks.py SF_DIR [NAME ...]``."""

import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [HERE, os.path.dirname(HERE)]

from compare import difference, sql_rows  # noqa: E402

import __spark_entry__ as entry_points  # noqa: E402
from vectide.session import build_session  # noqa: E402


def main() -> int:
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = build_session("local[8]", shuffle_partitions=8, **{"spark.driver.memory": "12g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracle = entry_points.queries(), entry_points.oracle_sql()
    failed = 0
    for name in names or queries:
        begun = time.time()
        try:
            rows = queries[name](spark, sf_dir).toPandas()
            took = time.time() - begun
            outcome = "rows only" if name not in oracle else difference(rows, sql_rows(oracle[name], sf_dir)) or "equal"
        except Exception as failure:  # noqa: BLE001 - report and go on
            took, rows, outcome = time.time() - begun, (), f"{type(failure).__name__}: {str(failure)[:700]}"
        failed += outcome not in ("equal", "rows only")
        print(f"{name:26} {len(rows):8} rows {took:6.2f} s  sql+{time.time() - begun - took:5.2f}  {outcome}", flush=True)
    spark.stop()
    return failed


if __name__ == "__main__":
    sys.exit(main())
