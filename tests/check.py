"""Compare every registered query with its SQL: python tests/check.py [sf_dir] [name ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as entry  # noqa: E402
from oracle import both, connect  # noqa: E402
from tableflow.session import build_session  # noqa: E402

sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
names = sys.argv[2:] or list(entry.queries())
spark = build_session("check", 8, spark__sql__warehouse__dir="/tmp/tableflow-warehouse")
spark.sparkContext.setLogLevel("ERROR")
con = connect(sf_dir)
bad = 0
for name in names:
    start = time.time()
    sql = entry.oracle_sql().get(name)
    try:
        if sql is None:
            print(f"{name:28} rows only {entry.queries()[name](spark, sf_dir).count()}")
            continue
        (ours_cols, ours), (sql_cols, theirs) = both(spark, con, entry.queries()[name], sql, sf_dir)
    except Exception as error:
        bad += 1
        print(f"{name:28} ERROR {str(error)[:900]}", flush=True)
        continue
    good = ours_cols == sql_cols and ours == theirs
    bad += not good
    print(f"{name:28} {'ok' if good else 'DIFF'} {len(ours)} rows {time.time() - start:.2f}s", flush=True)
    if not good:
        print("   columns", ours_cols, sql_cols)
        print("   ours only  ", sorted(set(ours) - set(theirs))[:3], len(ours))
        print("   theirs only", sorted(set(theirs) - set(ours))[:3], len(theirs))
print("bad:", bad)
