"""python tests/run_compare.py <sf> [name-prefix ...]"""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import compare  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from perilframe.session import build_session  # noqa: E402

sf, prefixes = sys.argv[1], sys.argv[2:]
sf_dir = f"/root/testdata/sf{sf}"
spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                            "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
spark.sparkContext.setLogLevel("ERROR")
con = compare.connect(sf_dir)
oracles = entry.oracle_sql()
bad = []
for name, run in entry.queries().items():
    if prefixes and not any(name == p or (p.endswith("*") and name.startswith(p[:-1])) for p in prefixes):
        continue
    try:
        status, took, note = compare.check(spark, con, name, run, oracles.get(name), sf_dir)
    except Exception as e:  # noqa: BLE001
        status, took, note = "ERROR", 0.0, f"{type(e).__name__} {str(e)[:900]}"
    if status not in ("ok", "rows-only"):
        bad.append(name)
    print(f"{status:10s} {took:6.2f}s {name:28s} {note}", flush=True)
print("BAD:", bad)
