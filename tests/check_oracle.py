"""Compares bound queries with their SQL: ``python tests/check_oracle.py <sf_dir> [name ...]``."""

import os
import sys
import time
import traceback

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from fleetlens.plans.queries import QUERIES  # noqa: E402
from fleetlens.session import build_session  # noqa: E402
from oracle import compare, connect  # noqa: E402

sf_dir = sys.argv[1]
names = [n for n in QUERIES if not sys.argv[2:] or any(a in n for a in sys.argv[2:])]
spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
spark.sparkContext.setLogLevel("ERROR")
con = connect(sf_dir)
bad = 0
for name in names:
    begin = time.time()
    try:
        problems = compare(spark, con, name, sf_dir)
    except Exception as e:  # report and go on with the next query
        if os.environ.get("TRACE"):
            traceback.print_exc()
        problems = [f"{type(e).__name__}: {str(e)[:600]}"]
    bad += bool(problems)
    print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - begin:.2f}s", *problems, sep="\n     " if problems else " ")
print(f"{len(names) - bad} of {len(names)} agree")
sys.exit(bool(bad))
