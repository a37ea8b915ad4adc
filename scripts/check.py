"""Check registered queries: python scripts/check.py [sf dir] [name ...]"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from nascent.plans import catalog, checking
from nascent.session import build_session

sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
names = sys.argv[2:] or list(catalog.QUERIES)
spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="16g", spark__ui__showConsoleProgress="false")
spark.sparkContext.setLogLevel("ERROR")
con = checking.connect(sf_dir)
bad = 0
for name in names:
    start = time.time()
    try:
        df = catalog.QUERIES[name](spark, sf_dir)
        if name in catalog.CHECKS:
            found = checking.differences(df, con, catalog.CHECKS[name])
            note = "same" if not found else "DIFFERENT " + " | ".join(found)[:1500]
            bad += bool(found)
        else:
            note = f"rows only: {len(df.collect())}"
    except Exception as error:
        bad += 1
        note = f"FAILED {type(error).__name__} {str(error)[:1200]}"
    print(f"{name:28s} {time.time() - start:6.2f}s {note}", flush=True)
print("bad:", bad)
sys.exit(bad > 0)
