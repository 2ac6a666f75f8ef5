"""Compare registered queries with their checks: python -m workload SF_DIR [name ...]."""

import sys
import time

from fixtura.runtime import local_session
from workload.compare import differences
from workload.queries import CHECKS, QUERIES

sf_dir, *names = sys.argv[1:]
spark = local_session(8)
for name in names or QUERIES:
    start = time.time()
    try:
        df = QUERIES[name](spark, sf_dir)
        rows = df.toPandas()
        took = time.time() - start
        start = time.time()
        verdict = differences(rows, CHECKS.get(name), sf_dir)
        print(f"{'ok ' if verdict is None else 'BAD'} {name} rows={len(rows)} spark={took:.1f}s sql={time.time() - start:.1f}s {verdict or ''}", flush=True)
    except Exception as error:  # report and go on with the next query
        print(f"ERR {name} {type(error).__name__} {str(error)[:600]}", flush=True)
