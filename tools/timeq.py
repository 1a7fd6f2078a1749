"""Time registered queries through the noop sink: python tools/timeq.py sf_dir name [name ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from refrank.plans.queries import QUERIES  # noqa: E402
from refrank.session import local_session  # noqa: E402
from refrank.sources.testdata import TestTables  # noqa: E402

spark = local_session()
sf_dir, names = sys.argv[1], sys.argv[2:]
TestTables(spark, sf_dir).papers.limit(5).write.format("noop").mode("overwrite").save()
for name in names:
    t0 = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    print(f"{name:30s} {time.perf_counter() - t0:7.2f}s", flush=True)
