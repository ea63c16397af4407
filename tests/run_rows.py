"""Run registered queries without an oracle and report rows / seconds.

CLI: python tests/run_rows.py [sf_dir] [query ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from gradewise.session import build_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    qs = queries()
    names = argv[1:] or [n for n in qs if n not in oracle_sql()]
    spark = build_session()
    bad = 0
    for n in names:
        t = time.time()
        try:
            df = qs[n](spark, sf_dir)
            rows = df.collect()
            print(f"OK  {n}: rows={len(rows)} cols={df.columns} {time.time() - t:.1f}s", flush=True)
            if rows:
                print("     first:", str(rows[0])[:300], flush=True)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"BAD {n}: {type(e).__name__}: {str(e)[:600]}", flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
