"""CLI: python tests/run_oracle.py [sf_dir] [name ...] -> one line per query."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle import compare, duck  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from corpuskit.session import get_spark  # noqa: E402


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    spark = get_spark(8, 8)
    qs, sqls = entry.queries(), entry.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name in names or list(qs):
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            if name in sqls:
                res = compare(df, sqls[name], con)
            else:
                res = {"rows_only": df.count(), "ok": True}
        except Exception as e:  # report and continue
            res = {"ok": False, "error": f"{type(e).__name__}: {str(e)[:800]}"}
        res["sec"] = round(time.time() - t0, 2)
        bad += not res["ok"]
        print(name, json.dumps(res, ensure_ascii=False), flush=True)
    print("FAILED" if bad else "ALL OK", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
