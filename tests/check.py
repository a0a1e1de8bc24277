"""python tests/check.py [folder] [name | prefix* | !name ...]: run queries against their SQL."""

from __future__ import annotations

import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import __spark_entry__ as entry  # noqa: E402
from harness import compare, duck  # noqa: E402
from likeness.session import local_session  # noqa: E402


def main():
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    want = [a for a in sys.argv[2:] if not a.startswith("!")]
    skip = {a[1:] for a in sys.argv[2:] if a.startswith("!")}
    spark = local_session(8)
    con = duck(folder)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = []
    for name, fn in queries.items():
        if want and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in want):
            continue
        if name in skip:
            continue
        t = time.time()
        try:
            if name in sql:
                df = fn(spark, folder)
                t1 = time.time()
                problems = compare(df, con, sql[name])
                n = ""
            else:
                n = len(fn(spark, folder).collect())
                problems = [] if n else ["no rows"]
                n = f"rows={n} (no SQL)"
        except Exception as e:  # report and go on with the next query
            problems = [str(e)[:1500]]
            if "-v" in want:
                traceback.print_exc()
            n = ""
        print(f"{'ok ' if not problems else 'BAD'} {name:28s} {time.time() - t:6.1f}s {n} {problems or ''}", flush=True)
        if problems:
            bad.append(name)
    print("bad:", bad)


if __name__ == "__main__":
    main()
