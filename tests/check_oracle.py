"""Run registered queries against their DuckDB oracles (like the driver does).

    python -m tests.check_oracle [sf_dir] [name ...]
"""

from __future__ import annotations

import sys
import time

from riskspark.session import local_session
from tests.oracle import compare, duck

import __spark_entry__ as entry_mod


def main(argv: list[str]) -> int:
    sf = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(entry_mod.queries())
    spark = local_session(cores=8)
    con = duck(sf)
    qs, sqls = entry_mod.queries(), entry_mod.oracle_sql()
    bad = 0
    for name in names:
        t = time.time()
        try:
            df = qs[name](spark, sf)
            if name in sqls:
                m = compare(df, sqls[name], con)
                status = "OK " if m.ok else "BAD"
                bad += 0 if m.ok else 1
                print(f"{status} {name:28s} rows={m.rows} {m.detail} maxdiff={m.max_abs_diff:.3g} "
                      f"{time.time() - t:.1f}s", flush=True)
            else:
                n = df.count()
                print(f"ROW {name:28s} rows={n} {time.time() - t:.1f}s", flush=True)
        except Exception as exc:  # report and go on
            bad += 1
            print(f"ERR {name:28s} {type(exc).__name__}: {str(exc)[:600]}", flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
