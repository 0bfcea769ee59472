"""Run registered queries against their DuckDB oracle (the driver's correctness gate, locally).

usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import hashlib
import math
import sys
import time

import duckdb

sys.path.insert(0, __import__("os").path.dirname(__import__("os").path.dirname(__import__("os").path.abspath(__file__))))

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from costsieve.session import build_session  # noqa: E402
from costsieve.sources.tables import TABLES  # noqa: E402


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 9)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def frame_hash(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    keyed = sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)
    return hashlib.sha1("\n".join(keyed).encode()).hexdigest(), keyed


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = build_session("local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    qs, sqls = queries(), oracle_sql()
    bad = 0
    for name in names or sorted(qs):
        t = time.time()
        try:
            sdf = qs[name](spark, sf_dir)
            scols = sdf.columns
            srows = [tuple(r) for r in sdf.collect()]
        except Exception as exc:  # noqa: BLE001
            print(f"FAIL {name}: spark error {str(exc)[:400]}")
            bad += 1
            continue
        st = time.time() - t
        if name not in sqls:
            print(f"---- {name}: spark only, {len(srows)} rows ({st:.1f}s)")
            continue
        try:
            cur = con.execute(sqls[name])
            ocols = [d[0] for d in cur.description]
            orows = cur.fetchall()
        except Exception as exc:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(exc)[:400]}")
            bad += 1
            continue
        ok_cols = sorted(scols) == sorted(ocols)
        sh, sk = frame_hash(srows, scols)
        oh, ok = frame_hash(orows, ocols)
        if ok_cols and len(srows) == len(orows) and sh == oh:
            print(f"ok   {name}: {len(srows)} rows ({st:.1f}s)")
        else:
            bad += 1
            print(f"FAIL {name}: cols_ok={ok_cols} spark={len(srows)} oracle={len(orows)}")
            if not ok_cols:
                print("   spark cols", scols, "\n   oracle cols", ocols)
            else:
                a, b = set(sk), set(ok)
                for x in sorted(a - b)[:4]:
                    print("   spark only :", x[:300])
                for x in sorted(b - a)[:4]:
                    print("   oracle only:", x[:300])
    print(f"{bad} failing")
    spark.stop()


if __name__ == "__main__":
    main()
