"""Run registered queries and their check SQL side by side.

``python tests/compare.py [name-prefix ...]`` prints every difference.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(root: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{root}/{t}.parquet')")
    return con


def _key(row):
    return tuple((v is not None, "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)) for v in row)


def _same(a, b):
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, float) or isinstance(b, float):
        return math.isclose(float(a), float(b), rel_tol=1e-12, abs_tol=1e-12)
    return a == b


def differences(df, con, sql, limit=3):
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=_key)
    rel = con.sql(sql)
    if sorted(rel.columns) != cols:
        return [f"columns {cols} != {sorted(rel.columns)}"], len(got)
    want = sorted(con.sql(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall(), key=_key)
    if len(got) != len(want):
        return [f"rows {len(got)} != {len(want)}"], len(got)
    out = []
    for g, w in zip(got, want):
        bad = [(c, a, b) for c, a, b in zip(cols, g, w) if not _same(a, b)]
        if bad:
            out.append(f"{dict(zip(cols, g))} : {bad}")
            if len(out) >= limit:
                break
    return out, len(got)


def main(prefixes):
    from __spark_entry__ import oracle_sql, queries
    from bazaarlens.session import get_session

    root = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = get_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                                                  "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(root)
    qs, sqls = queries(), oracle_sql()
    failed = []
    for name, fn in qs.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t0 = time.time()
        try:
            if name in sqls:
                diffs, n = differences(fn(spark, root), con, sqls[name])
            else:
                diffs, n = [], fn(spark, root).count()
        except Exception as exc:  # report and go on
            diffs, n = [f"{type(exc).__name__}: {str(exc)[:700]}"], -1
        mark = "ok  " if not diffs else "FAIL"
        print(f"{mark} {name} rows={n} {time.time() - t0:.1f}s {'' if name in sqls else '(no sql)'}", flush=True)
        for d in diffs:
            print("     ", d[:900], flush=True)
        if diffs:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
