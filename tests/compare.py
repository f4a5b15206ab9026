"""Compare a query with its SQL as bags of rows, columns by name."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return int(v) if isinstance(v, int) and not isinstance(v, bool) else v


def differences(spark, folder: str, query, sql: str) -> str:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    rows = [dict(zip(names, r, strict=True)) for r in want.fetchall()]
    df = query(spark, folder)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    key = lambda r: tuple(_plain(r[c]) for c in sorted(names))
    got, exp = Counter(key(r.asDict()) for r in df.collect()), Counter(map(key, rows))
    if got == exp:
        return "" if exp else "no rows"
    return f"{sum(got.values())} and {sum(exp.values())} rows; only here {list((got - exp))[:2]}; only there {list((exp - got))[:2]}"
