"""Run a registered query in Spark and its oracle in DuckDB; compare results.

Comparison: row count, column names, column types (engine-neutral family),
and the multiset of rows (floats compared exactly and with a 1e-9 tolerance).
"""

from __future__ import annotations

import math
import time

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _family(t: str) -> str:
    t = t.lower()
    for k, v in (("hugeint", "hugeint"), ("bigint", "long"), ("long", "long"),
                 ("smallint", "short"), ("tinyint", "byte"), ("int", "int"),
                 ("double", "double"), ("float", "double"), ("decimal", "decimal"),
                 ("varchar", "string"), ("string", "string"), ("bool", "bool"),
                 ("timestamp", "ts"), ("date", "date")):
        if k in t:
            return v
    return t


def _norm(v, approx: bool):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 9) if approx else v
    if hasattr(v, "item"):
        return v.item()
    return v


def compare(spark, sf_dir: str, name: str, fn, sql: str | None, con=None) -> dict:
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = sdf.columns
    stypes = [_family(f.dataType.simpleString()) for f in sdf.schema.fields]
    t1 = time.time()
    out = {"query": name, "spark_rows": len(srows), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        out["status"] = "rows-only"
        return out
    con = con or duck(sf_dir)
    res = con.execute(sql)
    drows = res.fetchall()
    dcols = [d[0] for d in res.description]
    dtypes = [_family(str(d[1])) for d in res.description]
    out["oracle_rows"] = len(drows)
    if sorted(scols) != sorted(dcols):
        out["status"] = f"COLUMNS differ: spark={scols} oracle={dcols}"
        return out
    order = [dcols.index(c) for c in scols]
    dtypes = [dtypes[i] for i in order]
    drows = [tuple(r[i] for i in order) for r in drows]
    type_diff = [(c, a, b) for c, a, b in zip(scols, stypes, dtypes) if a != b]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    exact = sorted([tuple(_norm(x, False) for x in r) for r in srows], key=key) == \
        sorted([tuple(_norm(x, False) for x in r) for r in drows], key=key)
    approx = sorted([tuple(_norm(x, True) for x in r) for r in srows], key=key) == \
        sorted([tuple(_norm(x, True) for x in r) for r in drows], key=key)
    out["types"] = "ok" if not type_diff else f"TYPES {type_diff}"
    out["status"] = "exact" if exact else ("approx" if approx else "MISMATCH")
    return out
