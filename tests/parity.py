"""Spark vs DuckDB oracle parity: row count, column names and types, and the
order-insensitive multiset of rows (doubles compared after rounding to 6
places, which is far below the two-place metrics).

Usable from pytest and as a script: ``python tests/parity.py [sf_dir] [key ...]``.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLE_NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLE_NAMES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (1, "nan")
        return (1, round(v, 6))
    if hasattr(v, "as_tuple"):  # Decimal
        return (1, round(float(v), 6))
    if isinstance(v, bool):
        return (1, int(v))
    if isinstance(v, int):
        return (1, v)
    return (2, str(v))


def _rows(rows, cols, order):
    idx = [cols.index(c) for c in order]
    return sorted(tuple(_norm(r[i]) for i in idx) for r in rows)


def compare(spark, sf_dir: str, key: str, con=None) -> dict:
    import __spark_entry__ as entry

    con = con or duck(sf_dir)
    t0 = time.time()
    sdf = entry.queries()[key](spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    t_spark = time.time() - t0
    scols = sdf.columns
    stypes = {f.name: f.dataType.simpleString() for f in sdf.schema.fields}
    res = con.sql(entry.oracle_sql()[key])
    dcols = res.columns
    drows = res.fetchall()
    dtypes = dict(zip(dcols, [str(t) for t in res.types]))
    out = {
        "key": key,
        "spark_rows": len(srows),
        "oracle_rows": len(drows),
        "columns_match": sorted(scols) == sorted(dcols),
        "spark_sec": round(t_spark, 2),
    }
    if out["columns_match"]:
        order = sorted(scols)
        out["values_match"] = _rows(srows, scols, order) == _rows(drows, dcols, order)
        out["types"] = {c: (stypes[c], dtypes[c]) for c in order}
    else:
        out["values_match"] = False
        out["spark_cols"], out["oracle_cols"] = scols, dcols
    out["ok"] = out["columns_match"] and out["values_match"] and len(srows) == len(drows)
    return out


def main(argv: list[str]) -> int:
    from kartlens.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    import __spark_entry__ as entry

    keys = argv[1:] or list(entry.queries())
    spark = local_session(8)
    con = duck(sf_dir)
    bad = 0
    for key in keys:
        if key not in entry.oracle_sql():
            print(f"{key:40s} no oracle")
            continue
        try:
            r = compare(spark, sf_dir, key, con)
        except Exception as exc:  # report and continue
            bad += 1
            print(f"{key:40s} ERROR {type(exc).__name__}: {str(exc)[:300]}")
            continue
        bad += not r["ok"]
        flag = "ok " if r["ok"] else "BAD"
        print(f"{key:40s} {flag} rows {r['spark_rows']}/{r['oracle_rows']} cols={r['columns_match']} "
              f"vals={r['values_match']} {r['spark_sec']}s")
        if not r["columns_match"]:
            print("   spark ", r["spark_cols"], "\n   oracle", r["oracle_cols"])
        else:
            mism = {c: t for c, t in r["types"].items() if not _same_type(*t)}
            if mism:
                print("   types", mism)
    return bad


def _same_type(spark_t: str, duck_t: str) -> bool:
    pairs = {
        "bigint": "BIGINT",
        "int": "INTEGER",
        "double": "DOUBLE",
        "string": "VARCHAR",
    }
    return pairs.get(spark_t) == duck_t


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
