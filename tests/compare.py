"""Holds a query's rows against its SQL in DuckDB: same columns, same multiset of rows."""

import math
from pathlib import Path

import duckdb


def duck(sf_dir: str):
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        source = f"{path}/*.parquet" if path.is_dir() else path
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{source}')")
    con.execute("SET TimeZone = 'UTC'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.10g}") + 0.0
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if type(v).__name__ == "Decimal":
        return float(f"{float(v):.10g}") + 0.0
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, query, sql, sf_dir, con=None):
    """None if all agrees, else what does not."""
    df = query(spark, sf_dir)
    got_cols, got = df.columns, [tuple(r) for r in df.collect()]
    cur = (con or duck(sf_dir)).execute(sql)
    want_cols, want = [d[0] for d in cur.description], cur.fetchall()
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} / {sorted(want_cols)}"
    if len(got) != len(want):
        return f"rows {len(got)} / {len(want)}"
    a, b = rows_of(got_cols, got), rows_of(want_cols, want)
    for x, y in zip(a, b, strict=True):
        if x != y or any(type(p) is not type(q) for p, q in zip(x, y, strict=True)):
            return f"{sorted(got_cols)}: {x} / {y}"
    return None
