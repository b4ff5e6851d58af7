"""Compare a registered query with its DuckDB oracle (tests and tools):
row count, column names and an order-insensitive hash of the values."""

from __future__ import annotations

import decimal
import hashlib
import os

DRIVER_TABLES = ("region nation customer supplier part orders lineitem events documents "
                 "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in DRIVER_TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    """Exact text of a value: floats by ``repr`` (every bit), decimals with
    their scale, NULL as a marker."""
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, decimal.Decimal):
        return str(v)
    return str(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha1("\n".join(lines).encode()).hexdigest(), lines


_SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
                  "date": "DATE", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}


def type_mismatches(df, description) -> list:
    """Columns whose Spark type and DuckDB type differ."""
    spark_t = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    out = []
    for name, dtype, *_ in description:
        st = spark_t.get(name)
        if st is None:
            continue
        want = _SPARK_TO_DUCK.get(st, st.upper())
        if str(dtype).upper() != want:
            out.append((name, st, str(dtype)))
    return out


def compare(spark, con, name: str, fn, sql: str, sf_dir: str) -> dict:
    df = fn(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(sql)
    types = type_mismatches(df, res.description)
    ocols = [c[0] for c in res.description]
    orows = res.fetchall()
    h1, l1 = digest(df.columns, rows)
    h2, l2 = digest(ocols, orows)
    return {
        "name": name, "rows": len(rows), "oracle_rows": len(orows),
        "same_columns": sorted(df.columns) == sorted(ocols), "same_values": h1 == h2,
        "spark_only": sorted(set(l1) - set(l2))[:3], "oracle_only": sorted(set(l2) - set(l1))[:3],
        "columns": (sorted(df.columns), sorted(ocols)),
        "type_mismatches": types,
    }
