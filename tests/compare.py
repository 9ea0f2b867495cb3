"""Rows of a Spark query against the rows of its SQL in DuckDB."""

from pathlib import Path

import duckdb


def cells(row):
    return tuple("~" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for v in row)


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, sorted(cells(r) for r in df.select(*columns).collect())


def duck_rows(sql, folder):
    con = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    got = con.execute(f"SELECT * FROM ({sql}) AS q")
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(cells([r[i] for i in order]) for r in got.fetchall())
