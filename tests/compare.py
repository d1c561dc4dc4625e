"""A query's rows against those of its SQL, whatever their order."""

import os

import duckdb
import numpy as np


def rows_of(pdf):
    pdf = pdf[sorted(pdf.columns)]
    out = []
    for row in pdf.itertuples(index=False):
        cells = []
        for x in row:
            if x is None or (isinstance(x, float) and x != x) or str(x) in ("NaT", "<NA>"):
                cells.append("~")
            elif isinstance(x, (float, np.floating)):
                cells.append(str(int(x)) if float(x) == int(x) else repr(round(float(x), 6)))
            elif isinstance(x, (bool, np.bool_)):
                cells.append(str(bool(x)).lower())
            elif isinstance(x, (list, np.ndarray)):
                cells.append(str([str(y) for y in x]))
            else:
                cells.append(str(x))
        out.append("|".join(cells))
    return sorted(out)


def duck(folder):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in os.listdir(folder):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{folder}/{name}')")
    return con


def check(spark, folder, query, sql):
    got = query(spark, folder).toPandas()
    want = duck(folder).sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
