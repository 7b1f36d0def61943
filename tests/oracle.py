"""Compare a Spark result with DuckDB SQL on the same tables, as the driver does."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(frame):
    frame = frame[sorted(frame.columns)]
    out = []
    for r in frame.astype(object).values.tolist():
        row = []
        for x in r:
            if pd.isna(x):
                row.append("null")
            elif isinstance(x, bool):
                row.append(str(x))
            elif isinstance(x, (int, float)):
                row.append(f"{float(x):.9g}")
            else:
                row.append(str(x))
        out.append(tuple(row))
    return sorted(out), list(frame.columns)


def expect_same(df, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    want, names = normal(con.execute(sql).df())
    got, own = normal(df.toPandas())
    assert own == names
    assert len(got) == len(want), (len(got), len(want))
    assert got == want, next((a, b) for a, b in zip(got, want) if a != b)
