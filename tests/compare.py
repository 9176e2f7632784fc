"""Holds a query's rows against its SQL on another engine."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)].astype(object)
    one = lambda v: "null" if v is None or v is pd.NaT or v is pd.NA or v != v else f"{float(v):.6f}" if isinstance(v, int | float) and not isinstance(v, bool) else str(v)
    return sorted(tuple(map(one, row)) for row in frame.itertuples(index=False))


def oracle(sql: str, sf_dir: str) -> pd.DataFrame:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con.execute(sql).df()


def same(frame, sql: str, sf_dir: str) -> None:
    got, want = frame.toPandas(), oracle(sql, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
