"""Comparing a Spark result with DuckDB's."""

import glob
import os


def duck(folder: str):
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows(frame, columns):
    return sorted(tuple(str(v) for v in r) for r in frame[columns].itertuples(index=False))


def assert_same(spark_frame, sql: str, folder: str) -> None:
    ours, theirs = spark_frame.toPandas(), duck(folder).execute(sql).df()
    names = sorted(ours.columns)
    assert names == sorted(theirs.columns)
    assert rows(ours, names) == rows(theirs, names)
