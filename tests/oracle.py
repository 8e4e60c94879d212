"""Runs a query in Spark and its SQL in DuckDB and compares the rows."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    def value(x):
        # a long column with nulls comes as floats from one side and as whole numbers from the other
        if x is None or x is pd.NA or isinstance(x, float) and x != x:
            return None
        return int(x) if isinstance(x, float) and x.is_integer() else float(x) if isinstance(x, float) else x

    columns = sorted(frame.columns)
    return columns, sorted(repr(tuple(map(value, r))) for r in frame[columns].astype(object).itertuples(index=False, name=None))


def same(spark, query, sql, sf_dir="/root/testdata/sf0.001"):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    ours, theirs = rows(query(spark, sf_dir).toPandas()), rows(con.sql(sql).df())
    assert ours == theirs
    return len(ours[1])
