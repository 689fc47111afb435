"""Compares a query with its SQL in DuckDB, both over the same small tables."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(cols, data):
    at = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(str([round(r[i], 6) if isinstance(r[i], float) else r[i] for i in at]) for r in data)


def sql_rows(sql, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/{sf}/{t}.parquet')")
    cur = con.execute(sql)
    return rows([d[0] for d in cur.description], cur.fetchall())


def spark_rows(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])
