"""Compare a query with its SQL in DuckDB: names, rows and values, whatever the order."""

from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def in_duckdb(sql: str, sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(sql)
    return [c[0] for c in cur.description], cur.fetchall()


def same(df, sql: str, sf_dir: str) -> None:
    names, rows = in_duckdb(sql, sf_dir)
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    got = Counter(tuple(r[c] for c in order) for r in df.collect())
    want = Counter(tuple(r[names.index(c)] for c in order) for r in rows)
    assert got == want
