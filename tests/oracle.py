"""Compares a query with its SQL in DuckDB on the same tables."""

import os

import duckdb

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "asDict"):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(plain(v) for v in value.values())
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return float(value) if type(value).__name__ == "Decimal" else value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def compare(spark, query, sql, folder=FOLDER):
    db = duckdb.connect()
    db.sql("SET TimeZone='UTC'")
    for name in TABLES:
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    found = db.sql(sql)
    want = rows_of(found.columns, found.fetchall())
    df = query(spark, folder)
    got = rows_of(df.columns, df.collect())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1]), (len(got[1]), len(want[1]))
    differing = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    assert not differing, (len(differing), differing[:3])
    return len(got[1])
