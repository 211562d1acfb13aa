"""Holds a query's rows against its DuckDB SQL over the same tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def assert_same(spark, name, query, sql, sf_dir):
    frame = query(spark, sf_dir)
    got = rows_of(frame.columns, [tuple(r.asDict(True)[c] for c in frame.columns) for r in frame.collect()])
    con = duck(sf_dir)
    out = con.execute(sql)
    names = [c[0] for c in out.description]
    want = rows_of(names, out.fetchall())
    assert sorted(frame.columns) == sorted(names), (name, sorted(frame.columns), sorted(names))
    assert len(got) == len(want), (name, len(got), len(want))
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    assert not bad, (name, len(bad), bad[:3])
