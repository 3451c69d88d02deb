"""Runs queries side by side with DuckDB, as the driver does."""

import duckdb

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    fix = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(fix(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, sf_dir, query, sql, deciding=None):
    """Rows in all; the deciding column, if one is named, has to take more than one value."""
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for n in NAMES:
        con.sql(f"create view {n} as select * from '{sf_dir}/{n}.parquet'")
    got = query(spark, sf_dir)
    want = con.sql(sql)
    assert sorted(got.columns) == sorted(want.columns), (sorted(got.columns), sorted(want.columns))
    g, w = canon([tuple(r) for r in got.collect()], got.columns), canon(want.fetchall(), want.columns)
    assert len(g) == len(w), (len(g), len(w))
    bad = [(a, b) for a, b in zip(g, w, strict=True) if a != b]
    assert not bad, bad[:3]
    if deciding is not None:
        assert len({r[sorted(got.columns).index(deciding)] for r in g}) > 1, f"{deciding} is the same in all rows"
    return len(g)
