"""Comparison of a Spark result with a DuckDB result: names, kinds and rows in any order."""

import math


def _plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.12g}")
    if isinstance(x, (list, tuple)) or type(x).__name__ == "ndarray":
        return tuple(_plain(y) for y in x)
    return x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def same(df, con, sql):
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    kinds = dict(zip(rel.columns, map(str, rel.types)))
    spark_kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    for c, k in df.dtypes:
        assert spark_kinds.get(k, kinds[c]) == kinds[c], (c, k, kinds[c])
    a, b = rows_of(df.columns, df.collect()), rows_of(rel.columns, rel.fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x == y
