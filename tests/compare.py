"""Comparing a DataFrame with a query of the SQL oracle."""

import math


def plain(v):
    """A value in a form that both engines' results compare in."""
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


def same_rows(df, duck, sql):
    names = sorted(df.columns)
    ours = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    got = duck.execute(sql)
    cols = [d[0] for d in got.description]
    assert sorted(cols) == names
    theirs = sorted((tuple(plain(r[cols.index(n)]) for n in names) for r in got.fetchall()), key=repr)
    assert ours == theirs
