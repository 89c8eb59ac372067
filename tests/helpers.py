"""Comparing a query with its SQL."""

import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def plain(value):
    """A comparable form of a value from either engine."""
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float):
        return repr(round(value, 6))
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value if value is None or isinstance(value, int) else str(value)


def same_rows(df, connection, sql):
    """Both sides' rows, sorted, by column name."""
    names = sorted(df.columns)
    ours = sorted((tuple(plain(r[n]) for n in names) for r in df.select(*names).collect()), key=repr)
    result = connection.sql(sql)
    assert sorted(result.columns) == names
    place = [result.columns.index(n) for n in names]
    theirs = sorted((tuple(plain(r[k]) for k in place) for r in result.fetchall()), key=repr)
    return ours, theirs
